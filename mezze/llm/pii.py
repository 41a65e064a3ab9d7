"""Personal data: patterns find it, and corpus co-occurrence finds the terms that give it away.

E-mails, addresses of machines, cards and phone numbers are the protected entities. A term of a text discloses one of the
text's entities as far as their pointwise mutual information reaches the entity's own information:

    disclosure(c, t) = PMI(c, t) / IC(c) = 1 + log p(c | t) / log(1 / p(c))

It is 1 where the term stands only in documents with the entity, 0 where they are independent. Probabilities are shares
of all documents. Texts, not documents, are evidence: an entity and a term must meet in `min_texts` different texts, so
copies of one text prove nothing. Terms of high disclosure are generalised, those of the highest are removed.

One pass over the texts finds the patterns and counts terms; of all texts only those with an entity are kept on. Entities
that stand in the same texts are one. A term is paired with entities only if enough of its documents have any entity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezze.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that co-occurrence adds.
ADDED = ("generalise", "remove")
_ORDER = {kind: i for i, kind in enumerate(KINDS + ADDED)}
MIN_TEXTS, GENERALISE_AT, REMOVE_AT = 2, 0.95, 0.99
#: Different terms, and their characters, that a task counts before it hands the counts on.
HELD_TERMS, HELD_CHARS = 1 << 18, 1 << 24
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that starts no address is passed over whole: no later digit of it starts one either.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")
Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From sign to sign, so that no run of characters is read more than twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[Span, str]]:
    """(kind, start, end) in code points and the entity, `kind:value` in a canonical spelling, by start, then kind.

    For each kind the leftmost non-overlapping matches, less those that fail their test; kinds may overlap. The time is
    linear in the text.
    """
    found = [(("email", a, b), f"email:{text[a:b].lower()}") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if m[1] and all(len(x) <= 3 and int(x) <= 255 for x in parts):
            found.append((("ip", *m.span()), "ip:" + ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((("card", *m.span()), f"card:{digits}"))
    for m in _PHONE.finditer(text):
        digits = "".join(c for c in m[0] if c in "0123456789")
        if 9 <= len(digits) <= 15:
            found.append((("phone", *m.span()), f"phone:{digits}"))
    return sorted(found, key=lambda x: (x[0][1], _ORDER[x[0][0]]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """Words (letters, digits and underscores, as Unicode has them) that touch no base span: in lower case, start, end."""
    covered: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    at = 0
    for m in _TERM.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or covered[at][0] >= m.end():
            yield m[0].lower(), m.start(), m.end()


def sanitised(text: str, spans: list[Span]) -> str:
    """Base spans as [KIND], generalised terms as [NUMBER], [NAME] (upper case first) or [WORD], removed ones gone.

    Of overlapping spans the first to start is replaced, the longest of those that start together; what the others cover
    beyond it goes.
    """
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            said = text[a:b]
            shape = "[NUMBER]" if said.isdecimal() else "[NAME]" if said[:1].isupper() else "[WORD]"
            out += [text[at:a], {"generalise": shape, "remove": ""}.get(kind, f"[{kind.upper()}]")]
        at = max(at, b)
    return "".join([*out, text[at:]])


_READ = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("digest", pa.binary()), ("text", pa.string()), ("entities", pa.list_(pa.string())), ("term", pa.string()), ("n", pa.int64())])
_READ_DDL = f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, digest binary, text string, entities array<string>, term string, n long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its text only if it has an entity, and rows of terms with their documents."""
    counts: Counter[str] = Counter()
    chars = 0

    def flushed() -> pa.RecordBatch:
        columns = [pa.nulls(len(counts), f.type) for f in list(_READ)[:-2]] + [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
        return pa.record_batch(columns, schema=_READ)

    for batch in batches:
        rows = []
        for doc_id, said in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = said.as_py() or ""
            found = base_spans(text)
            spans = [span for span, _ in found]
            by_kind = Counter(kind for kind, _, _ in spans)
            held = {t for t, _, _ in terms(text, spans)} if spans else {t.lower() for t in set(_TERM.findall(text))}
            chars += sum(len(t) for t in held if t not in counts)
            counts.update(held)
            rows.append((doc_id, *[by_kind[k] for k in KINDS], listed(spans), *((hashlib.sha256(text.encode()).digest(), text, sorted({e for _, e in found})) if spans else (None, None, None)), None, None))
            if len(counts) >= HELD_TERMS or chars >= HELD_CHARS:
                yield flushed()
                counts.clear()
                chars = 0
        if rows:
            yield pa.record_batch(list(zip(*rows)), schema=_READ)
    if counts:
        yield flushed()


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("term", pa.string())])
    for batch in batches:
        rows = []
        for digest, copies, text in zip(*[c.to_pylist() for c in batch.columns]):
            rows += [(digest, copies, t) for t in {t for t, _, _ in terms(text, [s for s, _ in base_spans(text)])}]
            if len(rows) > 1 << 16:
                yield pa.record_batch(list(zip(*rows)), schema=schema)
                rows = []
        if rows:
            yield pa.record_batch(list(zip(*rows)), schema=schema)


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, text, flagged in zip(*[c.to_pylist() for c in batch.columns]):
            spans, high = [s for s, _ in base_spans(text)], {f["term"]: f["remove"] for f in flagged or ()}
            added = [("remove" if high[t] else "generalise", a, b) for t, a, b in terms(text, spans) if t in high] if high else []
            whole = sorted(spans + added, key=lambda s: (s[1], _ORDER[s[0]]))
            rows.append((digest, listed(whole), sanitised(text, whole)))
        yield pa.record_batch(list(zip(*rows)) if rows else [[], [], []], schema=pa.schema([("digest", pa.binary()), ("spans", pa.string()), ("sanitised", pa.string())]))


def disclosing(texts: DataFrame, counted: DataFrame, n_docs: int, min_texts: int, generalise_at: float) -> DataFrame:
    """digest, term, disclosure: for each text the terms that disclose one of its entities by `generalise_at` or more.

    `texts` has digest, text, copies and entities of the different texts that have any, `counted` term and n_docs of all
    documents. An entity in all documents has no information to disclose.
    """
    said = texts.select("digest", "copies", F.explode("entities").alias("entity"))
    mark = F.xxhash64("digest")
    # Entities with equal sets of texts have equal counts, and so equal disclosures: their set's mark stands for them.
    marks = said.groupBy("entity").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_c"), F.concat_ws(" ", F.bit_xor(mark), F.sum(F.shiftright(mark, 40)), F.count("*")).alias("of"))
    shared = saved(marks.filter((F.col("n_texts") >= min_texts) & (F.col("n_c") < n_docs)).select("entity", "of", "n_c"), "entities")
    least = shared.agg(F.min("n_c")).first()[0] or 1
    protected = saved(said.join(shared, "entity").select("digest", "of", "n_c").distinct(), "protected")
    bearing = texts.join(protected.select("digest").distinct(), "digest", "left_semi").select("digest", "copies", "text")
    held = saved(bearing.mapInArrow(_terms_of, "digest binary, copies long, term string"), "terms")
    any_ = held.groupBy("term").agg(F.sum("copies").alias("n_any"), F.count("*").alias("n_texts")).filter(F.col("n_texts") >= min_texts)
    # p(any entity | t) bounds p(c | t), and the rarest entity asks for the least of it.
    enough = (least / n_docs) ** (1 - generalise_at) * (1 - 1e-9)
    telling = saved(any_.join(counted, "term").filter(F.col("n_any") >= enough * F.col("n_docs")).select("term", "n_docs"), "telling-terms")
    together = saved(held.join(telling, "term").join(protected, "digest").select("digest", "term", "of", "copies", "n_c", "n_docs"), "together")
    pairs = together.groupBy("of", "term").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("n_texts"), F.first("n_c").alias("n_c"), F.first("n_docs").alias("n_t"))
    disclosure = 1 + F.log(F.col("n_ct") / F.col("n_t")) / F.log(F.lit(n_docs) / F.col("n_c"))
    high = pairs.filter(F.col("n_texts") >= min_texts).select("of", "term", disclosure.alias("disclosure")).filter(F.col("disclosure") >= generalise_at)
    return together.select("digest", "of", "term").join(saved(high, "disclosing"), ["of", "term"]).groupBy("digest", "term").agg(F.max("disclosure").alias("disclosure"))


def find(docs: DataFrame, min_texts: int = MIN_TEXTS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans, digest, sanitised: one row per input row, repeated rows too.

    base and spans list kind:start:end by start, then kind, the added kinds last; spans has base and the terms' spans.
    digest (SHA-256) and sanitised, the text as `sanitised` writes it, are null for a text without personal data, which
    stays as it is. A null text is an empty one; a row without a doc_id is a row like others. Only terms of a text that
    has the entity itself are added. Other columns are not read.
    """
    read = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_read, _READ_DDL), "personal-data")
    rows = read.filter("term IS NULL").drop("term", "n")
    n_docs = max(rows.count(), 1)
    counted = read.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n_docs"))
    with_any, without = rows.filter("digest IS NOT NULL"), rows.filter("digest IS NULL")
    texts = saved(with_any.groupBy("digest").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies")), "personal-texts")
    flagged = disclosing(texts, counted, n_docs, min_texts, generalise_at)
    by_text = flagged.groupBy("digest").agg(F.collect_list(F.struct("term", (F.col("disclosure") >= remove_at).alias("remove"))).alias("flagged"))
    marked = texts.select("digest", "text").join(by_text, "digest", "left").mapInArrow(_spans_of, "digest binary, spans string, sanitised string")
    columns = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans", "digest", "sanitised"]
    whole = with_any.drop("text", "entities").join(saved(marked, "personal-spans"), "digest").select(columns)
    return whole.unionByName(without.select(*columns[:6], F.lit("").alias("spans"), "digest", F.lit(None).cast("string").alias("sanitised")))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """All columns of `docs`, the text sanitised; one row per input row. See `find` for nulls and repeated rows."""
    found = find(docs, **how).filter("digest IS NOT NULL").groupBy("digest").agg(F.first("sanitised").alias("sanitised"))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2("text", 256)).alias("digest"))
    text = F.coalesce("sanitised", "row.text").alias("text")
    return rows.join(saved(found, "sanitised"), "digest", "left").select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
