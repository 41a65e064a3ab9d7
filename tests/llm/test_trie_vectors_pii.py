"""Personal data, prefix tries and vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures_llm import CLASHES, documents, frame
from mezze.llm import pii, registry, trie, vectors
from mezze.llm.common import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Vector codes


def coded(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error, codebooks_sha256) of all kept rows, every distance worked out."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    whole = [[math.floor(256 * x) for x in np.array(v, np.float32).tolist()] + [0] * (parts * width - len(v)) for _, v, _ in rows]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(mine[e]) for x in zip(*mine[e])) if e in mine else entry for e, entry in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    by_label = Counter()
    for (_, _, label), f in zip(rows, found):
        by_label[label] += min(sum(d for d, _ in f), 2**63 - 1)
    said = sha(",".join(str(x) for book in books for e in book for x in e))
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in f), min(sum(d for d, _ in f), 2**63 - 1), min(by_label[label], 2**63 - 1), said) for (i, _, label), f in zip(rows, found))


def vector_rows():
    rnd = random.Random(2)
    some = lambda: [rnd.choice([-0.5, -0.01, 0.0, 0.25, rnd.gauss(0, 1)]) for _ in range(8)]
    rows = [(i, some(), rnd.choice([None, 1, 2])) for i in range(150)]
    same = some()
    rows += [(200 + i, same, 1) for i in range(60)]  # a third are copies
    rows += [rows[3], rows[3], (5, some(), 1), (None, some(), None), (None, same, 2)]
    return rows + [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 2), (303, [float("inf")] * 8, 2)]


def compress(spark, rows, **how):
    more = ", ".join(c for c in CLASHES.split(", ") if not c.startswith("label"))
    df = spark.createDataFrame([(*r, *[None] * len(more.split(", "))) for r in rows], f"vec_id long, embedding array<float>, label int, {more}")
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vectors.compress(df, **how).collect())


@pytest.mark.parametrize(("parts", "entries"), [(4, 16), (2, 33), (8, 1)])
def test_codes_equal_all_distances(spark, parts, entries):
    assert compress(spark, vector_rows(), parts=parts, entries=entries, rounds=2) == coded(vector_rows(), parts, entries, 2)


def test_codes_of_odd_vectors(spark):
    odd = [(1, [], 1), (2, [0.5, -3.0e38, 3.0e38], 1), (3, [1.0], None), (4, [1e12, 2.0, 3.0, 4.0, 5.0], 1), (4, [1e12, 2.0, 3.0, 4.0, 5.0], 1)]
    assert compress(spark, odd, parts=3, entries=3, rounds=2) == coded(odd, 3, 3, 2)
    assert compress(spark, [(1, [], 1), (2, [], 1)], parts=3, entries=2) == coded([(1, [], 1), (2, [], 1)], 3, 2, 2)
    assert compress(spark, []) == [] == compress(spark, [(1, None, 1)])


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LABELS", 1)
    assert compress(spark, vector_rows(), parts=4, entries=8) == coded(vector_rows(), 4, 8, 2)


def test_nearest_breaks_ties_downwards():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        book, points = rnd.integers(-3, 4, (rnd.integers(1, 70), 3)), rnd.integers(-3, 4, (200, 3))
        d = ((points[:, None] - book) ** 2).sum(axis=2)
        at, best = vectors.nearest(points, book)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_decoded_codes_are_the_nearest_entries(spark):
    df = spark.createDataFrame([r[:2] for r in vector_rows()[:150]], "vec_id long, embedding array<float>")
    books = vectors.train(df, parts=4, entries=16)
    back = {r["vec_id"]: r for r in vectors.decode(vectors.encode(df, books), books).collect()}
    for i, v, _ in vector_rows()[:150]:
        error = sum((math.floor(256 * x) - 256 * y) ** 2 for x, y in zip(np.array(v, np.float32).tolist(), back[i]["embedding"]))
        assert error == back[i]["error"]


# Prefix trie


def conversation_rows(seed=4, n=260):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), 1000, 1001, 5001, -3, -250, *range(7001, 7012)]:
        if c % 100 == 50:
            continue
        long_ = c in (7, 107)
        for turn in range(400 if long_ else 1 if c > 7000 else rnd.randint(1, 7)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é€", "same"]) if rnd.random() < 0.9 or not long_ else f"t{turn}"))
    for c in range(600, 640):  # copies that do not meet a donor
        rows += [(c, 0, "user", "hot"), (c, 1, "assistant", "hot too")]
    rows += [(3, None, None, None), (3, None, "user", "x"), (3, 1, "user", "tie"), rows[0], rows[0], (None, 0, "user", "no one's"), (9, 2, "", ""), (9, 3, "us", "er:")]
    rnd.shuffle(rows)
    return rows


def own_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    return {c: [(x[3], x[4]) for x in sorted(t)] for c, t in by.items()}


def trie_rows(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    ends = defaultdict(list)
    for c, turns in sequences.items():
        ends[tuple(turns)].append(c)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items())


def nodes_of(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect())


def conversations(spark, rows):
    more = ", ".join(c for c in CLASHES.split(", ") if not c.startswith("text "))
    return spark.createDataFrame([(*r, *[None] * len(more.split(", "))) for r in rows], f"conv_id long, turn long, role string, text string, {more}")


@pytest.mark.parametrize("local_turns", [1, 60, trie.LOCAL_TURNS])
def test_trie_equals_all_prefixes(spark, local_turns):
    rows = [r for r in conversation_rows() if local_turns > 1 or r[0] not in (7, 107)]
    assert nodes_of(trie.trie(trie.sequences(conversations(spark, rows)), local_turns)) == trie_rows(own_turns(rows))


def test_grafted_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(trie, "LARGE", 0)
    rows = conversation_rows()
    own, grafted = own_turns(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - int(math.fmod(c, 100))
        grafted[c] = own.get(donor, [])[:h] + turns[h:]
    assert any(not t for t in grafted.values())
    got = trie.grafted(trie.sequences(conversations(spark, rows)), F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6, most=5)
    assert nodes_of(trie.trie(got, 100)) == trie_rows(grafted)


def test_trie_of_little(spark):
    assert nodes_of(trie.trie(trie.sequences(conversations(spark, [])))) == []
    assert nodes_of(trie.trie(trie.sequences(conversations(spark, [(None, 1, "user", "x")])))) == []
    assert nodes_of(trie.trie(trie.sequences(conversations(spark, [(5, None, None, None)])))) == trie_rows({5: [("", "")]})


# Personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sound(kind, said):
    digits = [int(c) for c in said if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in said.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 12 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(kind, m.start(), m.end()) for kind, pattern in BASE.items() for m in pattern.finditer(text) if sound(kind, m.group())]
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(8)
    for _ in range(4000):
        text = "".join(rnd.choice(["@", ".", "a", "Z9", "-", "_", "1", "25", "256", "0", " ", "+", "(", ")", "é", "4111 1111 1111 1111", "4716-2155-5555-1234", "1.2.3.4", "x@y.z", "+1 (743) 555-3824"]) for _ in range(rnd.randint(0, 24)))
        assert [s for s, _ in pii.base_spans(text)] == plain_spans(text), text


def test_base_spans_of_long_runs():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "a@" * 200_000, "+1 " * 150_000, "0" * 6000 + ".1.2.3", "+1" + " " * 300_000, "a@b.c" * 50_000):
        pii.base_spans(text)
        sum(1 for _ in pii.terms(text, [s for s, _ in pii.base_spans(text)]))
    assert [s for s, _ in pii.base_spans("0" * 6000 + ".1.2.3")] == [("ip", 0, 6006)]


def plain_find(texts, min_texts=2, generalise_at=0.95, remove_at=0.99):
    """For each text its spans, by counting every pair of an entity and a term."""
    n, info = len(texts), {}
    for t in set(texts):
        spans = plain_spans(t)
        entities = {e for _, e in pii.base_spans(t)}
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t) if all(b <= m.start() or a >= m.end() for _, a, b in spans)]
        info[t] = spans, entities, words
    docs_of, texts_of = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for x in [("c", e) for e in info[t][1]] + [("t", w) for w, _, _ in info[t][2]]:
            docs_of[x].add(i)
            texts_of[x].add(t)
    out = []
    for t in texts:
        spans, entities, words = info[t]
        high = {}
        for w in {w for w, _, _ in words}:
            for e in entities:
                both, all_c, all_t = (len(docs_of["c", e] & docs_of["t", w]), len(docs_of["c", e]), len(docs_of["t", w]))
                if all_c < n and len(texts_of["c", e] & texts_of["t", w]) >= min_texts:
                    pmi, ic = math.log(both * n / (all_c * all_t)), math.log(n / all_c)
                    high[w] = max(high.get(w, 0), pmi / ic)
        added = [("remove" if high[w] >= remove_at else "generalise", a, b) for w, a, b in words if high.get(w, 0) >= generalise_at]
        order = [*BASE, "generalise", "remove"]
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans + added, key=lambda s: (s[1], order.index(s[0])))))
    return out


def pii_texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeioumnst") for _ in range(rnd.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(220)]
    for k in range(5):
        secret, near_ = f"zeta{k}", f"Nearby{k}"
        for i in range(k + 1):
            texts.append(f"{word()} {secret} {near_} {word()} mail k{k}@ex.org, or +1 (555) 010-77{k}{i} {word()} {secret}")
        texts += [f"{near_} stands elsewhere {word()}"] * (k // 3)
    texts += [f"copy of one text owner@solo.org only{word()} here"] * 70  # a third are copies
    texts += ["both a1@x.org b1@x.org mark", "again a1@x.org b1@x.org Mark 42", "third a1@x.org 42", "", "", "É 4111 1111 1111 1111, 1.2.3.4 é"]
    return texts + [None]


def test_disclosing_terms_equal_all_pairs(spark):
    texts = pii_texts()
    rows = [(i, t, "en", "s", 0) + (None,) * 13 for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0) + (None,) * 13, (None, texts[225], "en", "s", 0) + (None,) * 13]
    want = plain_find([r[1] or "" for r in rows])
    got = sorted((repr(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base"], r["spans"]) for r in pii.find(frame(spark, rows)).collect())
    plain = []
    for r, spans in zip(rows, want):
        base = plain_spans(r[1] or "")
        plain.append((repr(r[0]), *[sum(k == kind for k, _, _ in base) for kind in BASE], ",".join(f"{k}:{a}:{b}" for k, a, b in base), spans))
    assert got == sorted(plain)
    assert any("remove" in w for w in want) and any("generalise" in w for w in want)
    assert not any("remove" in w or "generalise" in w for t, w in zip(texts, want) if t and "solo.org" in t)


def test_sanitised_texts(spark):
    rows = [(i, t, "en", "s", 0) + (None,) * 13 for i, t in enumerate(pii_texts())]
    got = pii.sanitise(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert len(texts) == len(rows)
    for i, t, *_ in rows:
        if not plain_spans(t or ""):
            assert texts[i] == t
        else:
            assert not plain_spans(texts[i]) and "@" not in texts[i]
    assert any("zeta4" in (r[1] or "") for r in rows) and not any("zeta4" in (t or "") for t in texts.values())
    assert "[CARD], [IP] é" in texts[len(rows) - 2]


def test_personal_data_of_little(spark):
    assert pii.find(frame(spark, [])).collect() == [] == pii.sanitise(frame(spark, [])).collect()
    whole = pii.find(frame(spark)).collect()
    assert len(whole) == len(documents())


# Registered queries


@pytest.mark.parametrize("name", ["op11_pii", "op12_prefix_trie", "op13_vector_codes"])
def test_registered_columns(spark, sf_dir, name):
    rows = registry.queries()[name](spark, sf_dir).collect()
    if name == "op11_pii":
        docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
        spans = plain_find([t for _, t in docs])
        want = []
        for (i, t), s in zip(docs, spans):
            base = plain_spans(t)
            want.append((i, *[sum(k == kind for k, _, _ in base) for kind in BASE], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)), s))
        assert sorted(tuple(r) for r in rows) == want
    elif name == "op12_prefix_trie":
        own, grafted = own_turns([tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]), {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            grafted[c] = own.get(c - c % 100, [])[:h] + turns[h:]
        assert sorted(tuple(r) for r in rows) == trie_rows(grafted)
    else:
        vecs = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, sf_dir, "embeddings").collect()]
        assert sorted((repr(r[0]), *r[1:]) for r in rows) == coded(vecs[:], 16, 64, 2)
