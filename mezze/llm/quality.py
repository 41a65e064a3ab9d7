"""Quality rules: base counts and the divergence of a document's histograms from its language's reference.

DataFrame functions only. A document's character classes and common words are turned into two distributions; each is
held against the language's reference by Jensen-Shannon distance (base 2, 0 to 1). Common words are few, so a text without
any is less than 0.45 from each reference; the common-word distance is therefore also held against that text's, and
against the distances to the other languages. Texts under the length guards are not judged by the distance whose guard
they miss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mezze.llm.common import GAPS, bind, words

#: Shares of common words in running text, in percent, by language.
COMMON = {
    "en": {"the": 6.2, "of": 3.0, "and": 2.7, "to": 2.5, "a": 2.1, "in": 1.9, "is": 1.1, "that": 1.1, "it": 1.0, "for": 0.9, "was": 0.9, "on": 0.7, "with": 0.7, "as": 0.7, "be": 0.6, "by": 0.5},
    "fr": {"de": 5.0, "la": 3.3, "le": 2.6, "et": 2.3, "les": 2.0, "des": 1.7, "en": 1.5, "un": 1.4, "du": 1.2, "une": 1.1, "que": 1.0, "est": 1.0, "pour": 0.9, "qui": 0.8, "dans": 0.8, "au": 0.7},
    "de": {"der": 3.4, "die": 3.3, "und": 2.8, "in": 1.9, "den": 1.3, "von": 1.1, "zu": 1.1, "das": 1.1, "mit": 1.0, "sich": 0.9, "des": 0.9, "auf": 0.8, "für": 0.8, "ist": 0.8, "im": 0.8, "nicht": 0.7},
    "es": {"de": 6.0, "la": 4.0, "que": 3.1, "el": 2.8, "en": 2.7, "y": 2.5, "los": 1.7, "se": 1.4, "del": 1.3, "las": 1.2, "un": 1.1, "por": 1.0, "con": 0.9, "no": 0.8, "una": 0.8, "para": 0.7},
}
#: Shares of character classes in prose, in percent: small letters and the rest, A-Z, characters beyond ASCII, digits, white space, punctuation, symbols.
CLASSES = {
    "en": (77.5, 2.5, 0.2, 0.5, 16.8, 2.4, 0.1),
    "fr": (74.8, 2.4, 3.4, 0.5, 16.3, 2.5, 0.1),
    "de": (77.6, 4.8, 1.6, 0.5, 13.0, 2.4, 0.1),
    "es": (75.9, 2.3, 2.6, 0.5, 16.2, 2.4, 0.1),
}
SYMBOLS = "[#*$%&|<>]+"
#: The common words of all languages, and a letter for each.
VOCABULARY = sorted({w for common in COMMON.values() for w in common})
LETTERS = [chr(ord("#") + i) for i in range(len(VOCABULARY))]


def _chars(pattern: str) -> Column:
    """Characters of the text that the pattern covers; it should match seldom, as each match costs a copy."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def _distribution(counts: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return bind(counts, lambda a: bind(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions of equal length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def _reference(lang: str) -> tuple[list[float], list[float]]:
    """Shares of common words, words beyond them as the last share, and of character classes."""
    shares = [v / 100 for v in COMMON[lang].values()]
    return [*shares, 1 - sum(shares)], [v / sum(CLASSES[lang]) for v in CLASSES[lang]]


def _without(lang: str) -> float:
    """The common-word distance of a text that has none of the language's common words."""
    shares = _reference(lang)[0]
    rest = shares[-1]
    return math.sqrt((sum(shares[:-1]) + math.log2(2 / (1 + rest)) + rest * math.log2(2 * rest / (1 + rest))) / 2)


def _literals(values) -> Column:
    return F.array(*map(F.lit, values))


def _fence(df: DataFrame) -> DataFrame:
    """Rows as they are; expressions below are evaluated once and not merged into those above."""
    return df.select(F.inline(F.array(F.struct("*"))))


#: With so few different repeated windows, looking each one up costs less than sorting windows with their places.
FEW = 16


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """_row (the whole row, if `carry`), doc_id and the base counts of every row, plus what the histograms need: `of` is the language, `common` counts VOCABULARY. A null text has no words."""
    docs = docs.select((F.struct("*") if carry else F.struct("doc_id")).alias("_row"), "doc_id", F.col("lang").alias("of"), F.coalesce("text", F.lit("")).alias("text"))
    # One letter for each common word, none for others; few words have the length of one.
    lengths = range(max(len(w.encode()) for w in VOCABULARY) + 1)
    sized = [[(w, c) for w, c in zip(VOCABULARY, LETTERS) if len(w.encode()) == n] for n in lengths]
    by_length = lambda k: F.array(*[_literals(x[k] for x in same).cast("array<string>") for same in sized])
    place = lambda x: F.get(F.get(by_length(1), F.octet_length(x)), (F.array_position(F.get(by_length(0), F.octet_length(x)), x) - 1).cast("int"))
    window = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: window(w, i)).alias("h"),
        )

    hashed = _fence(docs.select(
        "_row", "doc_id", "of", F.length("text").alias("n_text"),
        bind(words(F.col("text")), of_words).alias("of_words"),
        bind(F.filter(F.split("text", "\n"), lambda x: F.length(F.ltrim(F.translate(x, "\t\x0b\f\r", ""))) > 0), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _chars(SYMBOLS).cast("long").alias("n_symbols"), _chars("[A-Z]+").alias("upper"), _chars("[0-9]+").alias("digits"),
        _chars(r"[.,;:!?'\"()-]+").alias("marks"), F.when(F.octet_length("text") == F.length("text"), 0).otherwise(_chars(r"[^\x00-\x7F]+")).alias("beyond"),
        F.array_join(F.transform(words(F.lower("text")), place), "").alias("places"),
    )).select("*", "of_words.*").drop("of_words")
    ordered = _fence(hashed.select("*", F.sort_array("h").alias("s")))
    same = lambda a, b: F.coalesce(F.get("s", a) == F.get("s", b), F.lit(False))
    twice = _fence(ordered.select("*", F.array_distinct(F.filter("s", lambda x, j: same(j, j - 1))).alias("again")).drop("s"))

    # Few repeats: look each window up. Many: sort windows with their places and keep those with an equal neighbour.
    looked_up = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("again", F.col("h")[i]))
    paired = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    level = lambda s, a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
    neighbours = bind(paired, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: level(s, j, j - 1) | level(s, j, j + 1)), lambda x: x["i"])))
    at = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(F.size("again") <= FEW, looked_up).otherwise(neighbours)
    placed = _fence(twice.select("*", at.alias("at")).drop("h", "again"))
    covered = F.aggregate(F.transform("at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - x, F.lit(3)))), F.lit(0), lambda n, x: n + x)
    counts = F.array(*[(F.length("places") - F.length(F.replace("places", F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return placed.select(
        "_row", "doc_id", "of", "n_text", "n_words", "word_chars", "n_symbols", "upper", "digits", "marks", "beyond",
        "n_dup_lines", covered.cast("long").alias("n_repeat_words"), counts.alias("common"),
    )


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, most_words: float = 0.45, most_classes: float = 0.2, guard_words: int = 50, guard_chars: int = 200, most_share: float = 0.85, most_nearer: float = 0.15) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, word_distance, class_distance.

    Base: too few words, or too many of them in repeated 3-word windows. Verdict: the common-word distance is at most
    `most_words` and the character-class distance at most `most_classes`. Besides, the common-word distance as a share of
    that of a text without common words is at most `most_share`, and no other language's share is more than `most_nearer`
    below it, which leaves room for a passage in another language. A language without a reference (null too) is judged
    by the nearest one. A text under `guard_words` words or `guard_chars` characters has a null distance and passes that test.
    One row per input row; an empty or null text counts 0 everywhere and fails the base.
    """
    return _judged(docs, min_words, max_repeat_percent, most_words, most_classes, guard_words, guard_chars, most_share, most_nearer).drop("_row")


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `judge` keeps under the same limits."""
    return _judged(docs, carry=True, **limits).filter("kept").select("_row.*")


def _judged(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, most_words: float = 0.45, most_classes: float = 0.2, guard_words: int = 50, guard_chars: int = 200, most_share: float = 0.85, most_nearer: float = 0.15, carry: bool = False) -> DataFrame:
    m = measure(docs, carry)
    named = ("upper", "beyond", "digits", "blank", "marks", "n_symbols")
    m = m.withColumn("blank", F.col("n_text") - F.col("word_chars"))
    rest = F.greatest(F.lit(0), F.col("n_text") - sum(F.col(c) for c in named))
    classes = F.array(*[c.cast("double") for c in (rest, *map(F.col, named))])
    count = lambda w: F.get("common", F.lit(VOCABULARY.index(w)))
    histogram = lambda common: F.array(*map(count, common), F.col("n_words") - sum(map(count, common)))
    word_distances = F.array(*[js_distance(_distribution(histogram(common)), _literals(_reference(lang)[0])) for lang, common in COMMON.items()])
    class_distances = F.array(*[js_distance(_distribution(F.col("classes")), _literals(_reference(lang)[1])) for lang in COMMON])
    m = _fence(_fence(m.withColumn("classes", classes)).select("*", word_distances.alias("by_words"), class_distances.alias("by_classes")))
    m = _fence(m.select("*", F.zip_with("by_words", _literals(map(_without, COMMON)), lambda d, most: d / most).alias("shares"), (F.array_position(_literals(COMMON), F.col("of")) - 1).cast("int").alias("at")))
    nearest = F.array_min("shares")
    at = F.coalesce(F.when(F.col("at") >= 0, F.col("at")), (F.array_position("shares", nearest) - 1).cast("int"))
    m = m.select(
        "_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_words") >= guard_words, F.get("by_words", at)).alias("word_distance"),
        F.when(F.col("n_text") >= guard_chars, F.coalesce(F.get("by_classes", "at"), F.array_min("by_classes"))).alias("class_distance"),
        ((F.col("n_words") < guard_words) | ((F.get("shares", at) <= most_share) & (F.get("shares", at) - nearest <= most_nearer))).alias("own_words"),
    )
    fits = F.col("own_words") & (F.coalesce("word_distance", F.lit(0.0)) <= most_words) & (F.coalesce("class_distance", F.lit(0.0)) <= most_classes)
    return m.select("_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "word_distance", "class_distance")
