"""Line dedup by distinct-site spread: a line that stands on many sites is boilerplate.

Every line's sites go into a HyperLogLog sketch per line hash; sketches merge map-side and again after the shuffle, so a
line on every page of the corpus costs one small sketch per task. Lines whose estimate lies near the threshold get exact
distinct counts. Only the lines found then are joined back, and only their places per document meet the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mezze.llm.common import bind, saved

#: Sites on which a line must stand to be boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers; the estimate's standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 6
_LINE = ("h1", "h2")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _lines(docs: DataFrame) -> DataFrame:
    """h1, h2, site, doc_id, of, at: a row for each line that has a word. `of` tells rows with one doc_id apart by text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.xxhash64("source").alias("site"), F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    line = split.withColumn("line", _trimmed(F.col("line"))).filter("line != ''")
    return line.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site", "doc_id", "of", "at")


def spread(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h1, h2, n_sites, first_id, first_of of the lines on `min_sites` sites or more; a null source counts as a site.

    n_sites is exact near the threshold and an estimate far above it. first_of is the smallest text hash of rows without
    an id, for lines that stand only there.
    """
    lines = _lines(docs).withColumn("unnamed", F.when(F.col("doc_id").isNull(), F.col("of")))
    first = lambda: (F.min("doc_id").alias("first_id"), F.min("unnamed").alias("first_of"))
    margin = ERRORS * 1.04 / math.sqrt(2**lg_k)
    sketched = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), *first())
    estimated = sketched.select(*_LINE, "first_id", "first_of", F.hll_sketch_estimate("sketch").alias("n_sites")).filter(F.col("n_sites") >= math.floor(min_sites * (1 - margin)))
    # Written down, here and below: Spark splits a line that is on a third of all pages only between two shuffles.
    estimated = saved(estimated, "line-sites")
    far = F.col("n_sites") > math.ceil(min_sites * (1 + margin))
    near = estimated.filter(~far)
    sites = lines.join(near.select(*_LINE), [*_LINE], "left_semi").groupBy(*_LINE, "site").agg(*first())
    exact = sites.groupBy(*_LINE).agg(F.min("first_id").alias("first_id"), F.min("first_of").alias("first_of"), F.count("*").alias("n_sites")).filter(F.col("n_sites") >= min_sites)
    return estimated.filter(far).unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, lg_k: int = LG_K) -> DataFrame:
    """All columns of `docs`, with the text less its boilerplate lines, and n_lines, n_removed (a clash gives way to these).

    Lines are split at \\n and compared without ASCII white space at their ends; lines without a word are never counted
    or removed. With `keep_first`, the document with the smallest doc_id among those that have the line keeps it, so that
    groups of copies across sites do not vanish with their lines. A null text stays null with 0 lines; a null source is a
    site of its own; a row without a doc_id is the first only of lines that no other row has, by its text's hash. One row per input row, repeated rows alike.
    """
    lines = _lines(docs)
    found = lines.join(saved(spread(docs, min_sites, lg_k), "boilerplate"), [*_LINE])
    if keep_first:
        unnamed = F.col("doc_id").isNull() & F.col("first_id").isNull() & (F.col("of") == F.col("first_of"))
        found = found.filter(~F.coalesce(F.col("doc_id") == F.col("first_id"), unnamed))
    gone = found.groupBy("doc_id", "of").agg(F.collect_set("at").alias("gone")).select(F.col("doc_id").alias("gone_id"), F.col("of").alias("gone_of"), "gone")
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*kept_columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("gone_of"))
    split = F.split("row.text", "\n")
    places = lambda a: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone"))
    left = bind(split, lambda a: F.transform(places(a), lambda i: F.get(a, i)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: F.length(_trimmed(x)) > 0)), F.lit(0)).cast("long")
    joined = rows.join(gone, same, "left").select("row", text.alias("text"), F.when(F.col("row.text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    n_removed = F.when(F.col("n_removed") < 0, 0).otherwise(F.col("n_removed")).cast("long").alias("n_removed")
    return joined.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept_columns], "n_lines", n_removed)
