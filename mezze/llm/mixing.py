"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size). Whole epochs cover the integer part of a source's target; what is left is
a subset-sum problem over those counts: a proportional share of every size first, then two bounded-knapsack dynamic
programmes, over what can still be added and over what can be given back, whose difference meets the budget. Within one size, documents are taken in the order of a seeded hash.

Only the counts meet: one group per source with a row per distinct size. A source of S words has fewer than
sqrt(2 S) + 1 distinct sizes, whatever its number of documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mezze.llm.common import WORD, saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words that a dynamic programme may cover, in units of the sizes' common divisor: 4 bytes for each. Up to twice as many
#: words in a source, the fit is as near as any choice of documents; beyond, it is unless none of those choices that stay
#: within so many words of the proportional share comes nearest.
DP_WORDS = 1 << 25
#: Sub-buckets by which a group of equal size is counted before any of its rows is ranked.
SPLITS = 256


def _running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """`rows` with the sums of columns over all rows before, as {new: old}; `order` decides, and no task has all rows.

    Rows are sorted by ranges and written down; each range adds the totals of those before it, of which there are as many
    as partitions.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    ranges = saved(ranges, "mix-ranges")
    within, before = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("range").agg(*[F.sum(old).alias(new) for new, old in sums.items()])
    offsets = totals.select("range", *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    own = ranges.select("*", *[F.coalesce(F.sum(old).over(within), F.lit(0)).alias(new) for new, old in sums.items()])
    joined = own.join(F.broadcast(offsets), "range")
    return joined.select(*rows.columns, *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target: water-filling of share * all words by weight with target <= most * source_size.

    A source is full when `most * source_size / weight` is at most the common level; with the sources in the order of
    that ratio, the level follows from running sums, so no iteration is needed.
    """
    by_source = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources").withColumn("one", F.lit(1).cast("long"))
    placed = _running(by_source, [F.col("source").asc_nulls_last()], {"place": "one"})
    weighted = placed.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
    ).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = saved(_running(weighted, [F.col("ratio"), F.col("source").asc_nulls_last()], {"cap_before": "cap", "weight_before": "weight"}), "mix-weights")
    whole = filled.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("all_weight"))
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    levels = filled.join(F.broadcast(whole)).withColumn("level", level)  # one row, here and below
    # The first source, in ratio order, whose cap is above its share ends the filling; its level holds for all after it.
    stop = levels.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("ratio", "level")).alias("stop"))
    filled = filled.join(F.broadcast(stop))
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("stop.level"), F.col("cap"))).alias("target"))


class _Reach:
    """Which sums up to `most` some choice of documents has, and which."""

    def __init__(self, sizes: list[int], counts: list[int], most: int):
        self.bits, self.steps, self.by = 1, [], np.zeros(most + 1, np.int32)
        mask = (1 << (most + 1)) - 1
        for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):  # short documents first: they fill the gaps
            free, part = min(counts[i], most // sizes[i]), 1
            while free > 0:  # binary splitting of the bounded count
                part = min(part, free)
                new = (self.bits << part * sizes[i]) & mask & ~self.bits
                if new:
                    self.by[self.sums(new)] = len(self.steps)
                    self.steps.append((i, part, sizes[i]))
                    self.bits |= new
                free -= part
                part *= 2

    @staticmethod
    def sums(bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))

    def choice(self, at: int) -> list[tuple[int, int]]:
        """(index, documents) whose words are the sum `at`."""
        out = []
        while at:
            i, part, size = self.steps[self.by[at]]
            out.append((i, part))
            at -= part * size
        return out


def fit(sizes: list[int], counts: list[int], budget: int, most: int | None = None) -> list[int]:
    """How many documents of each size to take so that the taken words come as near `budget` as can be found, see DP_WORDS.

    From a proportional share on, filled up greedily, documents are added and given back. The two programmes reach twice
    as far each time until the nearest sum is met that the sizes' common divisor allows, or all documents are covered.
    Of two sums as near, the smaller one.
    """
    most = DP_WORDS if most is None else most
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget <= 0 or total == 0:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    have = [i for i, s in enumerate(sizes) if s > 0 and counts[i] > 0]
    unit = math.gcd(*[sizes[i] for i in have])
    size, count = [sizes[i] // unit for i in have], [counts[i] for i in have]
    goal = budget // unit
    ideal = min(budget - goal * unit, (goal + 1) * unit - budget)
    take = [n * budget // total for n in count]
    left = goal - sum(s * n for s, n in zip(size, take))
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        more = min(count[i] - take[i], left // size[i])
        take[i], left = take[i] + more, left - more * size[i]
    free = [n - t for n, t in zip(count, take)]
    all_free, all_taken = (sum(s * n for s, n in zip(size, x)) for x in (free, take))
    reach = min(4 * max(size), most)
    while True:
        add, back = _Reach(size, free, min(reach, all_free)), _Reach(size, take, min(reach, all_taken))
        added, given = add.sums(add.bits), back.sums(back.bits)
        # For each sum given back, the sums added that lie next to what then is missing, which is a part of a unit more.
        place = np.searchsorted(added, given + left)
        best = None
        for at in (np.clip(place + k, 0, len(added) - 1) for k in (-1, 0, 1)):
            words = (added[at] - given - left + goal) * unit
            gaps = np.abs(words - budget)
            k = min(np.flatnonzero(gaps == gaps.min()).tolist(), key=lambda k: (words[k], given[k]))
            best = min(best or (math.inf,), (int(gaps[k]), int(words[k]), int(added[at[k]]), int(given[k])))
        if best[0] <= ideal or reach >= max(all_free, all_taken) or reach >= most:
            break
        reach = min(2 * reach, most)
    for i, n in add.choice(best[2]):
        take[i] += n
    for i, n in back.choice(best[3]):
        take[i] -= n
    out = [0] * len(sizes)
    for i, n in zip(have, take):
        out[i] = n
    return out


def _plan(key, group: pd.DataFrame) -> pd.DataFrame:
    """One source: whole epochs and, for each size, how many documents have one repetition more."""
    group = group.sort_values("size")
    sizes, counts = group["size"].astype("int64").tolist(), group["n"].astype("int64").tolist()
    total, target = sum(s * n for s, n in zip(sizes, counts)), float(group["target"].iloc[0])
    epochs = int(target // total) if total else 0
    extra = fit(sizes, counts, round(target) - epochs * total)
    return pd.DataFrame({"source": group["source"], "size": sizes, "epochs": epochs, "extra": extra, "target": target, "source_size": total})


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, source, of (hash of the text), size, source_size, target, copies, taken; one row per input row.

    size: words of the text, 0 for a null or empty one, which is then taken 0 times. A null source is a source, last in
    order. Rows that share an id are separate documents; ties of the seeded hash are broken by id and the text's hash,
    so a rerun takes the same texts. An empty table gives no rows.
    """
    counted = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    ranked_by = F.xxhash64(F.lit(seed), "doc_id")
    sized = saved(counted.withColumn("draw", ranked_by), "mix-sizes").withColumn("split", F.pmod("draw", F.lit(SPLITS)))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # joins and groups keep a null source
    sized = sized.withColumn("of", named)
    goal = targets(sized, weights, share, most).select(named.alias("of"), "source_size", "target")
    split_counts = saved(sized.groupBy("of", "size", "split").agg(F.count("*").alias("n")), "mix-counts")
    histogram = split_counts.groupBy("of", "size").agg(F.sum("n").alias("n")).join(goal.select("of", "target"), "of")
    plan = histogram.select(F.col("of").alias("source"), "size", "n", "target").groupBy("source").applyInPandas(
        _plan, "source string, size long, epochs long, extra long, target double, source_size long"
    ).withColumnRenamed("source", "of")
    before = Window.partitionBy("of", "size").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    reach = split_counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, ["of", "size"])
    cut = reach.select("of", "size", "split", "epochs", "target", "source_size", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("of_split"), F.col("n").alias("in_split"))
    cut = saved(cut, "mix-cuts")
    # As many rows as there are sizes and sub-buckets: written small, but not to be broadcast.
    tagged = sized.join(cut.hint("merge"), ["of", "size", "split"])
    whole = (F.col("of_split") == 0) | (F.col("of_split") == F.col("in_split"))
    settled = tagged.filter(whole).withColumn("rank", F.when(F.col("of_split") == 0, F.lit(1)).otherwise(F.lit(0)))
    # Only the one sub-bucket that a cut goes through is ranked.
    open_ = tagged.filter(~whole).withColumn("rank", F.when(F.row_number().over(Window.partitionBy("of", "size", "split").orderBy("draw", "doc_id", "text_hash")) <= F.col("of_split"), 0).otherwise(1))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("epochs") + F.when(F.col("rank") == 0, 1).otherwise(0))
    return settled.unionByName(open_).select("doc_id", "source", F.col("text_hash").alias("of"), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def draw(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns as they are, each as many times as the mix takes it; rows with 0 copies go.

    Repeated rows (one doc_id, source and text) are drawn as one row with the sum of their copies.
    """
    copies = mix(docs, **how).groupBy("doc_id", "source", "of").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    copies = copies.select(F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("of").alias("c_of"), "copies")
    rows = docs.select(F.struct("*").alias("row")).withColumn("text_hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = F.col("row.doc_id").eqNullSafe(F.col("c_id")) & F.col("row.source").eqNullSafe(F.col("c_source")) & (F.col("text_hash") == F.col("c_of"))
    once = Window.partitionBy("c_id", "c_source", "c_of").orderBy("c_id")
    drawn = rows.join(copies, same).withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
