"""Near-duplicate detection by MinHash with tensored banding.

Two collections of M band hashes (of ROWS minhashes each) give M * M tables: the key of table (i, j) pairs the i-th hash of
the first collection with the j-th of the second, so 2 * M * ROWS minhashes do the work of 2 * M * M * ROWS. A table key can
only be shared where both halves are, so halves that nobody shares are dropped before tables are formed.

Documents with one and the same shingle set are one node from the start. No list of a bucket's pairs is made: members are
held against the bucket's most central member, its pivot. In each pivot's group, members of different clusters are then
held against those nearest to the pivot, and last against each other, in blocks: a block's intersections are one product of
two 0/1 matrices, and what leaves a block are at most as many links as it has rows. Two that meet in several groups are
compared where both are at home, that is in the largest group of each. Every link is confirmed on full sets. Links meet in
connected components; later links join the components of earlier ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mezze.llm.common import saved

#: Minhashes in one half of a table key.
ROWS = 3
#: Highest chance that two documents right at the threshold share no table.
MISS = 1e-5
#: Bits of the sieve for texts.
SIEVE = 1 << 25
#: Parts of a pivot's group; the member of each that is nearest to the pivot is tried as a pivot, too.
SPLITS = 16
#: Rows and shingles of one side of a block, about.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 20
#: Shingles that one matrix of a block covers at a time.
COLUMNS = 4096


def collections_for(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Band hashes in each collection so that a pair at `threshold` percent is missed with at most `miss`."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (threshold / 100) ** rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z as a-z, words between ASCII white space."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    n = min(words, len(split))
    out = np.full(len(hashed) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out + hashed[i : len(hashed) - n + 1 + i])
    return np.unique(out)


def _halves(s: np.ndarray, m: int, rows: int, seeds: np.ndarray) -> np.ndarray:
    """2 * m band hashes of a set; a minhash is the least of the shingle hashes times a seeded odd number."""
    mins = np.empty(2 * m * rows, np.uint64)
    for start in range(0, len(mins), 16):
        part = seeds[start : start + 16]
        least = np.full(len(part), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 1 << 15):
            np.minimum(least, (s[at : at + (1 << 15), None] * part[None, :]).min(axis=0), out=least)
        mins[start : start + 16] = least
    bands = np.zeros(2 * m, np.uint64)
    for r in range(rows):
        bands = _mix(bands + mins[r::rows])
    return _mix(bands + np.arange(2 * m, dtype=np.uint64))


def signatures(docs: DataFrame, words: int, m: int, rows: int) -> DataFrame:
    """doc_id, n (set size), same (128-bit hash of the set), halves; one row per input row."""
    seeds = np.random.default_rng(20240229).integers(0, 1 << 63, 2 * m * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text, words)
                out.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, _halves(s, m, rows, seeds).view(np.int64) if len(s) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "same", "halves"])

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInPandas(make, "doc_id long, n long, same binary, halves array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, s: the shingle sets of rows with node, same and text, where `same` is the hash of the set."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch["text"]]
            own = [i for i, (s, same) in enumerate(zip(sets, batch["same"])) if xxhash.xxh3_128_digest(s.tobytes()) == bytes(same)]
            if own:
                yield pd.DataFrame({"node": batch["node"].iloc[own].to_numpy(), "s": [sets[i].view(np.int64) for i in own]})

    return docs.mapInPandas(make, "node long, s array<long>")


def _sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose node may be among `wanted`: one bit for each hash of a node, so that most texts need no shuffle.

    The bits are a table of at most SIEVE / 32768 rows of 4 KB, whatever the data. Rows let through in error go in the join
    that follows.
    """
    bit = F.pmod(F.xxhash64("node"), F.lit(SIEVE))
    bits = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit"))
    return marked.join(F.broadcast(bits), "bucket").filter(F.pmod(F.floor(byte / F.pow(F.lit(2.0), place % 8)), F.lit(2)) == 1).select(rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable from each node of `edges` (a, b), by alternating star contraction.

    Each round is a few aggregations over the edges that are left, written to the shared folder; no edge or node comes to
    the driver, and the number of rounds grows with the logarithm of the longest path. Stars need no round.
    """
    edges = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")), "lows")
        # Large star: every larger neighbour to the least one. Small star: every smaller neighbour, and the node, too.
        large = saved(both.filter("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = saved(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m"), "downs")
        ends = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        edges = saved(large.join(down, F.col("a") == F.col("c")).select(ends).select("e.a", "e.b").filter("a != b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge (a, b), a > b, leads to a root: no node has two of them, and none is at both ends."""
    end = lambda c, down: F.struct(F.col(c).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    ends = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return (nodes.agg(F.max(F.col("down") + F.col("up"))).first()[0] or 0) <= 1


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with na, nb, the sizes of their sets, and i, that of the intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    sizes = [F.size(s).cast("long").alias(n) for s, n in (("sa", "na"), ("sb", "nb"))]
    return pairs.join(left, "a").join(right, "b").select("a", "b", *sizes, F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))


def _reached(i, na, nb, threshold: int):
    return 100 * i >= threshold * (na + nb - i)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of `left` with each of `right`, all sorted arrays of distinct values."""
    out = np.zeros((len(left), len(right)))
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    at = [np.minimum(np.searchsorted(both, f), len(both) - 1) for f in flat]
    own = [both[a] == f for a, f in zip(at, flat)]
    at, rows = [a[o] for a, o in zip(at, own)], [r[o] for r, o in zip(rows, own)]
    for start in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - start)
        parts = []
        for n, a, r in zip((len(left), len(right)), at, rows):
            part = np.zeros((n, width), np.float32)
            here = (a >= start) & (a < start + width)
            part[r[here], a[here] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T  # exact: at most COLUMNS ones
    return out


def _joined(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> set[tuple[int, int]]:
    """Edges that connect the labels of a block's rows as its links do; at most one for each row and column."""
    # Labels spread along links, and between rows of one label, until nothing changes.
    names, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = inverse[: len(left)], inverse[len(left) :]
    least = np.arange(len(names))
    none = len(names)
    while True:
        before = least.copy()
        np.minimum.at(least, x, np.where(links, least[y][None, :], none).min(axis=1, initial=none))
        np.minimum.at(least, y, np.where(links, least[x][:, None], none).min(axis=0, initial=none))
        if np.array_equal(before, least):
            return {(int(names[i]), int(names[j])) for i, j in enumerate(least) if i != j}


def _blocks(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b: edges between labels, from comparing each pivot group's minor rows with all of the group, in blocks.

    `rows` has pivot, node, n, label, home, minor. Pairs of one label, and pairs that have one home elsewhere, are left out.
    """
    sides = lambda of, total: F.ceil(F.greatest(F.sum(F.when(of, F.col("n"))) / BLOCK_SHINGLES, F.sum(F.when(of, 1)) / BLOCK_ROWS)).cast("int").alias(total)
    sized = saved(rows.groupBy("pivot").agg(sides(F.col("minor"), "minors"), sides(F.lit(True), "all")), "blocks")
    spread = rows.join(sized, "pivot")
    hashed = F.xxhash64(F.lit(3), "node")
    cell = lambda left, i, j: F.struct(F.lit(left).alias("left"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_left = F.when(F.col("minor"), F.transform(upto("all"), lambda j: cell(True, F.pmod(hashed, F.col("minors")), j)))
    as_right = F.transform(upto("minors"), lambda i: cell(False, i, F.pmod(hashed, F.col("all"))))
    cells = spread.select("pivot", "node", "label", "home", F.inline(F.concat(F.coalesce(as_left, F.array().cast("array<struct<left:boolean,i:int,j:int>>")), as_right)))

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        pivot = key[0]
        left, right = block[block["left"]], block[~block["left"]]
        of = lambda c: (left[c].to_numpy()[:, None], right[c].to_numpy()[None, :])
        (lx, ly), (hx, hy) = of("label"), of("home")
        wanted = (lx != ly) & ~((hx == hy) & (hx != pivot))
        sizes = [np.array([len(s) for s in side["s"]], np.int64) for side in (left, right)]
        na, nb = sizes[0][:, None], sizes[1][None, :]
        wanted &= 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
        x, y = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        edges: set[tuple[int, int]] = set()
        if len(x):
            inner = shared_counts([left["s"].iloc[i] for i in x], [right["s"].iloc[i] for i in y])
            links = wanted[np.ix_(x, y)] & (100 * inner >= threshold * (na[x] + nb[:, y] - inner))
            if links.any():
                edges = _joined(links, lx[x, 0], ly[0, y])
        return pd.DataFrame(sorted(edges), columns=["a", "b"], dtype="int64")

    return cells.join(sets, "node").groupBy("pivot", "i", "j").applyInPandas(compare, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, words: int, threshold: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) of most links between nodes with different sets, and edges (a, b) between such components.

    Together they connect all that are linked.
    """
    half = nodes.select("node", F.posexplode("halves").alias("i", "h"))
    # Written down, like other sides of joins below that come from an aggregation: Spark splits a hot key only between two shuffles.
    shared = saved(half.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    alive = half.join(shared, "h")
    first = F.col("i") < m
    pair_up = alive.groupBy("node").agg(
        F.collect_list(F.when(first, F.col("h"))).alias("x"), F.collect_list(F.when(~first, F.col("h"))).alias("y"), F.sum("c").alias("central")
    ).filter((F.size("x") > 0) & (F.size("y") > 0))
    pair_up = saved(pair_up.join(nodes.select("node", "same", "n"), "node"), "halves")

    # Sets of the nodes that are left, and how many shingles of each are shared with any other of them.
    texts = _sifted(docs.select(F.col("doc_id").alias("node"), "text", F.xxhash64("text").alias("text_hash")), pair_up.select("node"))
    wanted = texts.join(pair_up.select("node", "same"), "node").dropDuplicates(["node", "text_hash"])
    sets = _sets(wanted.select("node", "same", "text"), words)
    sets = saved(sets, "sets")
    token = sets.select("node", F.explode("s").alias("t"))
    rare = token.groupBy("t").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    members = pair_up.join(rare, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    members = saved(members.drop("alone", "same").filter(100 * F.col("most") >= threshold * F.col("n")), "members")

    # Each bucket's most central member is its pivot; all others are held against it.
    keys = F.flatten(F.transform("x", lambda a: F.transform("y", lambda b: F.xxhash64(a, b))))
    tables = members.select("node", "central", F.explode(keys).alias("key"))
    pivots = saved(tables.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("top.node").alias("pivot")), "pivots")
    stars = tables.select("node", "key").join(pivots, "key").filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    of = lambda c: members.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("most").alias(f"most{c}"))
    stars = saved(stars.join(of("a"), "a").join(of("b"), "b"), "stars")
    could = _reached(F.least("mosta", "mostb"), F.col("na"), F.col("nb"), threshold)
    compared = _compared(stars.filter(could).select("a", "b"), sets).unionByName(stars.filter(~could).select("a", "b", "na", "nb", F.lit(None).cast("long").alias("i")))
    compared = saved(compared, "compared")
    labels = components(compared.filter(_reached(F.col("i"), F.col("na"), F.col("nb"), threshold)).select("a", "b"))

    # Two that share a bucket share its pivot: what is left to compare stands in the pivots' groups, across clusters.
    group = compared.select(F.col("b").alias("pivot"), F.col("a").alias("node"), F.col("na").alias("n"), "i").join(members.select("node", "most"), "node")
    size = saved(group.groupBy("pivot").agg(F.count("*").alias("c")), "groups")
    home = group.select("node", "pivot").join(size, "pivot").groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("top")).select("node", F.col("top.pivot").alias("home"))
    group = saved(group.join(home, "node"), "members-of")

    def mixed(labels: DataFrame) -> DataFrame:
        """Groups with several clusters: each node with its own, and whether it is minor.

        Of two that need to be compared, one at least is minor: outside of the group's largest cluster or, if more of the
        group share another home, not of that home.
        """
        now = group.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        kinds = now.groupBy("pivot", "label").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
        homes = now.filter("home != pivot").groupBy("pivot", "home").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max(F.struct("c", "home")).alias("away"))
        top = saved(kinds.filter("labels > 1").join(homes, "pivot", "left").select("pivot", F.col("top.label").alias("major"), F.when(F.col("away.c") > F.col("top.c"), F.col("away.home")).alias("away")), "majors")
        return now.join(top, "pivot").withColumn("minor", F.when(F.col("away").isNull(), F.col("label") != F.col("major")).otherwise(F.col("home") != F.col("away"))).drop("major", "away")

    def may_link(x: str, y: str):
        """Clusters differ, and the largest possible intersection reaches the threshold: no shingle that a node has alone is
        in it, no shingle of the pivot that either lacks, and at most the lesser number of shingles that the pivot lacks.
        A null i says that the pivot was too different to be compared."""
        c = lambda of, name: F.col(f"{of}.{name}")
        by_pivot = F.least(c(x, "i"), c(y, "i")) + F.least(c(x, "n") - c(x, "i"), c(y, "n") - c(y, "i"))
        most = F.least(c(x, "most"), c(y, "most"), by_pivot)
        return (c(x, "label") != c(y, "label")) & _reached(most, c(x, "n"), c(y, "n"), threshold)

    rest = saved(mixed(labels).filter("home = pivot"), "mixed")
    split = F.pmod(F.xxhash64("node"), F.lit(SPLITS))
    second = saved(rest.groupBy("pivot", split.alias("split")).agg(F.max(F.struct("i", "node", "n", "most", "label")).alias("p")).select("pivot", "p.*"), "second")
    pairs = rest.alias("u").join(second.alias("p"), (F.col("u.pivot") == F.col("p.pivot")) & may_link("u", "p"))
    pairs = pairs.select(F.greatest("u.node", "p.node").alias("a"), F.least("u.node", "p.node").alias("b")).distinct()
    more = _compared(pairs, sets)
    labels = contracted(labels, more.filter(_reached(F.col("i"), F.col("na"), F.col("nb"), threshold)).select("a", "b"))

    # The rest, in blocks; groups without minor rows have nothing left to compare.
    rest = saved(mixed(labels).select("pivot", "node", "n", "label", "home", "minor"), "rest")
    some = saved(rest.filter("minor").select("pivot").distinct(), "open")
    return labels, _blocks(rest.join(some, "pivot"), sets, threshold)


def contracted(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the components of `labels` (node, component), joined by further `edges` (a, b) between nodes.

    Only edges between different components are walked; nodes may be in neither.
    """
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    across = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(across)
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return saved(moved.unionByName(joined.join(labels, "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row with a doc_id.

    Two documents are linked if 100 * intersection >= threshold * union of their sets of `words`-word shingles; a text with
    fewer words is one shingle; a null or empty one has no set and no link. component_id is the least doc_id reachable,
    kept says that it is the row's own. Rows that share a doc_id count as one document, linked with each other. Rows
    without a doc_id are left out: nothing could name them. A miss of all tables has at most the chance `miss` at the
    threshold, less above it.
    """
    m = collections_for(threshold, rows, miss)
    signed = saved(signatures(docs, words, m, rows), "signatures")
    nodes = signed.filter("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    nodes = saved(nodes, "nodes")
    labels, edges = links(docs, nodes, words, threshold, m)
    named = saved(signed.select("doc_id", "n", "same").join(nodes.select("same", "node"), "same", "left").drop("same"), "named")
    # Rows that share an id but not a set have several nodes.
    twins = saved(named.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi"), "twins")
    edges = edges.unionByName(named.join(twins, "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b")))
    labels = contracted(labels, edges)
    component = F.coalesce("component", "node", "doc_id")
    out = named.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns as they are, of one document of each group of near duplicates: its least doc_id.

    Of rows that share that doc_id, the one with the least text stays. Rows without a doc_id stay.
    """
    kept = near_duplicates(docs, **how).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(kept, F.col("row.doc_id") == F.col("kept_id"))
    first = joined.withColumn("nth", F.row_number().over(Window.partitionBy("kept_id").orderBy("row.text"))).filter("nth = 1")
    return first.select("row.*").unionByName(docs.filter("doc_id IS NULL"))
