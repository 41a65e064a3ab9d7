"""Prefix trie of conversations by distributed MSD radix partitioning.

Turns are encoded by a dictionary, and equal sequences of turn ids become one with a count, so that thousands of copies
of a conversation are one row. Buckets of sequences are then partitioned by one turn id after another. A bucket of few
turns, or of one sequence, is local: one task sorts it with a multikey quicksort, whose recursion emits the nodes. Only
larger buckets, which are few, are partitioned again; their nodes are put together from sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezze.llm.common import bounded, saved, scratch_path

#: Turns up to which a bucket is sorted by one task.
LOCAL_TURNS = 16_384
#: Large buckets of a round up to which they are broadcast; more of them are joined by a shuffle.
LARGE = 100_000
#: Members that are hashed as one chunk.
CHUNK = 65_536
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256().hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, chars: each conversation's turns in order, as dictionary ids and code points of their texts.

    Turns are ordered by `turn`, null first, and equal ones by the digest of role and text, so that a rerun gives the same
    sequence; ids are in the order of digests. A null role or text is an empty one. Repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation. A conversation's ids meet in one row: 16 bytes for each turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = saved(conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars")), "turns")
    distinct = turns.select("digest").distinct().repartitionByRange("digest").sortWithinPartitions("digest")
    dictionary = saved(distinct.select("digest", F.monotonically_increasing_id().alias("id")), "turn-ids")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id", "chars")))
    whole = turns.join(dictionary, "digest").groupBy("conv_id").agg(ordered.alias("turns"))
    return whole.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def grafted(rows: DataFrame, donor, n_turns, most: int) -> DataFrame:
    """The sequences with their first `n_turns` turns replaced by as many of the conversation `donor`; both are columns.

    A donor with fewer turns gives all it has, an absent one none. `most` bounds `n_turns`.
    """
    rows = rows.withColumn("donor", donor).withColumn("n_turns", n_turns)
    heads = rows.select(F.col("conv_id").alias("donor"), *[F.slice(c, 1, most).alias(f"head_{c}") for c in ("ids", "chars")])

    def joined(c: str):
        head = F.coalesce(F.col(f"head_{c}"), F.array().cast("array<long>"))
        return F.concat(F.slice(head, F.lit(1), F.col("n_turns").cast("int")), F.slice(c, F.col("n_turns").cast("int") + 1, F.size(c) + 1)).alias(c)

    return rows.join(heads, "donor", "left").select("conv_id", joined("ids"), joined("chars"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key's members, in order, as texts of joined decimal ids."""
    key, members = None, []
    chunk = lambda: pa.record_batch([pa.array([key], pa.binary()), pa.array([members[0]], pa.int64()), pa.array([",".join(map(str, members))], pa.string())], names=["key", "first", "said"])
    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if members and (k != key or len(members) >= CHUNK):
                yield chunk()
                members = []
            key = k
            members.append(conv)
    if members:
        yield chunk()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key over its chunks in order."""
    key, digest = None, None
    done = lambda: pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends"])
    for batch in batches:
        for k, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is None or k != key:
                if digest is not None:
                    yield done()
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(said.encode())
    if digest is not None:
        yield done()


def _members(rows: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of each key's conv_ids, ascending, joined by commas; a key's members are never held whole."""
    sorted_ = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = sorted_.mapInArrow(_chunks, "key binary, first long, said string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "said").mapInArrow(_digests, "key binary, ends string")


def multikey_nodes(bucket: list[tuple], depth: int, parent: int) -> list[list]:
    """Nodes of a bucket whose sequences share their first `depth` turns; `parent` is the conv_id of the node above.

    A sequence is (ids, chars, conv_id, count, digest of its members), all different. The quicksort partitions by the
    turn at the segment's depth into less, equal and more; an equal part is a node. Rows are as NODE has them.
    """
    nodes: list[list] = []

    def emit(segment: list[tuple], depth: int, above: int | None) -> int:
        n, chars = sum(s[3] for s in segment), segment[0][1][depth - 1]
        nodes.append([min(s[2] for s in segment), depth, parent if above is None else nodes[above][0], n, 0, 0, (n - 1) * chars, _NONE, above])
        if above is not None:
            nodes[above][4] += 1
        return len(nodes) - 1

    todo = [(bucket, depth, emit(bucket, depth, None))]
    while todo:
        segment, depth, at = todo.pop()
        if len(segment) == 1:
            for below in range(depth, len(segment[0][0])):
                at = emit(segment, below + 1, at)
            nodes[at][7] = segment[0][4]
            continue
        turn = [s[0][depth] if len(s[0]) > depth else -1 for s in segment]
        pivot = sorted((turn[0], turn[len(turn) // 2], turn[-1]))[1]
        less = [s for s, t in zip(segment, turn) if t < pivot]
        same = [s for s, t in zip(segment, turn) if t == pivot]
        more = [s for s, t in zip(segment, turn) if t > pivot]
        todo += [(part, depth, at) for part in (more, less) if part]
        if pivot == -1:
            nodes[at][7] = same[0][4]
        else:
            todo.append((same, depth + 1, emit(same, depth + 1, at)))
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[8] is not None:
            above = nodes[node[8]]
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def _sorted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Nodes of all buckets of a partition, which come one after another; `depth` turns are common to a bucket."""
    schema = pa.schema([(name, pa.string() if name == "ends_sha256" else pa.int64()) for name in (c.split()[0] for c in NODE.split(", "))])
    bucket, key, out = [], None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for above, turn, ids, chars, conv, n, ends in zip(*columns):
            if bucket and key != (above, turn):
                out += multikey_nodes(bucket, depth, key[0])
                bucket = []
                if len(out) > 8192:
                    yield pa.record_batch(list(zip(*[x[:8] for x in out])), schema=schema)
                    out = []
            key = (above, turn)
            bucket.append((ids, chars, conv, n, ends))
    if bucket:
        out += multikey_nodes(bucket, depth, key[0])
    if out:
        yield pa.record_batch(list(zip(*[x[:8] for x in out])), schema=schema)


def trie(rows: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes (NODE) of the trie of `rows`: conv_id (unique), ids, chars. No rows, no nodes, not even a root.

    conv_id and depth name a node. A round goes one turn deeper in all buckets of more than `local_turns` turns; what it
    makes is written to the shared folder, so there are as many rounds as turns that such buckets share.
    """
    spark = rows.sparkSession
    keyed = saved(rows.select("conv_id", "ids", "chars", F.unhex(F.sha2(F.array_join("ids", ","), 256)).alias("key")), "sequences")
    distinct = keyed.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("ids").alias("ids"), F.first("chars").alias("chars"))
    state = saved(distinct.join(_members(keyed), "key").drop("key"), "distinct-sequences")
    path = {kind: scratch_path(spark, f"trie-{kind}") for kind in ("nodes", "large", "ended")}

    def put(df: DataFrame, kind: str, depth: int) -> None:
        df.write.option("compression", "zstd").parquet(f"{path[kind]}/{depth}")

    root = state.agg(F.min("conv"), F.sum("n")).first()
    if root[0] is None:
        return spark.createDataFrame([], NODE)
    large = "conv_id long, depth long, parent_conv_id long, n_convs long, chars long, above array<long>"
    put(spark.createDataFrame([(root[0], 0, None, root[1], 0, [])], large), "large", 0)
    read_large = lambda at: spark.read.schema(large).parquet(f"{path['large']}/{at}")
    state, depth = state.withColumn("bucket", F.lit(root[0]).cast("long")), 0
    while True:
        put(state.filter(F.size("ids") == depth).select(F.col("bucket").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), "ends"), "ended", depth)
        longer = state.filter(F.size("ids") > depth).withColumn("turn", F.get("ids", F.lit(depth)))
        counts = longer.groupBy("bucket", "turn").agg(F.min("conv").alias("child"), F.sum("n").alias("n_convs"), F.max(F.get("chars", F.lit(depth))).alias("last"), F.count("*").alias("n_sequences"), F.sum(F.size("ids") - depth).alias("turns"))
        big = saved(counts.filter((F.col("n_sequences") > 1) & (F.col("turns") > local_turns)), "trie-buckets")
        none = big.isEmpty()
        marked = longer if none else saved(longer.join(bounded(big.select("bucket", "turn", "child"), LARGE), ["bucket", "turn"], "left"), "trie-rows")
        local = marked if none else marked.filter("child IS NULL")
        by = ("bucket", "turn")
        grouped = local.select(*by, "ids", "chars", "conv", "n", "ends").repartition(*by).sortWithinPartitions(*by)
        put(grouped.mapInArrow(lambda batches, d=depth + 1: _sorted(batches, d), NODE), "nodes", depth + 1)
        if none:
            break
        up = read_large(depth).select(F.col("conv_id").alias("bucket"), F.concat("above", F.array("conv_id")).alias("above"))
        put(big.join(up, "bucket").select(F.col("child").alias("conv_id"), F.lit(depth + 1).cast("long").alias("depth"), F.col("bucket").alias("parent_conv_id"), "n_convs", F.col("last").alias("chars"), "above"), "large", depth + 1)
        state, depth = marked.filter("child IS NOT NULL").drop("bucket", "turn").withColumnRenamed("child", "bucket"), depth + 1
    nodes, upper = spark.read.schema(NODE).parquet(f"{path['nodes']}/*"), read_large("*")
    ended = spark.read.schema("conv_id long, depth long, ends string").parquet(f"{path['ended']}/*")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    part = lambda df, conv, depth, children, leaves, tokens: df.select(conv.alias("conv_id"), depth.alias("depth"), children.alias("n_children"), leaves.alias("leaves"), tokens.alias("tokens"))
    up = (F.col("parent_conv_id"), F.col("depth") - 1)
    known = upper.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    tops = nodes.join(known, ["parent_conv_id", "depth"], "left_semi")
    sums = part(tops, *up, one, F.col("n_leaves"), F.col("saved_tokens")).unionByName(part(upper.filter("depth > 0"), *up, one, zero, zero)).unionByName(part(upper, F.col("conv_id"), F.col("depth"), zero, zero, (F.col("n_convs") - 1) * F.col("chars")))
    own = sums.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("n_children", "leaves", "tokens")])
    own = own.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")))
    whole = saved(upper.join(own, ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left"), "trie-large")
    line = whole.select("leaves", "tokens", F.posexplode(F.concat("above", F.array("conv_id"))).alias("depth", "conv_id"))
    totals = line.groupBy("conv_id", F.col("depth").cast("long").alias("depth")).agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))
    top = whole.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))
    return nodes.unionByName(top)
