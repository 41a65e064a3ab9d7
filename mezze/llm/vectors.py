"""Vector codes: a product quantiser on integers whose nearest entries are found by partial-distance search.

Vectors are cut into equal parts; every part position has a codebook. A part's distance to the entries of its codebook
grows one dimension at a time, in descending order of the codebook's variance; masks drop an entry as soon as its sum
strictly exceeds the best complete distance so far. All arithmetic is on integers, so results do not depend on the order
of rows or tasks. A round of training is one pass over the vectors with a broadcast codebook (entries x dimensions
numbers, whatever the number of vectors); sums per entry meet in an aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezze.llm.common import bounded, saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that are held against a block of parts at a time; later blocks meet a better best distance.
ENTRY_BLOCK = 16
#: Vectors whose distances are worked out at a time: ENTRY_BLOCK sums for each.
ROW_BLOCK = 8192
#: Labels up to which their errors are broadcast; more of them are joined by a shuffle.
LABELS = 100_000
_LONG = (1 << 63) - 1
#: Sums leave a task as digits to this base, so that components of any size add up exactly in longs.
_BASE = 1 << 40
_DIGITS = 5


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry]: a tuple of `width` integers. Every part has as many entries; none where no vector was kept."""

    width: int
    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def kept(vectors: DataFrame) -> DataFrame:
    """The rows whose embedding is there and has neither null nor non-finite components; an empty one is kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.filter(F.coalesce(finite, F.lit(False)))


def _integer(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 52 else floor(x * SCALE)


def _block(vectors: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors as integers, [row, part, position], filled up with zeros: long where they fit, else Python's integers."""
    vectors = vectors.flatten() if pa.types.is_fixed_size_list(vectors.type) else vectors
    ends, flat = vectors.offsets.to_numpy(), np.asarray(vectors.values.to_numpy(zero_copy_only=False), np.float64)
    small = len(flat) == 0 or np.abs(flat[ends[0] : ends[-1]]).max(initial=0) < 1 << 30
    out = np.zeros((len(vectors), parts * width), np.int64 if small else object)
    for n in np.unique(np.diff(ends)):
        rows = np.flatnonzero(np.diff(ends) == n)
        values = flat[ends[rows][:, None] + np.arange(n)]
        out[rows, :n] = np.floor(values * SCALE).astype(np.int64) if small else [[_integer(x) for x in row] for row in values.tolist()]
    return out.reshape(len(vectors), parts, width)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of `book` for each of `points`, ties to the lower index, and the squared distance.

    Both are matrices of integers, of longs where no sum can leave a long. The first dimension gives a guess whose
    complete distance is the first best.
    """
    n, width = points.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int64 if width * (2 * most) ** 2 <= _LONG else object
    points, book = points.astype(kind), book.astype(kind)
    spread = [len(book) * int(sum(int(x) ** 2 for x in column)) - int(sum(int(x) for x in column)) ** 2 for column in book.T]
    order = sorted(range(width), key=lambda d: (-spread[d], d))
    first = order[0]
    by_first = np.argsort(book[:, first], kind="stable")
    place = np.searchsorted(book[by_first, first], points[:, first]).clip(0, len(book) - 1)
    at = by_first[place]
    best = ((points - book[at]) ** 2).sum(axis=1)
    for low in range(0, len(book), ENTRY_BLOCK):
        entries = book[low : low + ENTRY_BLOCK]
        partial = (points[:, first, None] - entries[:, first]) ** 2
        rows, columns = np.nonzero(partial <= best[:, None])
        partial = partial[rows, columns]
        for d in order[1:]:
            partial = partial + (points[rows, d] - entries[columns, d]) ** 2
            alive = partial <= best[rows]
            rows, columns, partial = rows[alive], columns[alive], partial[alive]
        closer = best.copy()
        np.minimum.at(closer, rows, partial)
        at[closer < best] = len(book)
        reached = partial == closer[rows]
        np.minimum.at(at, rows[reached], columns[reached] + low)
        best = closer
    return at, best


def _assigned(batches, parts: int, books: Codebooks):
    """For each block of vectors: the other columns, the integers, and index and distance by [part, row]."""
    arrays = [np.array(part, object).reshape(len(part), books.width) for part in books.entries]
    arrays = [a.astype(np.int64) if all(abs(x) <= _LONG for x in a.flat) else a for a in arrays]
    for batch in batches:
        for low in range(0, batch.num_rows, ROW_BLOCK):
            piece = batch.slice(low, ROW_BLOCK)
            points = _block(piece.column(0), parts, books.width)
            found = [nearest(points[:, p], arrays[p]) for p in range(parts)]
            yield piece, points, found


def _moved(vectors: DataFrame, parts: int, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of its parts' mean; an entry without parts stays."""
    entries = len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, books.width), object), np.zeros((parts, entries), np.int64)
        for _, points, found in _assigned(batches, parts, books):
            for p, (at, _) in enumerate(found):
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                used = at[order][starts]
                sums[p, used] += np.add.reduceat(points[order, p], starts, axis=0)
                counts[p, used] += np.diff(starts, append=len(order))
        used = np.argwhere(counts > 0)
        digits = [[[(int(x) // _BASE**k) % _BASE if k < _DIGITS - 1 else int(x) // _BASE**k for x in sums[p, e] for k in range(_DIGITS)]] for p, e in used]
        if len(used):
            yield pa.record_batch([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array([int(counts[p, e]) for p, e in used], pa.int64()), pa.array([d[0] for d in digits], pa.list_(pa.int64()))], names=["part", "entry", "n", "digits"])

    partial = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, digits array<long>")
    digit = F.posexplode(F.when(F.size("digits") > 0, F.col("digits")).otherwise(F.array(F.lit(0).cast("long"))))
    by_digit = partial.select("part", "entry", "n", digit.alias("at", "digit")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("digit").alias("digit"))
    new = [[list(e) for e in part] for part in books.entries]
    got: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    for r in by_digit.collect():  # as many rows as the codebooks have digits
        got.setdefault((r["part"], r["entry"]), {})[r["at"]] = (r["digit"], r["n"])
    for (p, e), by in got.items():
        new[p][e] = [sum(by[i * _DIGITS + k][0] * _BASE**k for k in range(_DIGITS)) // by[0][1] for i in range(books.width)]
    return Codebooks(books.width, tuple(tuple(tuple(e) for e in part) for part in new))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the vectors with the smallest vec_ids and move `rounds` times, over all kept vectors.

    Equal vec_ids are ordered by their vectors, null ones come last. Vectors of unequal lengths are filled up with zeros
    to the longest, rounded up to whole parts. Without a kept vector there are no entries.
    """
    rows = kept(vectors.select("vec_id", "embedding"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    whole = [[_integer(x) for x in r["embedding"]] + [0] * (parts * width - len(r["embedding"])) for r in first]
    books = Codebooks(width, tuple(tuple(tuple(v[p * width : (p + 1) * width]) for v in whole) for p in range(parts)))
    for _ in range(rounds if first else 0):
        books = _moved(rows, parts, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of the kept rows less their embedding, and codes (array of int, one for each part), code, error.

    code: two hexadecimal digits for each index. error: squared distances in integers, summed over the parts; one beyond
    a long stands as the largest long. Columns called codes, code or error give way. An empty table gives no rows.
    """
    parts = len(books.entries)
    carried = [c for c in vectors.columns if c not in ("embedding", "codes", "code", "error")]
    rows = kept(vectors).select("embedding", *[F.col(f"`{c}`") for c in carried])
    if not books.entries[0]:
        none = F.lit(None)
        return rows.filter(F.lit(False)).select(*carried, none.cast("array<int>").alias("codes"), none.cast("string").alias("code"), none.cast("long").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, found in _assigned(batches, parts, books):
            codes = np.stack([at for at, _ in found], axis=1)
            errors = sum(d.astype(object) for _, d in found)
            code = ["".join(f"{i:02x}" for i in row) for row in codes.tolist()]
            added = [pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(code, pa.string()), pa.array([min(int(e), _LONG) for e in errors], pa.int64())]
            yield pa.record_batch([*piece.columns[1:], *added], names=[*carried, "codes", "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}{', ' * bool(carried)}codes array<int>, code string, error long")


def decode(encoded: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of `encoded`, and `embedding`: the vector that the codes stand for, as doubles."""
    entry = lambda part: F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in part])
    whole = [F.get(entry(part), F.get("codes", F.lit(p))) for p, part in enumerate(books.entries)]
    return encoded.withColumn("embedding", F.concat(*whole))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, codes, code, error, label_error, codebooks_sha256: one row for each kept row, repeated rows too.

    label_error is the sum of error over equal labels, null labels together; one beyond a long stands as the largest long.
    """
    books = train(vectors, parts, entries, rounds)
    coded = saved(encode(vectors.select("vec_id", "label", "embedding"), books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = saved(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    joined = coded.join(bounded(by_label, LABELS), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "codes", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
