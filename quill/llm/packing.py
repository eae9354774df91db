"""Best-fit packing with exact complements.

Documents become pieces of at most ``size`` tokens (only longer ones are cut;
the first piece takes the remainder).  What matters for packing is how many
pieces there are of each length: a table of at most ``size`` counts, which
comes to the driver whatever the corpus.  The plan is made on those counts:

1. Exact complements.  An index holds the sums of one, two and three lengths by
   their value.  Going down the lengths, a piece opens a sequence and leaves a
   gap; a combination indexed under that gap is consumed as often as the counts
   allow, and entries whose lengths have run out leave the index.  Singles come
   first, then pairs, then triples; of several the one whose largest member is
   largest, as long pieces are the hardest to place.
2. Best fit for the rest: each further piece, longest first, goes to the open
   sequence with the smallest sufficient gap.  Both steps work on classes of
   equal sequences, so their cost depends on ``size`` and not on the corpus.

The plan says, for runs of ranks within one length, which sequences they fill
and where.  Ranks are dealt in parallel: pieces of a length are counted by
hashed buckets, a prefix sum over the counts gives each bucket its first rank,
and a bucket (about ``BUCKET_ROWS`` pieces, however many share a length)
numbers its own pieces.

Defined results: null and empty texts have one piece that is the end id alone;
rows repeated with one id are packed each (their pieces repeat too); ties
between equal lengths are settled by hash, id and piece; an empty table gives
no piece; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.common import written
from quill.llm.tokens import tokenizer

SIZE = 2048
END_ID = 0
BUCKET_ROWS = 2_000


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``total`` ids; the first may be shorter."""
    first = total % size or min(total, size)
    return [(0, first), *((at, size) for at in range(first, total, size))]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, tie)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([END_ID], "<u4").tobytes()
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            ids = batch.column("id")
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (encode(text) if text else b"") + end
                for k, (start, length) in enumerate(cuts(len(raw) // 4, size)):
                    for column, value in zip(rows, (i, k, start, length, zlib.crc32(
                            raw[4 * start:4 * (start + length)]), zlib.crc32(raw[-4096:])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 *(pa.array(r, pa.int64()) for r in rows[2:])],
                ["id", "piece", "start", "length", "ids_crc32", "tie"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, tie long")


class _Sums:
    """How many pieces of each length are left, and an index of the sums of one, two and three of them.

    A pair stands under its sum by its larger member, a triple by its largest;
    the other two of a triple are a pair of the index.  Counts only fall, so an
    entry that has run out is dropped for good.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = [0] * (size + 1)
        for length, n in counts.items():
            self.left[length] += n
        there = np.asarray(self.left) > 0
        lengths = np.flatnonzero(there).astype(np.int32)
        self.pairs: list[array] = []
        self.triples: list[array] = []
        for total in range(size + 1):
            larger = lengths[(2 * lengths >= total) & (lengths < total)]
            self.pairs.append(array("i", larger[there[total - larger]].tobytes()))
            self.triples.append(array("i", lengths[(3 * lengths >= total) & (lengths <= total - 2)].tobytes()))

    def take(self, parts: tuple[int, ...], times: int) -> None:
        for p in parts:
            self.left[p] -= times

    def times(self, parts: tuple[int, ...]) -> int:
        """How often the counts allow a combination."""
        return min(self.left[p] // parts.count(p) for p in parts)

    def _pair(self, total: int, most: int, beside: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """The pair of a sum whose larger member is largest and at most ``most``, with one more piece ``beside`` it."""
        found = self.pairs[total]
        for at in range(bisect_right(found, most) - 1, -1, -1):
            pair = (found[at], total - found[at])
            if not self.times(pair):
                del found[at]
            elif not beside or self.times((*beside, *pair)):
                return pair
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is exactly the gap."""
        if self.left[gap] > 0:
            return (gap,)
        pair = self._pair(gap, gap - 1)
        if pair:
            return pair
        largest = self.triples[gap]
        while largest:
            a = largest[-1]
            pair = self._pair(gap - a, a, (a,)) if self.left[a] else None
            if pair:
                return (a, *pair)
            largest.pop()
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths in a sequence, number of such sequences)`` for the given counts of lengths."""
    c = _Sums(counts, size)
    done: list[tuple[tuple[int, ...], int]] = []
    if c.left[size]:
        done.append(((size,), c.left[size]))
        c.left[size] = 0
    for length in range(size - 1, 0, -1):
        while c.left[length] > 0:
            c.left[length] -= 1
            found = c.filling(size - length)
            c.left[length] += 1
            if not found:
                break
            parts = (length, *found)
            times = max(1, c.times(parts))
            c.take(parts, times)
            done.append((parts, times))
    # Best fit on classes of equal open sequences: gap -> [(lengths, number)].
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def add(parts: tuple[int, ...], n: int) -> None:
        gap = size - sum(parts)
        if gap == 0:
            done.append((parts, n))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((parts, n))

    for length in range(size - 1, 0, -1):
        todo = c.left[length]
        while todo:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = size // length
                if todo >= each:
                    add((length,) * each, todo // each)
                if todo % each:
                    add((length,) * (todo % each), 1)
                break
            gap = gaps[at]
            parts, n = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            used = min(n, todo)
            if n > used:
                add(parts, n - used)
            add((*parts, length), used)
            todo -= used
    return done + [x for xs in open_.values() for x in xs]


def _runs(made: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple]:
    """For each length: first rank of each run, its first sequence and its place in the sequence."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
    used = [0] * (size + 1)
    sequence = 0
    for parts, n in made:
        at = 0
        for p in parts:
            runs[p].append((used[p], sequence, at))
            used[p] += n
            at += p
        sequence += n
    return [tuple(np.asarray(x, np.int64) for x in zip(*r, strict=True)) if r else () for r in runs]


def ranked(cut: DataFrame, rows: int) -> DataFrame:
    """``cut`` with ``rank`` from 0 within each length; no task gets a whole hot length."""
    buckets = max(1, rows // BUCKET_ROWS)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "tie"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("length", "bucket", (
        F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    return (keyed.withColumn("at", F.row_number().over(own) - 1).join(first, ["length", "bucket"])
            .withColumn("rank", F.col("first") + F.col("at")).drop("bucket", "at", "first", "tie"))


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, size, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_runs(plan(counts, size), size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                own = length == one
                starts, sequences, places = runs.value[one]
                k = np.searchsorted(starts, rank[own], "right") - 1
                sequence[own], offset[own] = sequences[k] + rank[own] - starts[k], places[k]
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    return ranked(cut, sum(counts.values())).mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
