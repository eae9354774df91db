"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``TREES`` trees gives a vector a long hash string: ``CHARS`` characters,
each the nearest axis (with sign) after a random rotation of the centred
vector, written in bits.  A tree is the array of all strings in order.  A query
descends every tree by its own string and by ``PROBES - 1`` more that begin
with its next nearest axes, to the longest prefix that matches in any of them,
and then ascends in all trees at once, a bit at a time, until enough vectors
match.  Matches are counted in the sample's sorted arrays, which stand for the
trees' upper parts; the number to reach is the least with which the ascent finds
``TARGET`` of the sample's true neighbours, and so many that ``LEAST`` vectors
of the whole table are expected to match.  Queries among many vectors thus stop
at long prefixes and lonely ones at short.  All vectors of the table that share
a prefix of that length in any tree are candidates, and their distances are
computed exactly, in double precision, on the original vectors.

Equal vectors are collapsed first: of each, the ``k + 1`` smallest ids are all
that a result can need.  The sorted arrays are cut into ranges of about
``RANGE`` rows at quantiles of the sample; strings that fill several ranges are
dealt over them by hash.  A query visits the ranges its prefixes reach, and each
task returns the best ``k + 1`` of its range.

Bounded sample (documented parameter): ``SAMPLE`` distinct vectors, the first in
hash order, fit the centre, the ranges and the number of matches; every row is indexed.

Defined results: null and zero vectors, and those with null or non-finite
components, take no part; nor do vectors whose length is not the most frequent
one (of several, the largest); ties in distance go to the smaller id; with fewer
candidates than ``k`` all are returned; rows of one id and vector count once;
rows with a null id take no part; an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quill.llm.common import written

TREES = 12
CHARS = 4
PROBES = 6
SAMPLE = 10_000
TRIALS = 300
TARGET = 0.95
LEAST = 100
RANGE = 10_000
SEED = 41


def usable(vec: Column) -> Column:
    return (vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0))


@dataclass
class Forest:
    """Rotations and what the sample fitted."""

    centre: np.ndarray
    rotations: np.ndarray  # trees x chars x dim x dim
    bits: int
    matches: int  # in the sample, over all trees and probes
    rows: int
    sample: np.ndarray  # trees x sample, sorted keys
    ranges: int

    @property
    def length(self) -> int:
        return self.bits * self.rotations.shape[1]

    def strings(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """Hash strings as integers: rows x trees x probes; the first probe is the vector's own string."""
        x = x.astype(np.float64) - self.centre
        n, trees = len(x), len(self.rotations)
        keys = np.zeros((n, trees, probes), np.int64)
        for t in range(trees):
            for c in range(self.rotations.shape[1]):
                turned = x @ self.rotations[t, c]
                size = np.abs(turned)
                if c == 0 and probes > 1:
                    axis = np.argsort(-size, axis=1, kind="stable")[:, :probes]
                else:
                    axis = np.broadcast_to(size.argmax(1)[:, None], (n, probes))
                sign = np.take_along_axis(turned, axis, 1) > 0
                keys[:, t] = (keys[:, t] << self.bits) | (axis * 2 + sign)
        return keys

    def bounds(self, tree: int) -> np.ndarray:
        """Keys at which the ranges of a tree begin, without the first."""
        at = np.arange(1, self.ranges) * self.sample.shape[1] // self.ranges
        return self.sample[tree][at]

    def spans(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last key with the given prefix lengths in common."""
        free = self.length - level
        low = (keys >> free) << free
        return low, low + (1 << free) - 1

    def longest(self, keys: np.ndarray) -> np.ndarray:
        """For each query (rows x trees x probes) its longest prefix that matches in any tree of the sample."""
        out = np.zeros(len(keys), np.int64)
        for t in range(keys.shape[1]):
            own, tree = keys[:, t], self.sample[t]
            at = np.searchsorted(tree, own)
            for near in (tree[np.maximum(at - 1, 0)], tree[np.minimum(at, len(tree) - 1)]):
                out = np.maximum(out, (self.length - np.frexp((own ^ near).astype(np.float64))[1]).max(1))
        return out

    def matched(self, keys: np.ndarray, inside: np.ndarray, level: int) -> np.ndarray:
        """Matches of each query in the sample at a prefix length, over all trees and probes.

        Queries that are ``inside`` the sample don't count themselves.
        """
        found = np.zeros(len(keys), np.int64)
        for t in range(keys.shape[1]):
            tree = self.sample[t]
            low, high = self.spans(keys[:, t], level)
            found += (np.searchsorted(tree, high, "right") - np.searchsorted(tree, low, "left")).sum(1)
            itself = (low <= keys[:, t, :1]) & (keys[:, t, :1] <= high)
            found -= np.where(inside, itself.sum(1), 0)
        return found

    def levels(self, keys: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """For each query the prefix length at which its ascent from the longest match ends."""
        need = max(self.matches, -(-LEAST * self.sample.shape[1] // max(self.rows, 1)))
        out = self.longest(keys)
        for level in range(int(out.max(initial=0)), 0, -1):
            here = np.flatnonzero(out == level)
            out[here[self.matched(keys[here], inside[here], level) < need]] = level - 1
        return out


def fit(sample: np.ndarray, rows: int, k: int, seed: int = SEED) -> Forest:
    """The forest of a sample of distinct vectors, for a table of ``rows`` of them."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    turns = np.stack([[np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(CHARS)] for _ in range(TREES)])
    forest = Forest(sample.astype(np.float64).mean(0), turns, max(1, int(np.ceil(np.log2(2 * dim)))), 0, rows,
                    np.zeros((TREES, 1), np.int64), max(1, -(-rows // RANGE)))
    probes = min(PROBES, dim)
    own = forest.strings(sample)[:, :, 0]
    forest.sample = np.sort(own.T, axis=1)
    # The least number of matches with which the ascent finds enough of the sample's true neighbours.
    trial = np.arange(0, len(sample), max(1, len(sample) // TRIALS))
    x, q = sample.astype(np.float64), sample[trial].astype(np.float64)
    far = (q ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * q @ x.T
    far[np.arange(len(trial)), trial] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    if near.size:
        asked = forest.strings(sample[trial], probes)
        apart = own[near][:, :, :, None] ^ asked[:, None]
        best = (forest.length - np.frexp(apart.astype(np.float64))[1]).max(axis=(2, 3))
        every = np.ones(len(trial), bool)
        found = np.stack([forest.matched(asked, every, level) for level in range(forest.length, -1, -1)], axis=1)
        low, high = 0, int(found.max())
        while low < high:
            middle = (low + high) // 2
            ends = forest.length - (found >= middle).argmax(1)
            ends[(found < middle).all(1)] = 0
            if (best >= ends[:, None]).mean() >= TARGET:
                high = middle
            else:
                low = middle + 1
        forest.matches = low
    return forest


def _deal(forest: Forest, sampled: np.ndarray, dim: int) -> callable:
    probes = min(PROBES, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [forest.bounds(t) for t in range(TREES)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vec = part.column("vec")
                x = np.asarray(vec.flatten()).reshape(-1, dim)
                rep, salt = np.asarray(part.column("rep")), np.asarray(part.column("salt"))
                own = forest.strings(x)[:, :, 0]
                rows = {"tree": [], "range": [], "row": [], "key": [], "level": [], "probes": []}

                def add(tree: int, ranges: np.ndarray, row: np.ndarray, key: np.ndarray, level: np.ndarray,
                        probe: list, rows=rows) -> None:
                    rows["tree"].append(np.full(len(row), tree))
                    for name, value in (("range", ranges), ("row", row), ("key", key), ("level", level)):
                        rows[name].append(value)
                    rows["probes"] += probe

                every = np.arange(len(rep))
                for t in range(TREES):
                    first = np.searchsorted(bounds[t], own[:, t], "left")
                    last = np.searchsorted(bounds[t], own[:, t], "right")
                    add(t, first + salt % (last - first + 1), every, own[:, t], np.full(len(rep), -1), [None] * len(rep))
                asks = np.flatnonzero(np.asarray(part.column("asks")))
                if len(asks):
                    keys = forest.strings(x[asks], probes)
                    levels = forest.levels(keys, np.isin(rep[asks], sampled))
                    for i, row in enumerate(asks):
                        for t in range(TREES) if levels[i] else (0,):
                            low, high = forest.spans(keys[i, t], int(levels[i]))
                            a, b = np.searchsorted(bounds[t], low, "left"), np.searchsorted(bounds[t], high, "right")
                            reach = np.unique(np.concatenate([np.arange(p, q + 1) for p, q in zip(a, b, strict=True)]))
                            n = len(reach)
                            add(t, reach, np.full(n, row), np.full(n, keys[i, t, 0]), np.full(n, levels[i]),
                                [keys[i, t].tolist()] * n)
                row = np.concatenate(rows["row"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(rows["tree"]).astype(np.int32)),
                    pa.array(np.concatenate(rows["range"]).astype(np.int32)), pa.array(rep[row]),
                    pa.array(np.concatenate(rows["key"])), pa.array(np.concatenate(rows["level"]).astype(np.int32)),
                    pa.array(rows["probes"], pa.list_(pa.int64())), vec.take(pa.array(row))],
                    ["tree", "range", "rep", "key", "level", "probes", "vec"])

    return run


def _search(forest: Forest, dim: int, k: int, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        level = np.asarray(table.column("level"))
        rep, key = np.asarray(table.column("rep")), np.asarray(table.column("key"))
        vec = np.asarray(table.column("vec").combine_chunks().flatten()).reshape(-1, dim)
        mine = np.flatnonzero(level < 0)
        mine = mine[np.lexsort((rep[mine], key[mine]))]
        keys, reps, own = key[mine], rep[mine], vec[mine].astype(np.float64)
        probes = table.column("probes")
        out: list[list] = [[], [], []]
        for at in np.flatnonzero(level >= 0):
            low, high = forest.spans(np.asarray(probes[int(at)].as_py(), np.int64), int(level[at]))
            a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            found = np.zeros(len(keys), bool)
            for p, q in zip(a, b, strict=True):
                found[p:q] = True
            found = np.flatnonzero(found)
            far = np.sqrt(((own[found] - vec[at].astype(np.float64)) ** 2).sum(1))
            best = np.lexsort((reps[found], far))[:k + 1]
            out[0] += [int(rep[at])] * len(best)
            out[1] += reps[found][best].tolist()
            out[2] += far[best].tolist()
        return pa.table({"query": out[0], "rep": out[1], "far": out[2]}, schema=schema)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
           vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other rows found for each query, nearest first.

    ``is_query`` is a condition on the id column.
    """
    spark = vectors.sparkSession
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks")) \
        .filter(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = asked.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("dim")).limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["dim"]
    rows = asked.filter(F.size("vec") == dim).withColumn("vec", F.expr("transform(vec, x -> x + cast(0 as float))"))

    # Equal vectors: the smallest ids, pruned before the shuffle by Spark's group limit.
    order = Window.partitionBy("vec").orderBy("id")
    some = rows.select("id", "vec").distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    groups = written(some.groupBy("vec").agg(
        F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members")), "vectors")
    queries = written(rows.filter("asks").select("id", "vec").distinct().join(groups.select("vec", "rep"), "vec")
                      .select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "queries")
    n = groups.count()
    sample = groups.select("vec", F.xxhash64(F.lit(seed), "rep").alias("o"), "rep").orderBy("o", "rep").limit(
        SAMPLE).select("vec", "rep").toArrow()
    points = np.asarray(sample.column("vec").combine_chunks().flatten()).reshape(-1, dim)
    forest = spark.sparkContext.broadcast(fit(points, n, k, seed))
    sampled = spark.sparkContext.broadcast(np.asarray(sample.column("rep")))

    asking = queries.select(F.col("query").alias("rep")).distinct().withColumn("a", F.lit(True))
    marked = groups.select("rep", "vec").join(asking, "rep", "left").select(
        "rep", "vec", F.coalesce("a", F.lit(False)).alias("asks"),
        F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).alias("salt"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _deal(forest.value, sampled.value, dim)(batches)

    kind = dict(groups.dtypes)["vec"]
    dealt = marked.mapInArrow(
        deal, f"tree int, range int, rep long, key long, level int, probes array<long>, vec {kind}")
    found = T.StructType([T.StructField("query", T.LongType()), T.StructField("rep", T.LongType()),
                          T.StructField("far", T.DoubleType())])
    schema = to_arrow_schema(found)

    def look(table: pa.Table) -> pa.Table:
        return _search(forest.value, dim, k, schema)(table)

    hits = written(dealt.groupBy("tree", "range").applyInArrow(look, found), "hits")
    nearest = Window.partitionBy("query").orderBy("far", "rep")
    best = hits.distinct().withColumn("at", F.row_number().over(nearest)).filter(F.col("at") <= k + 1)
    each = best.join(groups.select("rep", "members"), "rep").select(
        "query", "far", F.explode("members").alias("vec_id"))
    first = each.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("far", "vec_id"))).filter(
        F.col("at") <= k + 1)
    lists = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("far", "vec_id"))).alias("all"))
    # A query's own row is among the first k + 1, or k others are as near and smaller.
    own = queries.join(lists, "query").select("query_id", F.posexplode(F.slice(F.filter(
        "all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return own.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                      F.col("x.far").alias("score"))
