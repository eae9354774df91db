"""Connected components of a graph of links, and rows joined to the group they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.common import written

HOT_ROWS = 100_000
MAX_HOT = 50_000
ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``links (a, b)``: the smallest node it reaches.

    Alternates large-star and small-star steps; each round is written to the
    shared folder.  Smallest neighbours come from partial aggregates, so a hub
    sends one row a task; the joins that follow can be split by Spark.
    """
    edges = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to the row of ``groups`` with their ``key``; ``size`` counts the rows of a group.

    Groups over ``max(HOT_ROWS, total / MAX_HOT)`` rows, ``MAX_HOT`` at most,
    are broadcast, so no task receives a hot group; the others are shuffled.
    """
    limit = max(HOT_ROWS, total // MAX_HOT)
    rest = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.filter(F.col(size) > limit).withColumnRenamed(key, "__hot"))
    tagged = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    return (tagged.filter(F.col("__hot").isNotNull()).drop("__hot")
            .unionByName(tagged.filter(F.col("__hot").isNull()).drop("__hot", *rest)
                         .join(groups.filter(F.col(size) <= limit), key)))
