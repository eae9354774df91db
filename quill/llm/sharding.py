"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records into buckets by a seeded hash of the record; the
number of buckets is the table's bytes over ``BUCKET_BYTES``, so a bucket fits
into the memory of one task at any table size.  Pass 2 permutes each bucket in
memory by a Fisher-Yates shuffle whose generator is seeded by (seed, bucket).
Buckets in order, and the shuffled records in each, make one random order of
the whole table.  Record ``pos`` of ``n`` goes to shard ``pos * shards // n``:
shard sizes differ by one row at most (law ``rows``), and the shards are
written as Parquet below ``shard=``.

A retried task makes the same rows again: the bucket of a record depends on
the record alone, and records are put in order before they are permuted.

Defined results: a null text has no bytes (size 1, crc32 of nothing); empty
and very long texts are ordinary records; equal texts under different ids
scatter independently; rows equal in all columns share a bucket and take
places next to chance; an empty table gives no shard.  Extra columns travel
with their record; one that is named like an output column (``pos``, ``shard``,
``slot``) or a working column gets ``_in`` appended to its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quill.llm.common import clear_of, written
from quill.session import scratch_path

BUCKET_BYTES = 32 << 20
LAW = "rows"
_ADDED = ("__bucket", "__tie", "__crc", "__of", "__offset", "pos", "shard", "slot")


def record_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of ``range(n)`` (numpy's Fisher-Yates), fixed by (seed, bucket)."""
    order = np.arange(n)
    np.random.default_rng([seed & 0xFFFFFFFF, bucket]).shuffle(order)
    return order


def _permuted(schema: pa.Schema, seed: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        table = table.sort_by([("__tie", "ascending"), ("__crc", "ascending")]).combine_chunks()
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, bucket)))
        pos = np.asarray(table.column("__offset")) + np.arange(table.num_rows)
        return table.append_column("pos", pa.array(pos, pa.int64())).select(schema.names).cast(schema)

    return run


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17,
             bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with ``pos``, its place in one random order of all rows, and the number of rows."""
    docs = clear_of(docs, _ADDED)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(record_size(text_col)).alias("b")).first()
    rows = total["n"]
    buckets = max(1, -(-(total["b"] or 0) // bucket_bytes))
    tie = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    dealt = docs.withColumn("__tie", tie).withColumn("__bucket", F.pmod("__tie", F.lit(buckets)).cast("int"))

    # One row of 16 bytes for each bucket_bytes of input: a proven bound for the broadcast.
    sizes = written(dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__rows")), "bucket-sizes")
    offsets = sizes.select(F.col("__bucket").alias("__of"), (
        F.sum("__rows").over(Window.orderBy("__bucket")) - F.col("__rows")).alias("__offset"))
    full = (dealt.withColumn("__crc", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
            .join(F.broadcast(offsets), F.col("__bucket") == F.col("__of")))
    out = T.StructType([*docs.schema.fields, T.StructField("__crc", T.LongType()), T.StructField("pos", T.LongType())])
    # The bucket is the partition: hashed once more, several buckets would share a task while others had none.
    return full.repartitionById(buckets, "__bucket").groupBy("__bucket").applyInArrow(_permuted(to_arrow_schema(out), seed), out), rows


def with_shards(ordered: DataFrame, rows: int, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that have ``pos``."""
    n = max(rows, 1)
    shard = F.expr(f"(pos * {shards}L) div {n}L")
    first = F.expr(f"(((pos * {shards}L) div {n}L) * {n}L + {shards - 1}L) div {shards}L")
    return ordered.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("pos") - first)


def write_shards(docs: DataFrame, shards: int, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shuffled records to ``path/shard=0`` ... and returns them as read back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    ordered, rows = shuffled(docs, id_col, text_col, seed, bucket_bytes)
    ready = with_shards(ordered, rows, shards)
    ready.write.partitionBy("shard").parquet(path)
    return spark.read.schema(ready.schema).parquet(path)
