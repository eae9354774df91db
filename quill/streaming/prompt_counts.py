"""Incremental prompt counter (Structured Streaming).

The prompt histogram is a single pass over the training rows; as a stream it
is ``groupBy(prompt).count()`` in complete mode over a folder of Parquet
files, written per micro-batch to a sink table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions.text import control_prompt_expr


def prompt_count_stream(spark: SparkSession, source: str, schema: T.StructType, labels: Sequence[str]) -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.groupBy(control_prompt_expr(list(labels)).alias("prompt")).agg(F.count(F.lit(1)).alias("n"))


def run_prompt_counts(spark: SparkSession, source: str, schema: T.StructType, labels: Sequence[str],
                      sink: str, checkpoint: str):
    """Process everything available now and keep the latest full histogram in
    ``sink`` (Parquet, replaced each micro-batch).  Returns the finished query."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    q = (prompt_count_stream(spark, source, schema, labels).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
