"""Sources and sinks.

CSV is only used at the edges: texts hold newlines and quotes, so CSV needs
``multiLine`` parsing, which makes each file unsplittable.  Writers therefore
emit many shards and Parquet is used between stages.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LABELLED_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])

# RFC-4180 style quoting, whitespace kept as is.
_CSV_WRITE = {
    "header": "true", "quote": '"', "escape": '"', "quoteAll": "false",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "emptyValue": '""', "lineSep": "\n",
}
_CSV_READ = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "mode": "FAILFAST"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Hash-spread the rows of a scan over at least ``min_partitions`` (default: the
    cluster's parallelism) when it yields fewer splits, e.g. one large row group.
    A scan that already has enough splits is left alone: no extra shuffle at
    scale.  Spreading on the row id also pre-partitions later joins on it."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def read_corpus(spark: SparkSession, path: str, config: str | None = None, split: str | None = None,
                config_col: str = "source", split_col: str = "split") -> DataFrame:
    """A named corpus, optionally one configuration and one split; the
    predicates reach the Parquet scan (and partition pruning when the corpus is
    laid out by those columns)."""
    df = spark.read.parquet(path)
    if config is not None:
        df = df.where(F.col(config_col) == F.lit(config))
    if split is not None:
        df = df.where(F.col(split_col) == F.lit(split))
    return df


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split",
                 shards: int | None = None, mode: str = "error") -> None:
    """One folder per split (``split=train`` ...).  ``shards`` redistributes the
    rows over so many tasks, each with a file a split (CSV with multi-line
    texts cannot be split on read, so many shards matter); the input's
    partitions are not counted first, which would run it."""
    w = df.repartition(int(shards)) if shards else df
    writer = w.write.mode(mode).partitionBy(split_col)
    if fmt == "csv":
        writer.options(**_CSV_WRITE).csv(path)
    else:
        writer.parquet(path)


def read_splits(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
                split_col: str = "split") -> DataFrame:
    """All splits of a written table set as one DataFrame with a ``split`` column."""
    if fmt == "csv":
        r = spark.read.options(**_CSV_READ)
        if schema is not None:
            r = r.schema(T.StructType(list(schema.fields) + [T.StructField(split_col, T.StringType())]))
        return r.csv(path)
    return spark.read.parquet(path)


def run_name(*parts) -> str:
    """Artifact / run names are parameters joined by '-'."""
    return "-".join(str(p) for p in parts)


def synthetic_name(seq_len: int, dataset: str, epsilon: float) -> str:
    # Fixed value: the synthetic table file name template.
    return f"{seq_len}_{dataset}_{epsilon}_dp_synthetic_data"


def write_synthetic(df: DataFrame, folder: str, seq_len: int, dataset: str, epsilon: float,
                    text: str = "text", fmt: str = "parquet") -> str:
    """Store a synthetic table (text first, then labels by name); empty texts are dropped."""
    labels = [c for c in df.columns if "label" in c]
    rest = [c for c in df.columns if c != text and c not in labels]
    out = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(text, *labels, *rest)
    path = f"{folder.rstrip('/')}/{synthetic_name(seq_len, dataset, epsilon)}"
    if fmt == "csv":
        out.write.mode("overwrite").options(**_CSV_WRITE).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return path


METRICS_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def append_metrics(df: DataFrame, path: str) -> None:
    """Append ``(run, metric, value)`` rows to a metrics table."""
    df.select(F.col("run").cast("string"), F.col("metric").cast("string"),
              F.col("value").cast("double")).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).parquet(path)
