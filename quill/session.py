"""Session helpers: a local session for tests/bench and the shared scratch root."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _driver_memory() -> str:
    """About 60 % of physical memory, at most 16 GB (local mode runs all tasks
    in the driver JVM); ``QUILL_DRIVER_MEMORY`` overrides."""
    env = os.environ.get("QUILL_DRIVER_MEMORY")
    if env:
        return env
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    mb = max(1024, min(16 * 1024, int(total * 0.6 / (1 << 20))))
    return f"{mb}m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quill") -> SparkSession:
    """Local session used by tests and bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", _driver_memory())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is only filled in here when it is
    unset (local masters, as in tests), never replaced; on any other master a
    missing setting is an error, as no folder of one machine would do.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="quill-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written intermediate tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/quill-scratch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint root and read back: like a reliable checkpoint, but
    packed by column, so a large table takes a fraction of the disk and a reader of few columns reads those alone."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20,
               text_split_bytes: int = 64 << 20) -> dict[str, str]:
    """Settings these jobs assume on a cluster, sized from the input volume.

    * scans split text at ``text_split_bytes``: one tokenised split explodes
      to many token rows, so splits are smaller than Spark's 128 MB default;
    * AQE starts from enough shuffle partitions for ~``target_partition_bytes``
      each (at least 2 per core) and coalesces small ones; skew-join
      splitting stays on for hot tokens and contexts;
    * checkpoints no longer referenced are cleaned.

    The checkpoint folder itself (``spark.checkpoint.dir``) is the cluster's
    shared storage and is not chosen here.
    """
    parts = max(2 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(text_split_bytes),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
