"""Sources/sinks and the extension surface."""

import math

from pyspark.sql import functions as F

from quill.operators import vectors as VC
from quill.sources import io


def test_parquet_splits_roundtrip_and_partition_pruning(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                 F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"))
    path = str(tmp_path / "splits")
    io.write_splits(df, path, fmt="parquet", shards=4)
    back = io.read_splits(spark, path).where(F.col("split") == "test")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert sorted(r.doc_id for r in back.collect()) == list(range(0, 100, 10))


def test_read_corpus_config_and_split(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("source"),
                                F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    path = str(tmp_path / "corpus")
    df.write.partitionBy("source").parquet(path)
    got = io.read_corpus(spark, path, config="2", split="test")
    assert sorted(r.doc_id for r in got.collect()) == [22, 26, 30, 34, 38]
    assert "PartitionFilters: [isnotnull(source" in got._jdf.queryExecution().executedPlan().toString()


def test_kd_loss_user_terms(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [1.5, 1.0], 1)], "b int, s array<double>, t array<double>, y int")
    base = VC.kd_loss(df, "s", "t", "y", "b", 1.0, 0.0, 0.0).first().loss
    extra = VC.kd_loss(df, "s", "t", "y", "b", 1.0, 0.0, 0.0, terms={"l2": F.lit(0.25)}).first().loss
    assert math.isclose(extra - base, 0.25)


def test_run_name_and_synthetic_name():
    assert io.run_name("student", "documents", 2.0, "DPKD") == "student-documents-2.0-DPKD"
    assert io.synthetic_name(128, "documents", 2.0) == "128_documents_2.0_dp_synthetic_data"


def test_scale_conf_sizes_partitions():
    from quill.session import scale_conf

    c = scale_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (128 << 20) + 1
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_write_synthetic_csv_text_first_drops_empty(spark, tmp_path):
    text = 'Der Satz,\n mit "Zitat"'
    df = spark.createDataFrame([("de", text, 1), ("en", "", 2)],
                               "label_lang string, text string, seq long")
    path = io.write_synthetic(df, str(tmp_path), 128, "documents", 2.0, fmt="csv")
    assert path.endswith("/128_documents_2.0_dp_synthetic_data")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    assert back.columns[:2] == ["text", "label_lang"]
    rows = back.collect()
    assert len(rows) == 1 and rows[0].text == text
