"""End-to-end preparation and training jobs on the smallest fixture."""

import math

from pyspark.sql import functions as F

from quill.operators import privacy as PV
from quill.plans import corpora, training
from quill.plans.catalog import LABEL_NAMES, LANG_NAMES
from quill.sources import io
from tests.conftest import SF_SMALL

SCHEMA = "text string, label string"


def _docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_prepare_frequent(spark, tmp_path):
    out = str(tmp_path / "freq")
    stats = {r.stage: r for r in corpora.prepare_frequent(_docs(spark), "text", "source", "doc_id", out, 5, 0.1, 0.1, 42,
                                                          scan_frac=0.9).collect()}
    from pyspark.sql.types import _parse_datatype_string

    back = io.read_splits(spark, out, _parse_datatype_string(SCHEMA), fmt="csv")
    sizes = {r.split: r["count"] for r in back.groupBy("split").count().collect()}
    kept = stats["kept"].n_rows
    assert sum(sizes.values()) == kept and stats["scanned"].n_rows == 180
    assert sizes["test"] == math.ceil(0.1 * kept) and sizes["val"] == math.ceil(0.1 * (kept - sizes["test"]))


def test_prepare_coded(spark, tmp_path):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        "vec_id", F.col("vec_id").cast("string").alias("text"), "label")
    counts = {r.split: r.n for r in corpora.prepare_coded(emb, emb, "text", "label", "vec_id", LABEL_NAMES,
                                                          str(tmp_path / "coded"), 200 / 560, 5 / 200, 5 / 70, 7,
                                                          fmt="parquet").collect()}
    n_train = round(500 * 200 / 560)
    assert counts["test"] == round(500 * 5 / 70)
    assert counts["val"] == math.ceil(n_train * 5 / 200) and counts["train"] == n_train - counts["val"]


def test_prepare_strata(spark, tmp_path):
    d = _docs(spark).withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train"))
    res = corpora.prepare_strata(d, "text", "lang", "split", "doc_id", LANG_NAMES, {"train": 60, "test": 20},
                                 str(tmp_path / "strata"), fmt="parquet")
    per = {}
    for r in res.collect():
        per[r.split] = per.get(r.split, 0) + r.n
    assert abs(per["train"] - 60) <= 2 and abs(per["test"] - 20) <= 2


def test_training_jobs_write_models_and_ledger(spark, tmp_path):
    d = _docs(spark).select("text", F.col("lang").alias("label_lang"), F.col("source").alias("label_source"))
    metrics = str(tmp_path / "metrics")
    t = training.fit_teacher(d, ["label_lang", "label_source"], 2.0, 1e-5, str(tmp_path / "teacher"), metrics,
                             "teacher-2.0", k=50, seed=1)
    assert set(t.columns) == {"label", "prev", "token", "n"}
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    t2 = training.fit_teacher(d, ["label_lang"], 2.0, 1e-5, str(tmp_path / "t2"), metrics, "t2", k=50, seed=2)
    s = training.distil_student(t2, conv, 0.4, str(tmp_path / "student"))
    assert s.part("pair").count() > 0
    # Over all tokens of a context, and one unseen, a stored student's probabilities sum to 1 (one vocabulary).
    from quill.operators import model as MD

    bigrams = MD.NgramModel.from_bigrams(MD.count_ngrams(conv, order=2))
    own = training.store_mixture(bigrams, MD.NgramModel.unigram(bigrams.unigrams), 0.4, str(tmp_path / "own"))
    for prev in (None, bigrams.unigrams.first().token, "never seen"):
        known = own.part("token").select(F.lit(prev).cast("string").alias("prev"), "token")
        unseen = spark.createDataFrame([(prev, "no such token")], "prev string, token string")
        got = own.prob(known.unionByName(unseen)).agg(F.sum("p").alias("s"), F.min("p").alias("m")).first()
        assert abs(got.s - 1.0) < 1e-6 and got.m > 0
    events = str(tmp_path / "events")
    dp = training.dp_distil_student(_docs(spark), "lang", 2.0, 1e-5, 0.4, str(tmp_path / "dpkd"), metrics, "dpkd",
                                    k=50, seed=3, events=events)
    assert set(dp.table.columns) == {"part", "prev", "token", "v"}
    spent = {r.node: r for r in PV.spent(PV.read_mechanisms(spark, events)).collect()}
    assert set(spent) == {"dpkd", "dpkd/teacher", "dpkd/student"}
    assert math.isclose(spent["dpkd"].epsilon_basic, 2.0, abs_tol=1e-6) and math.isclose(spent["dpkd"].delta, 1e-5)
    assert math.isclose(spent["dpkd/teacher"].epsilon_basic, 1.0, abs_tol=1e-6)
    assert spent["dpkd"].epsilon_rdp < 2.0
    m = {(r.run, r.metric): r.value for r in io.read_metrics(spark, metrics).collect()}
    assert m[("dpkd", "epsilon_basic")] == 2.0
    assert m[("dpkd", "delta_gaussian")] + m[("dpkd", "delta_key_release")] == 1e-5
    assert abs(m[("teacher-2.0", "final_epsilon_rdp")] - 2.0) < 1e-3  # sigma was calibrated for exactly this
    assert m[("teacher-2.0", "delta_gaussian")] + m[("teacher-2.0", "delta_key_release")] == 1e-5
