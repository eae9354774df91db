import math

import pytest
from pyspark.sql import functions as F

from quill.functions.arrays import clip_l2, l2_norm, softmax
from quill.operators import privacy as PV
from quill.operators import vectors as VC


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, -50.0],), ([1000.0, 1000.0],)], "v array<double>")
    for r in df.select(softmax("v", 2.0).alias("p")).collect():
        assert math.isclose(sum(r.p), 1.0, rel_tol=1e-12)


def test_kl_nonnegative_and_zero_for_equal(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 0.5], [1.0, 2.0, 0.5]), (0, [3.0, -1.0, 0.0], [0.0, 0.0, 1.0])],
                               "b int, s array<double>, t array<double>")
    kl = VC.kl_row(F.col("s"), F.col("t"), 2.0)
    vals = [r.k for r in df.select(kl.alias("k")).collect()]
    assert abs(vals[0]) < 1e-12 and vals[1] > 0


def test_clipped_norm_at_most_c(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.1, 0.1],), ([0.0, 0.0],)], "v array<double>")
    norms = [r.n for r in df.select(l2_norm(clip_l2("v", 1.5)).alias("n")).collect()]
    assert norms[0] <= 1.5 + 1e-12 and math.isclose(norms[1], math.sqrt(0.02)) and norms[2] == 0.0


def test_gaussian_sigma_reference_values():
    for eps, want in [(0.5, 9.7001), (1.0, 4.9006), (2.0, 2.4993), (4.0, 1.2961)]:
        assert abs(PV.gaussian_sigma(eps, 1e-5, 1.0) - want) < 1e-4


def test_ledger_grows_with_steps(spark):
    mech = spark.createDataFrame([("a", 5.0, 1), ("b", 5.0, 10)], "run string, sigma double, steps int")
    eps = {r.run: r.epsilon for r in PV.ledger_epsilon(PV.privacy_ledger(mech, 1e-5)).collect()}
    assert eps["b"] > eps["a"] > 0


def test_dp_mean_sigma_zero_is_clipped_mean(spark):
    df = spark.createDataFrame([("x", [3.0, 4.0]), ("x", [0.0, 1.0])], "g string, v array<double>")
    got = sorted((r.pos, r.mean) for r in PV.dp_mean(df, "v", "g", 1.0, 0.0).collect())
    assert [round(m, 9) for _, m in got] == [round((0.6 + 0.0) / 2, 9), round((0.8 + 1.0) / 2, 9)]


def test_bound_contributions(spark):
    df = spark.range(500).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"))
    out = PV.bound_contributions(df, "user_id", 10, 42, "event_id")
    assert max(r["count"] for r in out.groupBy("user_id").count().collect()) == 10


def test_noisy_release_paths(spark):
    from quill.operators import model as MD
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sigma = PV.gaussian_sigma(2.0, 1e-5, math.sqrt(50))
    exact = {(r.prev, r.token): r.n for r in MD.fit_ngram(docs, k=50).collect()}
    a = MD.fit_ngram(docs, k=50, sigma=sigma, tau="auto", seed=3).collect()
    b = MD.fit_ngram(docs, k=50, sigma=sigma, tau="auto", seed=3).collect()
    tau = PV.key_threshold(sigma, 50, 1e-6)
    assert sorted(a) == sorted(b)  # seeded test noise is repeatable
    assert all(r.n >= tau for r in a)
    with pytest.raises(ValueError):
        MD.fit_ngram(docs, k=50, sigma=sigma, seed=3)  # an unknown key set needs a threshold
    raw = MD.fit_ngram(docs, k=50, sigma=sigma, seed=3, public_keys=True).collect()  # every key, noisy
    assert len(raw) == len(exact) and any(r.n != exact[(r.prev, r.token)] for r in raw)
    prod = MD.fit_ngram(docs, k=50, sigma=sigma, tau="auto").collect()  # seed=None: Spark randn
    assert all(r.n >= tau for r in prod)
    h = PV.dp_label_histogram(docs, "lang", sigma, seed=None).collect()
    assert len(h) == 4 and all(r.noisy_n >= 0 for r in h)


def test_noisy_mean_hides_the_group_size(spark):
    rows = [(g, [1.0, 0.0]) for g, n in (("a", 4000), ("b", 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    for seed in (7, None):
        got = {(r.g, r.pos): r.mean for r in PV.dp_mean(df, "v", "g", 1.0, 5.0, seed, tau=100.0).collect()}
        assert set(got) == {("a", 0), ("a", 1)}  # the small group stays hidden
        assert abs(got["a", 0] - 1) < 0.03 and got["a", 0] != 1.0 and abs(got["a", 1]) < 0.03
    assert PV.dp_mean(df, "v", None, 1.0, 5.0, 7).count() == 2
    left = PV.dp_label_histogram(df, "g", 5.0, 7, tau=100.0).collect()
    assert [r.label for r in left] == ["a"]


def test_bounded_keys_reach_the_end_of_a_text(spark):
    from quill.operators import model as MD

    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(2000)),)], "text string")
    got = [int(r.token[1:]) for r in MD.fit_ngram(df, order=1, k=100).collect()]
    assert len(got) == 100 and max(got) > 1500 and 700 < sum(got) / 100 < 1300


def test_report_with_noise_runs(spark, tmp_path):
    from quill.plans import report as RP
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    train, test = docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0")
    pub, priv = train.where("source in ('src0','src1')"), train.where("source not in ('src0','src1')")
    models = RP.build_models(priv, pub, train.limit(20), epsilon=2000.0, delta=1e-5, folder=str(tmp_path / "models"),
                             noise=True, seed=5, events=str(tmp_path / "events"))
    spent = {r.node: r for r in PV.spent(PV.read_mechanisms(spark, str(tmp_path / "events"))).collect()}
    for run in ("student_dpsgd", "student_dpkd", "teacher_cc"):
        assert abs(spent[run].epsilon_basic - 2000.0) < 1e-6 and abs(spent[run].delta - 1e-5) < 1e-15
    assert models["teacher_dpkd"][1] == 1000.0 and models["student_dpkd"][1] == 2000.0
    rows = RP.model_report(test, models).collect()
    assert len(rows) == 8 and all(r.ppl > 1 and math.isfinite(r.ppl) for r in rows)


def test_group_vectors_are_attached_without_moving_rows(spark):
    from quill.operators import vectors as VC

    rows = [(i, "hot" if i % 3 else f"g{i % 50}", [float(i % 7), float(i % 11), 1.0]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, label string, student array<double>").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        small = VC.with_teacher_mean(df, "student", "label")
        large = VC.with_teacher_mean(df, "student", "label", numbers=0)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert "_salt" in large._jdf.queryExecution().executedPlan().toString()
        a, b = (sorted(map(tuple, x.select("vec_id", "label", "teacher").collect())) for x in (small, large))
        assert len(a) == 900 and a == b
        sizes = [r["n"] for r in large.where("label = 'hot'").groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 600 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
