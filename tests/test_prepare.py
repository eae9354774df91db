import math

import pytest
from pyspark.sql import functions as F

from quill.operators import prepare as P
from quill.operators import text as TX


def test_allocate_half_even_and_zero_quota(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 996)], "label string, n long")
    got = {r.label: r.quota for r in P.allocate(counts, 500).collect()}
    # 1*0.5 -> 0 (dropped), 3*0.5 = 1.5 -> 2, 996*0.5 = 498
    assert got == {"b": 2, "c": 498}


def test_split_two_way_disjoint_and_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    s = P.split_exact(df, 5 / 200, 42, "doc_id")
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"test": math.ceil(0.025 * 1000), "train": 1000 - math.ceil(0.025 * 1000)}


def test_split_three_way_covers_all(spark):
    df = spark.range(777).withColumnRenamed("id", "doc_id")
    s = P.split_three_way(df, 0.02, 0.02, 42, "doc_id")
    assert s.count() == 777 and s.select("doc_id").distinct().count() == 777
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    n_test = math.ceil(0.02 * 777)
    assert got["test"] == n_test and got["validation"] == math.ceil(0.02 * (777 - n_test))


def test_recode_unknown_key_raises(spark):
    df = spark.createDataFrame([(1, 0), (2, 99)], "vec_id long, label int")
    with pytest.raises(Exception):
        P.recode(df, "label", {0: "Company"}).collect()
    ok = P.recode(df.where("label = 0"), "label", {0: "Company"}).collect()
    assert ok[0].label == "Company"


def test_null_label_in_prompt_raises(spark):
    df = spark.createDataFrame([("t", None)], "text string, label string")
    with pytest.raises(Exception):
        TX.control_prompt(df, ["label"]).collect()


def test_clean_rows_semantics(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, "y", "b")], "doc_id long, text string, label string")
    out = P.drop_nulls(df, ["text"]).select("doc_id", P.as_text("label").alias("label"))
    assert sorted((r.doc_id, r.label) for r in out.collect()) == [(2, "None"), (3, "b")]


def test_filter_frequent_strictly_greater(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "doc_id long, label string")
    assert {r.label for r in P.frequent_labels(df, "label", 2).collect()} == {"a"}
    assert P.filter_frequent(df, "label", 2).count() == 3


def test_stratified_sample_no_group_over_quota(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("label"))
    q = P.allocate(P.value_counts(df, "label"), 100)
    s = P.stratified_sample(df, "label", q, 3, "doc_id")
    per = {r.label: r["count"] for r in s.groupBy("label").count().collect()}
    assert per == {r.label: r.quota for r in q.collect()}


def test_union_all_by_name_and_label_columns(spark):
    a = spark.createDataFrame([("x", 1)], "text string, doc_id long")
    b = spark.createDataFrame([(2, "y")], "doc_id long, text string")
    strata = [P.with_label(a, "German"), P.with_label(b, "French")]
    u = P.union_all(strata)
    assert sorted((r.doc_id, r.text, r.label) for r in u.collect()) == [(1, "x", "German"), (2, "y", "French")]
    two = spark.createDataFrame([("t", "a", "b")], "text string, label_lang string, label_source string")
    assert P.label_columns(two) == ["label_lang", "label_source"]
    assert P.prompt_counts(two).first().prompt == "a\tb\n\n"


def test_frequency_stats_equals_filter_then_count(spark):
    rows = [(i, None if i % 11 == 0 else f"l{i % 5 if i < 60 else 9}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    got = {r.stage: (r.n_rows, r.n_labels) for r in P.frequency_stats(df, "label", 10).collect()}
    b = P.table_stats(df, "label", "before").first()
    a = P.table_stats(P.filter_frequent(df, "label", 10), "label", "after").first()
    assert got == {"before": (b.n_rows, b.n_labels), "after": (a.n_rows, a.n_labels)}
