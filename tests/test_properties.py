"""Property tests (hypothesis) for sizes that must be exact."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quill.operators import prepare as P

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(counts=st.lists(st.integers(min_value=1, max_value=500), min_size=1, max_size=12),
       total=st.integers(min_value=1, max_value=2000))
def test_allocation_drift_at_most_half_per_group(spark, counts, total):
    df = spark.createDataFrame([(f"g{i}", c) for i, c in enumerate(counts)], "label string, n long")
    got = {r.label: r.quota for r in P.allocate(df, total).collect()}
    ratio = total / sum(counts)
    want = {f"g{i}": round(c * ratio) for i, c in enumerate(counts) if round(c * ratio) > 0}
    assert got == want
    assert abs(sum(got.values()) - total) <= len(counts) / 2


@SETTINGS
@given(n=st.integers(min_value=0, max_value=400), size=st.floats(min_value=0.0, max_value=1.0),
       seed=st.integers(min_value=0, max_value=10 ** 6))
def test_split_exact_sizes_disjoint_cover(spark, n, size, seed):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    s = P.split_exact(df, size, seed, "doc_id").collect()
    assert len(s) == n and len({r.doc_id for r in s}) == n
    assert sum(r.split == "test" for r in s) == min(n, math.ceil(size * n))


@SETTINGS
@given(n=st.integers(min_value=0, max_value=400), frac=st.floats(min_value=0.0, max_value=1.0))
def test_sample_exact_size(spark, n, frac):
    df = spark.range(n).select(F.col("id").alias("doc_id"))
    assert P.sample_exact(df, frac, 42, "doc_id").count() == round(frac * n)
