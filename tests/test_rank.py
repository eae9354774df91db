"""Exact ranks and cut-offs: sizes, ties, determinism across partitionings."""

from pyspark.sql import functions as F

from quill.operators.rank import exact_take, hash_rank, running_total, value_rank


def _ids(spark, n, parts=4):
    return spark.range(n).repartition(parts).withColumnRenamed("id", "doc_id")


def test_exact_take_sizes(spark):
    df = _ids(spark, 1000)
    for n in (0, 1, 357, 999, 1000, 5000):
        assert exact_take(df, n, seed=42, ids="doc_id").count() == min(n, 1000)


def test_same_rows_any_partition_count(spark):
    a = {r.doc_id for r in exact_take(_ids(spark, 2000, 3), 123, seed=7, ids="doc_id").collect()}
    b = {r.doc_id for r in exact_take(_ids(spark, 2000, 17), 123, seed=7, ids="doc_id").collect()}
    assert a == b and len(a) == 123


def test_hash_rank_matches_brute_force(spark):
    import hashlib

    df = _ids(spark, 300)
    got = {r.doc_id: r.rank for r in hash_rank(df, 42, "doc_id").collect()}
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == {doc: i + 1 for i, doc in enumerate(order)}


def test_hash_rank_per_group_quota(spark):
    df = _ids(spark, 1000).withColumn("g", (F.col("doc_id") % 3).cast("string"))
    q = spark.createDataFrame([("0", 5), ("1", 0), ("2", 1000)], "g string, quota long")
    out = hash_rank(df, 1, "doc_id", by="g", limit=q).groupBy("g").count().collect()
    got = {r.g: r["count"] for r in out}
    assert got == {"0": 5, "2": 333}


def test_value_rank_desc_and_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "token string, n long")
    got = [r.token for r in value_rank(df, [F.col("n").desc(), F.col("token")]).orderBy("rank").collect()]
    assert got == ["c", "a", "b", "d"]


def test_running_total_grouped(spark):
    rows = [(g, i, i + 1) for g in ("x", "y") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(5)
    got = {(r.g, r.i): r.before for r in running_total(df, ["i"], F.col("w"), by=["g"]).collect()}
    for g in ("x", "y"):
        assert got[(g, 0)] == 0
        assert got[(g, 49)] == sum(range(1, 50))


def test_empty_input(spark):
    df = _ids(spark, 0)
    assert exact_take(df, 10, seed=1, ids="doc_id").count() == 0
    assert value_rank(df, ["doc_id"]).count() == 0


def test_value_rank_integral_sparse_keys(spark):
    from quill.operators.rank import offsets

    ids = [-5, 0, 3, 10 ** 12, 10 ** 12 + 1, 7, 8, 9] + list(range(100, 300, 7))
    df = spark.createDataFrame([(i, i % 5 + 1) for i in ids], "k long, w long").repartition(3)
    got = {r.k: r.rank for r in value_rank(df, ["k"]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(ids))}
    assert {r.k for r in exact_take(df, 5, order=["k"]).collect()} == set(sorted(ids)[:5])
    offs = {r.k: r.before for r in offsets(df, ["k"], F.col("w")).collect()}
    acc, want = 0, {}
    for k in sorted(ids):
        want[k] = acc
        acc += k % 5 + 1
    assert offs == want


def test_value_rank_grouped_with_quota(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("g"))
    q = spark.createDataFrame([("0", 4), ("1", 1)], "g string, quota long")
    got = sorted((r.g, r.doc_id, r.rn) for r in value_rank(df, ["doc_id"], by=["g"], name="rn", limit=q).collect())
    assert got == [("0", 0, 1), ("0", 3, 2), ("0", 6, 3), ("0", 9, 4), ("1", 1, 1)]


def test_hot_group_split_into_buckets_same_result(spark):
    # one group holds most rows; forcing it hot (tiny threshold) must not change ranks
    df = spark.range(3000).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    a = {(r.g, r.doc_id): r.rank for r in hash_rank(df, 9, "doc_id", by="g").collect()}
    b = {(r.g, r.doc_id): r.rank for r in hash_rank(df, 9, "doc_id", by="g", hot_rows=100).collect()}
    assert a == b
    c = hash_rank(df, 9, "doc_id", by="g", limit=5, hot_rows=100)
    assert {r.g: r["count"] for r in c.groupBy("g").count().collect()} == {g: 5 for g in ["hot", *map(str, range(7))]}


def test_value_rank_huge_keys_exact(spark):
    base = 2 ** 62
    ids = [base + i * 3 for i in range(50)] + [base - 7, 2 ** 63 - 1]
    df = spark.createDataFrame([(k,) for k in ids], "k long")
    got = {r.k: r.rank for r in value_rank(df, ["k"]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(ids))}


def test_key_buckets_are_even_wherever_the_keys_lie(spark):
    from quill.operators.rank import value_rank, with_key_bucket

    dense, far = list(range(-500, 19_500)), [-(2**62), 2**62, 2**62 + 1]
    sparse = [i * i * 1_000_003 for i in range(200, 5_200)]
    df = spark.createDataFrame([(k,) for k in {*dense, *far, *sparse}], "k long")
    got = with_key_bucket(df, "k", "b", 256).groupBy("b").agg(
        F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
    mean = df.count() / len(got)
    assert len(got) > 200 and max(r.n for r in got) <= 2 * mean
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))
    ranked = value_rank(df, ["k"], name="r").orderBy("r").collect()
    assert [r.k for r in ranked] == sorted(r.k for r in ranked) and [r.r for r in ranked] == list(range(1, len(ranked) + 1))


def test_key_bucket_of_nulls_ties_and_nothing(spark):
    from quill.operators.rank import with_key_bucket

    df = spark.createDataFrame([(None,), (7,), (7,), (7,), (9,)], "k int")
    got = [tuple(r) for r in with_key_bucket(df, "k", "b").orderBy("b").collect()]
    assert got[0] == (None, -1) and len({b for k, b in got if k == 7}) == 1 and got[-1][0] == 9
    empty = df.where("k > 100")
    assert with_key_bucket(empty, "k", "b").count() == 0


def test_key_buckets_follow_the_row_count(spark, monkeypatch):
    from quill.operators import rank as R

    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(R, "MAX_BOUNDS", 16)
    keys = [*range(0, 9_000, 3), -(2**63), -(2**62), 2**62, 2**63 - 1]
    df = spark.createDataFrame([(k, 1 + k % 5) for k in keys] + [(None, 7)], "k long, w long")
    got = R.with_key_bucket(df, "k").groupBy("_b").agg(
        F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_b").collect()
    assert len(got) > 200 and max(r.n for r in got) < 100  # 16 ranges alone would hold 188 rows each
    known = [r for r in got if r.lo is not None]
    assert all(a.hi < b.lo for a, b in zip(known, known[1:]))
    ranked = R.value_rank(df, ["k"], name="r").orderBy("r").collect()
    assert [r.k for r in ranked] == [None, *sorted(keys)] and [r.r for r in ranked] == list(range(1, len(keys) + 2))
    before, total = {r.k: r.before for r in R.offsets(df, ["k"], F.col("w")).collect()}, 0
    for k, w in [(None, 7), *sorted((k, 1 + k % 5) for k in keys)]:
        assert before[k] == total
        total += w


def test_hash_cut_moves_no_row(spark):
    from quill.operators import prepare as P
    from quill.operators.rank import hash_cut, hash_rank

    df = _ids(spark, 3000, 5)
    for n in (0, 1, 2, 1500, 2999, 3000, 5000):
        cut = {r.doc_id for r in df.where(hash_cut(df, 9, "doc_id", n)).collect()}
        assert cut == {r.doc_id for r in hash_rank(df, 9, "doc_id").where(F.col("rank") <= n).collect()}
    split = P.split_three_way(spark.range(3000).withColumnRenamed("id", "doc_id"), 0.1, 0.2, 42, "doc_id")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {
        "test": 300, "validation": 540, "train": 2160}


def test_cut_through_equal_ids_keeps_the_size(spark):
    from quill.operators import prepare as P
    from quill.operators.rank import hash_cut

    df = spark.createDataFrame([(1, i) for i in range(10)] + [(None, i) for i in range(10)], "doc_id long, v long")
    assert hash_cut(df, 1, "doc_id", 4) is None and hash_cut(df, 1, "doc_id", 10) is not None
    assert exact_take(df, 4, seed=1, ids="doc_id").count() == 4
    assert P.sample_exact(df, 0.35, 1, "doc_id").count() == 7
    for size, want in ((0.5, 10), (0.25, 5)):
        assert P.split_exact(df, size, 1, "doc_id").where("split = 'test'").count() == want
    sizes = {r.split: r.n for r in P.split_three_way(df, 0.5, 0.3, 1, "doc_id").groupBy("split").agg(
        F.count("*").alias("n")).collect()}
    assert sizes == {"test": 10, "validation": 3, "train": 7}
