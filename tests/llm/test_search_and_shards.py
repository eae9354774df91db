"""Nearest neighbours, sharding and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quill.llm import ann, packing, queries, sharding
from quill.llm.common import written

DATA = "/root/testdata/sf0.01"


def _nearest(ids, x, query, k):
    far = np.sqrt(((x.astype(float) - x[query].astype(float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, far)) if i != query][:k]
    return [(int(ids[i]), float(far[i])) for i in order]


@pytest.mark.parametrize("rows", [6000])
def test_search_recall(spark, rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, rows)] + 0.5 * rng.standard_normal((rows, 24))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(frame.repartition(6), F.col("vec_id") % 100 == 0).collect()
    ids, hit, n = np.arange(rows), 0, 0
    for q in range(0, rows, 100):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        want = _nearest(ids, x, q, 10)
        hit += len({w[0] for w in want} & {r.vec_id for r in own})
        n += 10
        for r in own:
            assert r.score == np.sqrt(((x[r.vec_id].astype(float) - x[q].astype(float)) ** 2).sum())
    assert hit / n >= 0.9


def test_search_equal_vectors_and_edges(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 3000, 10)] + [(5, [1.0, 2.0, 0.5]), (7, None), (9, [0.0, 0.0, 0.0]),
            (11, [float("nan"), 1.0, 1.0]), (13, [float("inf"), 1.0, 1.0]), (15, [1.0, None, 2.0]), (17, [1.0]),
            (None, same), (0, same)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = ann.search(frame, F.col("vec_id") % 100 == 0).collect()
    for q in range(0, 3000, 100):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert own == [i for i in range(0, 120, 10) if i != q][:10]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(few.limit(1), F.col("vec_id") == 0).count() == 0


def test_descent_and_ascent_against_all_strings():
    """Longest matches, matches at every level and the end of the ascent by comparing whole strings."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((150, 6)), 5 + 0.05 * rng.standard_normal((60, 6))]).astype(np.float32)
    forest = ann.fit(x[:180], 10_000, 5)
    length = forest.length

    def text(key):
        return format(int(key), f"0{length}b")

    own = [[text(v) for v in row] for row in forest.strings(x[:180])[:, :, 0]]
    keys = forest.strings(x, 3)
    inside = np.arange(len(x)) < 180
    ends, longest = forest.levels(keys, inside), forest.longest(keys)
    need = max(forest.matches, -(-ann.LEAST * 180 // 10_000))
    for q in range(0, len(x), 5):
        asked = [[text(v) for v in row] for row in keys[q]]

        def matched(level, q=q, asked=asked):
            return sum(own[i][t][:level] == probe[:level] for i in range(180) if i != q
                       for t in range(ann.TREES) for probe in asked[t])

        assert longest[q] == (length if inside[q] else max(level for level in range(length + 1) if matched(level)))
        for level in range(0, length + 1, 3):
            assert matched(level) == forest.matched(keys[q:q + 1], inside[q:q + 1], level)[0]
        assert ends[q] == max([level for level in range(1, longest[q] + 1) if matched(level) >= need], default=0)
    assert len(set(ends.tolist())) > 2


def test_forest_ranges_are_reached(spark, monkeypatch):
    """Many small ranges give the same result as one."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2500, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = ann.search(frame, F.col("vec_id") % 100 == 0).collect()
    monkeypatch.setattr(ann, "RANGE", 100)
    many = ann.search(frame, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def _shard_rows():
    r = random.Random(1)
    return [(i, "same" if i % 3 == 0 else r.choice([None, "", f"é{i}", "x" * r.randint(1, 400)])) for i in range(1003)] + [
        (5000, "y" * 300_000)]


def test_shards_round_trip(spark):
    rows = _shard_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = sharding.write_shards(frame.repartition(6), 16, bucket_bytes=20_000).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in rows)
    assert {r.slot_in for r in got} == {"clash"}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    again = sharding.write_shards(frame.repartition(3), 16, bucket_bytes=20_000).collect()
    assert place == {r.doc_id: (r.shard, r.slot) for r in again}
    other = sharding.write_shards(frame, 16, bucket_bytes=20_000, seed=18).collect()
    assert sum(place[r.doc_id] == (r.shard, r.slot) for r in other) < 30


def test_shards_edges(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string")
    got = sharding.write_shards(frame, 16).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3
    assert sharding.write_shards(frame.limit(0), 16).count() == 0


def test_fisher_yates_is_uniform():
    seen = [tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000)]
    assert all(800 < seen.count(p) < 1200 for p in set(seen)) and len(set(seen)) == 6


def test_shard_query(spark):
    got = queries.op10_shards(spark, DATA).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_pipeline_stages(spark, tmp_path):
    """Each stage against the rows it must keep, on planted rows."""
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("lo", "re", "mi", "sa", "tu") for b in ("na", "ve", "ko", "pi", "ra")]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(40)]
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(base[0].split()))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[1].upper(), "en", "s", 1), (101, near, "en", "s", 1), (102, None, None, None, None),
             (103, "12 !!", "en", "s", 5), (104, "", "en", "s", 0), (100, base[1].upper(), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = written(docs, "stage")
        kept.append(sorted({x.doc_id for x in docs.collect()}))
    known, exact, near_, mixed = kept
    assert known == [*range(40), 100, 101]
    assert exact == [i for i in known if i != 1]
    assert near_ == [i for i in exact if i != 101]
    assert set(mixed) <= set(near_)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == set(mixed)
    assert all(x.offset + x.length <= packing.SIZE for x in pieces)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
