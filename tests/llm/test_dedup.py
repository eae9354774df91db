"""Exact and near-duplicate operators against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import exact_dedup, graph, minhash

SCHEMA = "doc_id long, text string, digest string, kept int"


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ROWS = [
    (1, "Abc", "x", 1), (2, "aBC", None, 2), (3, None, "x", None), (4, "", "", 0), (5, "Éa", "x", 1), (6, "éa", "x", 1),
    (7, "only", "x", 1), (8, "abc ", "x", 1), (9, "ab" * 200_000, "x", 1), (10, "AB" * 200_000, "x", 1),
    (11, "abc", "x", 1), (11, "abc", "x", 1),
]


def _exact(rows):
    out = {}
    for i, text, *_ in rows:
        out.setdefault(_fold(text), set()).add(i)
    return sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in out.items() for i in ids)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_groups(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", 2)
        monkeypatch.setattr(exact_dedup, "MAX_HOT", 10**9)
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)  # many false positives: results must not change
    rows = ROWS + [(100 + i, f"t{i}", "x", 1) for i in range(300)] + [(500 + i, "Hot", "x", 1) for i in range(40)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == _exact(rows)


def test_exact_drop_keeps_columns_and_empty(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in left.collect()}) == [4, 5, 6, 7, 8, 10, 11]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_drop_keeps_one_of_repeated_and_null_ids(spark):
    rows = [*ROWS, *[(None, "no id", "x", i) for i in range(3)], *[(20, "Twice", "x", 1), (20, "tWICE", "y", 2)],
            (None, "ABC", "x", 1), (None, "alone", "x", 1)]
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(_fold(r.text) for r in left) == sorted({_fold(r[1]) for r in rows})
    assert sorted(r.doc_id or 0 for r in left) == [0, 0, 4, 5, 6, 7, 8, 10, 11, 20]
    assert all(tuple(r) in rows for r in left)


def test_filter_passes_unique_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2 if i < 100 else i}") for i in range(4000)], "doc_id long, text string")
    prints = exact_dedup.fingerprints(docs)
    bits = exact_dedup.filter_bits(4000)
    probed = exact_dedup.probe(prints, exact_dedup.repeated_words(prints, bits), bits)
    maybe = {r.id for r in probed.filter("maybe").collect()}
    assert set(range(100)) <= maybe and len(maybe) < 300
    assert exact_dedup.filter_bits(10**12) == exact_dedup.MAX_BITS


def test_filter_of_many_slices_keeps_its_share(spark, monkeypatch):
    """Slices of 1,024 bits: the same rows, and as few unique rows shuffled as with one slice."""
    rows = [(i, f"text {i // 2 if i < 2000 else i}", "x", 1) for i in range(12_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = exact_dedup.fingerprints(docs)
    shares = []
    for most in (exact_dedup.MAX_BITS, 1 << 10):
        monkeypatch.setattr(exact_dedup, "MAX_BITS", most)
        monkeypatch.setattr(exact_dedup, "MIN_BITS", 1 << 10)
        probed = exact_dedup.probed_by_slices(prints, len(rows)).collect()
        assert sorted(r.id for r in probed) == list(range(12_000))
        maybe = {r.id for r in probed if r.maybe}
        assert set(range(2000)) <= maybe
        shares.append(len(maybe) - 2000)
    assert shares[0] == shares[1] < 300
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == _exact(rows)


def test_slices_read_ranges_of_the_fingerprints(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    prints = exact_dedup.written(exact_dedup.fingerprints(docs).sortWithinPartitions("spot"), "fingerprints")
    plan = prints.filter(F.col("spot") >= 0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(spot,0)" in plan


def _sets(rows, k=5):
    out = {}
    for i, text in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", _fold(text)) if x]
        out[i] = {tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    return out


def _near(rows, percent=85):
    sets = _sets(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def _near_rows(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for g in range(6):
        base = [r.choice(words) for _ in range(r.choice([60, 120, 300]))]
        rows.append((n := n + 1, " ".join(base)))
        last = base
        for c in range(14):
            new = list(last if c % 3 else base)  # chains and stars
            for _ in range(r.randint(1, max(1, len(new) // 80))):
                new[r.randrange(len(new))] = r.choice(words)
            last = new
            rows.append((n := n + 1, " ".join(new)))
        rows.append((n := n + 1, "\t".join(base).upper()))
    shared = " ".join(r.choice(words) for _ in range(50))
    rows += [(n + 1 + i, shared + " " + " ".join(r.choice(words) for _ in range(60))) for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three"),
             (906, "a b c d e"), (907, "a b c d e")]
    return rows


@pytest.mark.parametrize("block,percent", [(128, 85), (4, 85), (4, 80)])
def test_near_groups_brute_force(spark, monkeypatch, block, percent):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = _near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_groups(docs, threshold=(percent, 100)).collect()
    assert sorted((r.id, r.n, r.component) for r in got) == _near(rows, percent)


def test_bands_miss_few_pairs_at_the_threshold():
    for percent, rows in [(95, 13), (85, 7), (80, 6), (50, 2)]:
        assert minhash.band_rows((percent, 100)) == rows
        assert (1 - (percent / 100) ** rows) ** (minhash.REGISTERS // rows) <= minhash.MISSED


def test_pipeline_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rows = _near_rows(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, root in _near(rows, 80) if i == root)


def test_near_groups_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (1, "a b c d e f", 7), (None, "a b c d e f", 7), (2, "A b c d e f", 7)],
                                 "doc_id long, text string, n int")
    got = minhash.near_groups(docs).collect()
    assert sorted((r.id, r.component) for r in got if r.id) == [(1, 1), (1, 1), (2, 1)]
    assert [r.component for r in got if r.id is None] == [None]
    assert minhash.near_groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in minhash.drop_near_copies(docs).collect()) == [0, 1, 1]


@pytest.mark.parametrize("n", [3, 40, 700, 5000])
def test_sketch_estimates_jaccard(n):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(30):
        both, a, b = (rng.integers(0, 1 << 63, m).astype(np.uint64) for m in (n, n // 3, n // 5))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        agree = (minhash.sketch(x) == minhash.sketch(y)).sum()
        errors.append(minhash.estimate(agree, len(x), len(y)) - n / (n + n // 3 + n // 5))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_registers_hold_zeros_and_mantissa():
    low = np.array([1, 2, 3, (1 << 53) - 1, 1 << 52], np.uint64)
    assert (minhash._packed(low) >> 10).tolist() == [52, 51, 51, 0, 0]
    assert (minhash._packed(low) & 1023).tolist() == [0, 0, 512, 1023, 0]


def test_text_blocks_do_not_change_shingles(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = minhash.shingles(text)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 100)
    assert (minhash.shingles(text) == whole).all()


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [
        (r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: find(i) for i in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_query_and_sql_agree_on_repeated_rows(spark, tmp_path):
    import duckdb

    from quill.llm import queries

    rows = [(1, "One"), (1, "one"), (1, "one"), (2, "ONE"), (3, None), (3, None), (4, ""), (5, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_exact_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.execute(queries.SQL["op9_exact_dedup"])
    names = [d[0] for d in rel.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(rel.fetchall())
