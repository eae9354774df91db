"""Toxicity machine, hard negatives and spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quill.llm import negatives, spelling, toxicity
from quill.llm import queries as Q

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ------------------------------------------------------------ toxicity


def machine_of(n, seed=3):
    rng = np.random.default_rng(seed)
    return toxicity.Machine(np.arange(n) * 7, 0.3, rng.normal(size=n), rng.normal(size=(n, toxicity.FACTORS)))


def test_margin_is_the_sum_over_pairs():
    m = machine_of(9)
    terms, x = np.array([0, 14, 15, 35, 56]), np.array([0.5, 1.5, 9.0, 2.0, 0.25])
    known = [(t // 7, v) for t, v in zip(terms, x, strict=True) if t % 7 == 0]
    expected = m.bias + sum(m.linear[i] * v for i, v in known) + sum(
        float(m.pairs[i] @ m.pairs[j]) * v * w for (i, v), (j, w) in itertools.combinations(known, 2))
    assert m.margin(terms, x) == pytest.approx(expected)
    assert m.margin(np.zeros(0, np.int64), np.zeros(0)) == pytest.approx(m.bias)


def test_gradients_are_the_slopes_of_the_loss():
    m = machine_of(6)
    starts, at = np.array([0, 3, 3, 5]), np.array([0, 2, 5, 1, 2])
    x, y, weight = np.array([1.0, 0.5, 2.0, 1.0, 0.3]), np.array([1.0, 0.0, 0.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        out = 0.0
        for i in range(3):
            part = slice(starts[i], starts[i + 1])
            p = 1 / (1 + np.exp(-m.margin(m.terms[at[part]], x[part])))
            out -= weight[i] * (y[i] * np.log(p) + (1 - y[i]) * np.log(1 - p))
        return out

    g0, g1, g2 = toxicity.gradients(m, starts, at, x, y, weight)
    step = 1e-6
    for place, got in ((2, g1[at == 2].sum()), (5, g1[at == 5].sum())):
        m.linear[place] += step
        up = loss()
        m.linear[place] -= 2 * step
        assert (up - loss()) / (2 * step) == pytest.approx(got, rel=1e-4, abs=1e-6)
        m.linear[place] += step
    for f in (0, 4):
        m.pairs[2, f] += step
        up = loss()
        m.pairs[2, f] -= 2 * step
        assert (up - loss()) / (2 * step) == pytest.approx(g2[at == 2][:, f].sum(), rel=1e-4, abs=1e-6)
        m.pairs[2, f] += step


def test_words_and_long_texts():
    text = "Über-Alles x1y " * 3
    assert toxicity.word_counts(text) == Counter({"über": 3, "alles": 3, "x": 3, "y": 3})
    long = "abc def " * 300_000
    assert toxicity.word_counts(long) == Counter({"abc": 300_000, "def": 300_000})
    assert not toxicity.word_counts(None) and not toxicity.word_counts("1 2 ?")


def test_pairs_of_terms_speak_where_single_terms_do_not(spark):
    """Toxic only where insult and mention meet; each alone is as frequent in clean texts."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1600):
        insult, mention = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.choice('abcdefgh')}{rng.choice('mnopq')}" for _ in range(8)]
        words += ["dolt"] * insult + ["folk"] * mention
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult and mention)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(d, lab.filter("doc_id % 4 != 0"))
    asked = spark.createDataFrame([(0, "wam dolt wbn wco wdp"), (1, "wam folk wbn wco wdp"), (2, "wam dolt wbn folk wco")],
                                  "doc_id long, text string")
    s = {r["id"]: r["score"] for r in toxicity.score(asked, machine).collect()}
    assert s[2] > 0.5 > max(s[0], s[1])
    truth = dict(labels)
    held = toxicity.score(d.filter("doc_id % 4 = 0"), machine).collect()
    assert np.mean([(r["score"] >= 0.5) == truth[r["id"]] for r in held]) > 0.95


def test_toxicity_query_holds_out(spark):
    got = {r["doc_id"]: r for r in Q.op11_toxicity(spark, MIDDLE).collect()}
    con = duckdb.connect()
    n = con.execute(f"select count(*) from '{MIDDLE}/documents.parquet'").fetchone()[0]
    assert len(got) == n
    truth = dict(con.execute(f"select doc_id, toxic from '{MIDDLE}/labels.parquet'").fetchall())
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], truth[i]) for i, r in got.items() if r["held_out"] and i in truth]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.95


def test_toxicity_defined_results(spark):
    docs = spark.createDataFrame(
        [(1, "bad idiot", 1), (1, "bad idiot", 1), (2, None, 1), (3, "", 1), (None, "good day", 1), (4, "?? 12", 1),
         (5, "x" * 300_000, 1)], "doc_id long, text string, score int")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, none).collect()
    assert len(got) == 7 and {r["score"] for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    s = {r["id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    assert s[2] == s[3] == s[4] and all(0 <= v <= 1 for v in s.values())
    one = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert {round(r["score"], 6) for r in toxicity.score(docs, one).collect()} == {0.999}
    assert toxicity.score(docs.limit(0), machine).count() == 0


# ------------------------------------------------------------ hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives_=3):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (label, [float(x) for x in v])
        one[i] = min(one.get(i, key), key)
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in one.items()}
    out = set()
    for a, (label, v) in whole.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, (k, w) in whole.items()
                        if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, i) for n, i, k in scored if k != label and 50 * -s <= 100 * -n <= 95 * -s]
            out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit[:negatives_])}
    return out


def mined(spark, rows, kind="array<double>", every=3, **more):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding {kind}")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    from pyspark.sql import functions as F

    return [tuple(r[c] for c in cols) for r in negatives.mine(df, F.col("id") % every == 0, **more).collect()]


def test_negatives_query_against_brute_force(spark):
    rows = duckdb.connect().execute(f"select vec_id, label, embedding from '{SMALL}/embeddings.parquet'").fetchall()
    moved = [(i, (k + 1) % 10 if i % 7 == 0 else k, v) for i, k, v in rows]
    got = Q.op12_negatives(spark, SMALL).collect()
    assert len(got) == len({tuple(r) for r in got})
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r[c] for c in cols) for r in got} == brute_negatives(moved, lambda i: i % 50 == 0)


@pytest.mark.parametrize("items, side", [(4096, 2048), (13, 7)])
def test_negatives_with_ties_repeats_and_blocks(spark, items, side):
    rng = random.Random(11)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(150)]
    rows += [(i, 1, [1.0, 1.0, 0.5, 0.5]) for i in range(200, 230)]
    rows += rows[:20] + [(5, 2, [0.5, 0.5, 0.5, 0.5]), (300, 0, [0.0] * 4), (301, None, [1.0] * 4), (302, 1, None),
                         (303, 1, [1.0, None, 0.0, 0.0]), (306, 1, [float("nan")] * 4), (309, 1, [float("inf")] * 4),
                         (None, 1, [1.0] * 4), (312, 1, [1.0, 1.0]), (315, 2, [0.75, 1.0]), (318, 1, [0.9, 1.0])]
    got = mined(spark, rows, items=items, anchors_a_block=side)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, lambda i: i % 3 == 0)


def test_negatives_of_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [float(rng.randrange(1, 1 << 20)) * 4, 1.0]) for i in range(24)]
    assert set(mined(spark, rows)) == brute_negatives(rows, lambda i: i % 3 == 0)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(3, 1, [1.0]), (4, 2, [1.0])]) == []
    assert mined(spark, [(3, 1, []), (6, 1, []), (7, 2, [])]) == [
        (3, 6, 1, 7, 0, 0), (6, 3, 1, 7, 0, 0)]


def test_bound_is_never_below_a_score():
    rng = np.random.default_rng(4)
    members, rows = rng.normal(size=(20, 8)) * 50, rng.normal(size=(200, 8)) * 80
    order, bound = negatives.shared_list(members, rows)
    assert (np.diff(bound) <= 0).all()
    scores = members @ rows[order].T
    assert (scores <= np.linalg.norm(members, axis=1)[:, None] * bound[None] + 1e-6).all()


def test_a_walk_ends_before_the_end_of_its_list():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(20_000, 16)).round(3) * 256
    rows[:40] *= 30
    members = {"vec": rows[:4], "id": np.arange(4), "label": np.zeros(4, np.int64)}
    side = {"vec": rows, "id": np.arange(len(rows)), "label": np.zeros(len(rows), np.int64)}
    order, bound = negatives.shared_list(members["vec"], rows)
    best = negatives.Best(4, 5, np.full(4, -np.inf))
    done = negatives.walk(members, side, order, bound, lambda a, p, s, need, j: s >= need[:, None], best, 1)
    assert done < 4 * len(rows) / 2
    for m in range(4):
        scores = rows @ rows[m]
        assert set(best.id[best.slot == m]) == set(np.argsort(-scores)[:5])


# ------------------------------------------------------------ spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_forms(words, ratio=5):
    found = {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x)) if others else None
        found[w] = (best if best is not None and words[best] >= ratio * n else None, len(others))

    def root(w):
        while found[w][0] is not None:
            w = found[w][0]
        return w

    return {w: (f, root(w), words[w], k, words[f] if f else None) for w, (f, k) in found.items()}


def forms_of(rows):
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def brute_words(rows):
    counts = Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_spelling_query_against_brute_force(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    words = brute_words(rows)
    assert len(words) > 500
    got = forms_of(Q.op13_spelling(spark, SMALL).collect())
    expected = brute_forms(words)
    assert got == expected and any(v[0] for v in expected.values())


@pytest.mark.parametrize("limit", [1, 4, 60, 4000])
def test_pairs_at_every_partition_size(spark, limit):
    """All words over a small alphabet: many runs of equal letters and prefixes that are words."""
    rng = random.Random(limit)
    words = {"".join(p): rng.choice([1, 2, 5, 30, 200, 1000, 5000]) for k in (1, 2, 3, 4)
             for p in itertools.product("abé", repeat=k) if rng.random() < 0.8}
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r["word"], r["near"]) for r in spelling.near_pairs(vocabulary, limit).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a, b in itertools.combinations(words, 2) if near(a, b)}
    assert forms_of(spelling.variants(vocabulary, limit=limit).collect()) == brute_forms(words)


def test_acceptor_is_minimal_and_ranks_its_words():
    words = sorted({"".join(p) for k in (2, 3) for p in itertools.product("ab", repeat=k)} | {"zab", "zb"})
    a = spelling.Acceptor(words)
    assert a.size[a.start] == len(words)
    for rank, word in enumerate(words):
        q, at = a.start, 0
        for c in word:
            q, before = a.arcs[q][c]
            at += before
        assert a.final[q] and at == rank
    # States with the same right language are one.
    assert len({(f, tuple(x.items())) for f, x in zip(a.final, a.arcs, strict=True)}) == len(a.arcs)


def test_long_words_and_chains(spark):
    stem = "ab" * 20_000
    words = {stem + "x": 5, stem + "y": 30, "q" + stem + "y": 2, "root": 100_000, "roots": 20_000, "rootse": 3_000,
             "rootsed": 500, "rootseds": 90, "rootsedsi": 10, "alone": 7}
    got = forms_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect())
    assert got == brute_forms(words)
    assert got["rootsedsi"][1] == "root"


def test_words_defined_results(spark):
    rows = [(1, "Straße STRASSE Ängste Ängste " * 3), (1, "Straße STRASSE Ängste Ängste " * 3), (None, "wordly " * 7),
            (2, None), (3, ""), (4, "12 ?"), (5, ("longer " * 400_000) + "z" * 2_000_000), (6, "a" * 7 + "×" + "b" * 7)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int")
    got = {r["word"]: r["n"] for r in spelling.count_words(df).collect()}
    assert got == brute_words(rows)
    assert spelling.variants(spelling.count_words(df.limit(0))).count() == 0


def test_sql_of_the_negatives(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{MIDDLE}/embeddings.parquet'")
    rel = con.execute(Q.SQL["op12_negatives"])
    names = [d[0] for d in rel.description]
    got = Q.op12_negatives(spark, MIDDLE)
    assert sorted(names) == sorted(got.columns)
    assert {tuple(r[c] for c in names) for r in got.collect()} == set(rel.fetchall())
