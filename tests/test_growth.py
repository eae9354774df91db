"""Steps that must not grow faster than their tables: what moves, and what is read."""

import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quill.functions import fdlibm
from quill.operators import generate as GN
from quill.operators import model as MD
from quill.operators import text as TX
from quill.operators import udf as UD
from quill.plans import catalog as C
from tests.conftest import SF_SMALL

TEXTS = [(1, "a", "x y x y z"), (2, "b", "x y z"), (3, "a", "z"), (4, None, "x y"), (5, "b", None), (6, "a", "")]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _want(labelled: bool):
    out = {}
    for _, lang, text in TEXTS:
        toks = (text or "").split()
        for pair in set(zip([None, *toks], toks)):
            key = (lang, *pair) if labelled else pair
            out[key] = out.get(key, 0) + 1
    return out


def test_pairs_are_dealt_out_uncounted(spark):
    fit = MD.fit_ngram(_docs(spark), label="lang")
    assert "REPARTITION_BY_COL" in _plan(fit) and _plan(fit).count("Exchange") == 1
    assert {(r.label, r.prev, r.token): r.n for r in fit.collect()} == _want(True)


def test_two_fits_and_their_mixture_move_the_pairs_twice(spark):
    docs = _docs(spark)
    teacher = MD.marginalise(MD.fit_ngram(docs, label="lang"))
    student = MD.fit_ngram(docs, beside="lang")
    assert {(r.prev, r.token): r.n for r in student.collect()} == _want(False)
    assert {(r.prev, r.token): r.n for r in teacher.collect()} == _want(False)
    mix = MD.mle_mix(teacher, student, 0.4)
    got = {(r.prev, r.token): r.p for r in mix.collect()}
    want = _want(False)
    whole = {h: sum(n for (p, _), n in want.items() if p == h) for h, _ in want}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - n / whole[k[0]]) < 1e-12 for k, n in want.items())
    assert "FullOuter" not in _plan(mix)


def test_contexts_of_one_side_only_mix(spark):
    t = spark.createDataFrame([("a", "x", 1.0)], "prev string, token string, n double")
    s = spark.createDataFrame([(None, "y", 2.0), ("a", "z", 3.0)], "prev string, token string, n double")
    got = {(r.prev, r.token): round(r.p, 9) for r in MD.mle_mix(t, s, 0.4).collect()}
    assert got == {("a", "x"): 0.4, ("a", "z"): 0.6, (None, "y"): 0.6}


def test_a_step_opens_the_slices_of_its_contexts_alone(spark):
    rows = [(c, p, w, float(n)) for c in "ab" for p in (None, *"uvwxyz") for n, w in enumerate("uvwxyz", 1)]
    model = spark.createDataFrame(rows, "label string, prev string, token string, n double")
    table = GN.sliced_candidates(model, 3, 32)
    cands = spark.table(table)
    alive = spark.createDataFrame([("s1", "a", "u"), ("s2", "a", "nowhere")], "seq_id string, label string, _p string")
    j = GN._looked_up(alive, cands, 32)

    def files(df):
        return sum(len(part.files()) for part in df._jdf.queryExecution().toRdd().partitions())

    there = [r[0] for r in cands.where("label = 'a' and _p = 'u'").select("_slice").collect()]
    assert files(cands.where(F.col("_slice").isin(there))) == 1 < files(cands)
    got = {r.seq_id: r.cands and [x.token for x in r.cands] for r in j.collect()}
    assert got == {"s1": ["z", "y", "x"], "s2": None}
    spark.sql(f"DROP TABLE {table}")


def test_windows_are_cut_without_a_join(spark):
    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(C.masked_windows(spark, SF_SMALL)) == joins(C.encode_tokens(spark, SF_SMALL))


def test_vocabulary_counts_the_texts_once(spark):
    vocab = TX.build_vocab(TX.token_rows(_docs(spark)))
    assert "regexp_extract_all" not in _plan(vocab)
    got = [(r.token_id, r.token, r.n) for r in vocab.orderBy("token_id").collect()]
    assert got == [(0, "x", 4), (1, "y", 4), (2, "z", 3), (3, "[PAD]", 0)]


_WORKER = r'''
import random, re
import pandas as pd
from quill.operators.udf import word_count

def rss():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

r = random.Random(1)
words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(2000)]
for i in range(80):
    texts = [" ".join(r.choices(words, k=r.choice((20, 200, 500, 3000)))) for _ in range(100)]
    word_count(pd.DataFrame({"doc_id": range(100), "text": pd.Series(texts, dtype=object)}), min_chars=5)
    if i == 0:
        first = rss()
print(rss() - first)
'''


def test_word_count_keeps_no_memory_of_earlier_batches():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", _WORKER], cwd=root, capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 10  # MB


def test_word_count_of_odd_texts():
    texts = [None, "", " \t\n", "abcde abcd abcdef", "x yyyyy zzzzzz", float("nan")]
    frame = pd.DataFrame({"doc_id": range(6), "text": pd.Series(texts, dtype=object)})
    assert UD.word_count(frame, min_chars=5)["n_words"].tolist() == [0, 0, 0, 2, 2, 0]
    assert UD.word_count(frame)["n_words"].tolist() == [0, 0, 0, 3, 3, 0]
    for part in (frame[:0], frame[:1]):
        got = UD.word_count(part)["n_words"]
        assert got.dtype == "int64" and got.tolist() == [0] * len(part)


def _small_model(spark):
    r = random.Random(7)
    rows = [(c, p, w, float(r.randint(1, 4))) for c in "abc" for p in (None, *"uvwxyzäß") for w in ("<e>", *"uvwxyzäß") if r.random() < 0.8]
    prompts = [(f"{c}{i}", c, i % 5) for c in (*"abc", "no model", None) for i in range(12)] + [("full", "a", 30), (None, "b", 0)]
    return (spark.createDataFrame(rows, "label string, prev string, token string, n double"),
            spark.createDataFrame(prompts, "seq_id string, label string, n_prompt int"))


def _sizes(model):
    own = F.octet_length("token") + F.coalesce(F.octet_length("prev"), F.lit(0)) + GN.ROW_BYTES
    return {r.label: r.n for r in model.groupBy("label").agg(F.sum(own).alias("n")).collect()}


@pytest.mark.parametrize("rules", [
    dict(k=3, p=0.9, temperature=0.7, penalty=1.3), dict(k=5, p=0.8), dict(greedy=True, penalty=1.2)])
def test_a_label_in_its_task_generates_what_its_steps_do(spark, rules):
    model, prompts = _small_model(spark)
    got = []
    for local in (GN.LOCAL_BYTES, min(_sizes(model).values())):  # the second: all labels but the smallest go by steps
        out = GN.generate(model, prompts, 6, seed=3, eos="<e>", local_bytes=local, **rules)
        got.append(sorted((str(r.seq_id), str(r.label), r.text, r.n_tokens) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 62
    assert {x[3] for x in got[0] if x[1] in ("no model", "None") or x[0] == "full"} == {0} and max(x[3] for x in got[0]) > 3


def test_jobs_of_a_generation_do_not_grow_with_its_steps(spark):
    model, prompts = _small_model(spark)
    sc, jobs = spark.sparkContext, []
    for steps in (2, 12):
        name = f"steps-{steps}"
        sc.setJobGroup(name, name)
        GN.generate(model, prompts, steps, k=4, seed=3).count()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(name)))
    sc.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_labels_too_large_for_a_task_are_found(spark):
    model, _ = _small_model(spark)
    size = _sizes(model)
    order = sorted(size, key=size.get)
    assert sorted(GN._large_labels(model, size[order[1]])) == [x for x in order if size[x] > size[order[1]]]
    nan = model.unionByName(spark.createDataFrame([("a", "u", "w2", float("nan")), ("b", "u", None, 1.0)], model.schema))
    assert sorted(GN._large_labels(nan, GN.LOCAL_BYTES)) == ["a", "b"]


def test_python_logs_and_exponentials_have_sparks_bits(spark):
    r = random.Random(5)
    shares = [1.0, 0.5, 1 / 3, 5e-324, 0.999999999] + [r.randint(1, n) / n for n in (r.randint(1, 10 ** r.randint(1, 9)) for _ in range(20_000))]
    powers = [0.0, -0.0, -1e-12, -745.0, -746.0] + [-r.random() * 10 ** r.randint(-9, 2) for _ in range(10_000)] + [
        fdlibm.log(a) - fdlibm.log(b) for a, b in zip(shares, shares[1:]) if a < b]
    x = spark.createDataFrame([(s,) for s in shares], "x double").repartition(1)
    y = spark.createDataFrame([(s,) for s in powers], "x double").repartition(1)
    assert all(fdlibm.log(a) == b for a, b in x.select("x", F.log("x")).collect())
    assert all(fdlibm.exp(a) == b for a, b in y.select("x", F.exp("x")).collect())


def test_a_nucleus_edge_that_one_bit_moves_is_sparks(spark):
    """Lists of few small counts: many running sums lie exactly on the edge of the nucleus."""
    r = random.Random(11)
    rows, u = [], 0.999999
    for i in range(3000):
        rows.append((i, [(float(n), f"t{j:02d}") for j, n in enumerate(sorted(r.choices(range(1, 6), k=r.randint(2, 20)), reverse=True))]))
    lists = spark.createDataFrame(rows, "i int, cands array<struct<n:double,token:string>>").select(
        "i", "cands", F.aggregate("cands", F.lit(0.0), lambda a, x: a + x["n"]).alias("total"))
    drawn = lists.select("i", GN.sample_next(F.col("cands"), F.col("total"), F.array().cast("array<string>"),
                                             F.lit(None).cast("string"), F.lit(u), 50, 0.9).alias("t"))
    got = {a.i: a.t for a in drawn.collect()}
    for i, cands in rows:
        total = sum(n for n, _ in cands)
        own = [(fdlibm.log(n / total), t) for n, t in cands]
        assert GN.next_token(own, set(), (), u, 50, 0.9, 1.0, 1.0, False) == got[i]
