"""The operator names used in the blueprint resolve to working operators."""

import math

from pyspark.sql import functions as F

from quill.operators import evaluate as EV
from quill.operators import generate as GN
from quill.operators import model as MD
from quill.operators import prepare as P
from quill.operators import text as TX
from quill.operators import windows as WN
from quill.plans import report as RP


def test_quota_table_and_global_offsets(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(10)], "doc_id long, lang string")
    q = {r.lang: (r.n, r.quota) for r in P.quota_table(df, "lang", 5).collect()}
    assert q == {"a": (6, 3), "b": (4, 2)}
    sizes = spark.createDataFrame([(1, 3), (2, 0), (3, 5)], "doc_id long, n long")
    got = {r.doc_id: r.start_offset for r in WN.global_offsets(sizes, ["doc_id"], "n").collect()}
    assert got == {1: 0, 2: 3, 3: 3}


def test_parse_labels_and_warping_helpers(spark):
    df = spark.createDataFrame([(" de\tsrc1\n\n",)], "g string")
    assert df.select(TX.parse_labels("g").alias("l")).first().l == ["de", "src1"]
    c = spark.createDataFrame([([("a", -1.0), ("b", -2.0)], ["a"], ["b"])],
                              "c array<struct<token:string,score:double>>, seen array<string>, ban array<string>")
    c = c.select(F.transform("c", lambda x: F.struct(x["score"].alias("score"), x["token"].alias("token"))).alias("c"),
                 "seen", "ban")
    r = c.select(GN.penalise(F.col("c"), F.col("seen"), 2.0).alias("p"),
                 GN.ban_repeats(F.col("c"), F.col("ban")).alias("b"),
                 GN.with_temperature(F.col("c"), 2.0).alias("t")).first()
    assert [x.score for x in r.p] == [-2.0, -2.0]
    assert [x.token for x in r.b] == ["a"]
    assert [x.score for x in r.t] == [-0.5, -1.0]


def test_nll_perplexity_and_evaluate(spark):
    uni = spark.createDataFrame([(t, 1.0) for t in "abc"], "token string, n double")
    m = MD.NgramModel.unigram(uni)
    test = spark.createDataFrame([(1, "a b c a")], "doc_id long, text string")
    t = EV.stream_targets(test, "doc_id", 128, 128)
    macro = EV.perplexity(EV.nll(t, m), "macro").first()
    # p = (1 + 1) / (3 + 4) for every token
    assert macro.n_windows == 1 and math.isclose(macro.ppl, 3.5)
    rep = RP.evaluate(test, {"uniform": (m, None)}).first()
    assert rep.model == "uniform" and math.isclose(rep.ppl, 3.5)
