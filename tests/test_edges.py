"""Edge inputs: one row, empty tables, texts without tokens, quota 0."""

from pyspark.sql import functions as F

from quill.operators import generate as GN
from quill.operators import model as MD
from quill.operators import prepare as P
from quill.operators import text as TX
from quill.operators import vectors as VC
from quill.operators import windows as WN


def _one(spark, text="a b c"):
    return spark.createDataFrame([(7, "en", text)], "doc_id long, lang string, text string")


def test_one_row_everywhere(spark):
    df = _one(spark)
    assert P.sample_exact(df, 0.4, 1, "doc_id").count() == 0  # round(0.4) = 0
    assert P.sample_exact(df, 0.6, 1, "doc_id").count() == 1
    assert [r.split for r in P.split_exact(df, 0.5, 1, "doc_id").collect()] == ["test"]  # ceil(0.5) = 1
    assert P.shuffle(df, 1, "doc_id").first().shuffle_key == 1
    v = TX.build_vocab(TX.token_rows(df), 1).collect()
    assert sorted((r.token_id, r.token) for r in v) == [(0, "a"), (1, "b"), (2, "c"), (3, "[PAD]")]
    assert WN.pack_blocks(df, ["doc_id"], "doc_id", block=4).count() == 0  # 3 tokens < one block
    assert [r.block_id for r in WN.pack_blocks(df, ["doc_id"], "doc_id", block=3).collect()] == [0, 0, 0]


def test_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, "en", "   "), (2, "en", "")], "doc_id long, lang string, text string")
    assert MD.fit_ngram(df, label="lang").count() == 0
    assert WN.strided_windows(WN.with_token_counts(df), "n_tokens", 128, 128, keep=["doc_id"]).count() == 0
    assert TX.tokenize_pad(df, 3, "[PAD]").where(F.col("mask") == 1).count() == 0
    offs = WN.corpus_offsets(WN.with_token_counts(df).select("doc_id", "n_tokens"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.start_offset) for r in offs) == [(1, 0), (2, 0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert P.sample_exact(empty, 0.5, 1, "doc_id").count() == 0
    assert P.split_three_way(empty, 0.1, 0.1, 1, "doc_id").count() == 0
    assert P.allocate(P.value_counts(empty, "lang"), 10).count() == 0
    assert MD.fit_ngram(empty, label="lang").count() == 0
    assert WN.pack_blocks(empty, ["doc_id"], "doc_id").count() == 0
    vec = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert VC.mean_vector(vec, "embedding", "label").count() == 0


def test_generation_without_model_stops(spark):
    model = MD.fit_ngram(_one(spark), label="lang")
    prompts = GN.prompts_per_label(spark.createDataFrame([("en",), ("de",)], "label string"), 1)
    out = {r.label: (r.text, r.n_tokens) for r in GN.generate(model, prompts, 5, k=3, seed=1).collect()}
    assert out["de"] == ("", 0)  # no context for this label: stops at once
    assert out["en"][0].split()[:3] == ["a", "b", "c"] and out["en"][1] == 3  # then 'c' has no successor
