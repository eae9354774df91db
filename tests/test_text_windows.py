import math

from pyspark.sql import functions as F

from quill.functions.arrays import mask_targets, mask_value
from quill.functions.text import squash_ws
from quill.operators import text as TX
from quill.operators import windows as WN


def test_tokenize_pad_lengths_and_masks(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, " ".join(["w"] * 10))], "doc_id long, text string")
    out = TX.tokenize_pad(df, 4, "[PAD]").collect()
    per = {}
    for r in out:
        per.setdefault(r.doc_id, []).append(r)
    assert all(len(v) == 4 for v in per.values())
    d1 = sorted(per[1], key=lambda r: r.pos)
    assert [r.token for r in d1] == ["a", "b", "c", "[PAD]"] and [r.mask for r in d1] == [1, 1, 1, 0]
    assert d1[3].target is None
    assert all(r.token == "[PAD]" for r in per[2])


def _loop_forward(n, max_len, stride):
    out, prev_end = [], 0
    for begin in range(0, n, stride):
        end = min(begin + max_len, n)
        out.append((begin, end, end - prev_end))
        prev_end = end
        if end == n:
            break
    return out


def _loop_lookback(n, max_len, stride):
    return [(max(i + stride - max_len, 0), min(i + stride, n), min(i + stride, n) - i) for i in range(0, n, stride)]


def test_windows_equal_the_loops(spark):
    ns = [0, 1, 5, 127, 128, 129, 256, 700, 1023, 1025]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "doc_id long, n long")
    for kind, ml, st, loop in [("forward", 256, 128, _loop_forward), ("forward", 128, 128, _loop_forward),
                               ("forward", 200, 64, _loop_forward), ("lookback", 1024, 512, _loop_lookback)]:
        got = {}
        for r in WN.strided_windows(df, "n", ml, st, kind, keep=["doc_id"]).collect():
            got.setdefault(r.doc_id, []).append((r.begin, r.end, r.trg_len))
        for i, n in enumerate(ns):
            assert sorted(got.get(i, [])) == loop(n, ml, st), (kind, n)
            assert sum(t for _, _, t in got.get(i, [])) == n


def test_pack_keeps_whole_blocks(spark):
    texts = [(i, " ".join(f"t{i}_{j}" for j in range(i * 7 % 50))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = WN.pack_blocks(df, ["doc_id"], "doc_id", batch_rows=10, block=16).collect()
    expected = []
    for b in range(4):
        toks = [t for i, s in texts[b * 10:(b + 1) * 10] for t in s.split()]
        keep = len(toks) // 16 * 16
        expected.append(toks[:keep])
    flat = [t for blk in expected for t in blk]
    got = [r.token for r in sorted(out, key=lambda r: (r.block_id, r.pos))]
    assert got == flat


def test_masking(spark):
    df = spark.createDataFrame([([5, 6, 7, 0],)], "ids array<bigint>")
    r = df.select(mask_targets("ids", 2).alias("a"), mask_targets("ids", 0).alias("b"),
                  mask_value("ids", 0).alias("c")).first()
    assert r.a == [-100, -100, 7, 0] and r.b == [-100] * 4 and r.c == [5, 6, 7, -100]


def test_squash_ws_matches_python(spark):
    s = "  a b\tc\x1c d e\n\n f  "
    got = spark.createDataFrame([(s,)], "t string").select(squash_ws("t").alias("x")).first().x
    assert got == " ".join(s.split())


def test_vocab_pad_last_and_roundtrip(spark):
    df = spark.createDataFrame([(1, "b a a c"), (2, "a b d")], "doc_id long, text string")
    vocab = TX.build_vocab(TX.token_rows(df), min_count=2, pad="[PAD]")
    v = sorted((r.token_id, r.token, r.n) for r in vocab.collect())
    assert v == [(0, "a", 3), (1, "b", 2), (2, "[PAD]", 0)]
    enc = TX.encode(TX.token_rows(df), vocab)
    dec = {r.doc_id: r.text for r in TX.decode(enc, vocab.where(F.col("n") > 0)).collect()}
    assert dec == {1: "b a a", 2: "a b"}


def test_corpus_windows_cover_stream(spark):
    df = spark.createDataFrame([(i, " ".join(["x"] * (i * 13 % 40))) for i in range(30)], "doc_id long, text string")
    offs = WN.corpus_offsets(WN.with_token_counts(df).select("doc_id", "n_tokens"), ["doc_id"])
    total = sum(i * 13 % 40 for i in range(30))
    got = sorted((r.begin, r.end, r.trg_len) for r in WN.corpus_windows(offs, 64, 32).collect())
    assert got == _loop_forward(total, 64, 32)
    assert math.isclose(sum(t for *_, t in got), total)
