"""Every registered job: ``(spark, sf_dir) -> DataFrame`` over the fixture tables.

Parameters follow FIXTURES.md section C.  Defaults: id = doc_id,
label = lang, seed = 42, D = documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.operators import evaluate as EV
from quill.operators import generate as GN
from quill.operators import model as MD
from quill.operators import prepare as P
from quill.operators import privacy as PV
from quill.operators import text as TX
from quill.operators import udf as UD
from quill.operators import vectors as VC
from quill.operators import windows as WN
from quill.operators.rank import value_rank
from quill.plans import report as RP
from quill.plans import synthesis as SY
from quill.sources import io

SEED = 42

# English names of the corpus languages (stratum labels).
LANG_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}

# The encyclopedia label dictionary (label 4 keeps its spelling).
LABEL_NAMES = {
    0: "Company", 1: "School", 2: "Artist", 3: "Athlete", 4: "Polite",
    5: "Transportation", 6: "Building", 7: "Nature", 8: "Village", 9: "Animal",
    10: "Plant", 11: "Album", 12: "Film", 13: "Book",
}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return io.table(spark, d, "documents")


def tdocs(spark: SparkSession, d: str) -> DataFrame:
    """Documents for token-level work: spread over the cluster when the scan
    has fewer splits than cores."""
    return io.spread(docs(spark, d), "doc_id")


# ------------------------------------------------------------ flagship

def flagship(spark: SparkSession, d: str, total: int = 120) -> DataFrame:
    """Sample of ``total`` rows whose languages keep their corpus proportions."""
    lab = P.to_labelled(docs(spark, d), "text", "lang", keep=["doc_id"])
    quotas = P.allocate(P.value_counts(lab, "label"), total)
    return P.stratified_sample(lab, "label", quotas, SEED, "doc_id").select("doc_id", "label")


# ------------------------------------------------------------ scans and sinks

def scan_corpus(spark, d):
    return io.read_corpus(spark, f"{d}/documents.parquet", config="src3").select("doc_id", "text", "lang")


def scan_split(spark, d):
    """One configuration and one split of a corpus (here: a source, and a language as its split)."""
    return io.read_corpus(spark, f"{d}/documents.parquet", config="src3", split="en", split_col="lang").select(
        "doc_id", "text")


def _split_col():
    m = F.col("doc_id") % 10
    return F.when(m == 0, "test").when(m == 1, "validation").otherwise("train")


def csv_roundtrip(spark, d):
    from quill.session import scratch_path

    df = docs(spark, d).select(_split_col().alias("split"), "doc_id", "text", F.col("lang").alias("label"))
    path = scratch_path(spark, "csv-splits")
    io.write_splits(df, path, fmt="csv", shards=max(8, spark.sparkContext.defaultParallelism))
    schema = "doc_id long, text string, label string"
    from pyspark.sql.types import _parse_datatype_string

    back = io.read_splits(spark, path, _parse_datatype_string(schema), fmt="csv")
    return back.select("split", "doc_id", "text", "label")


def run_metrics(spark, d):
    from quill.session import scratch_path

    ev = io.table(spark, d, "events")
    run = F.concat(F.col("event_type"), F.lit("-" + io.run_name(2.0, "dp")))
    agg = ev.groupBy(run.alias("run")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.round(F.sum("value"), 2).alias("value_sum"),
    )
    long = agg.select("run", F.explode(F.array(
        F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
        F.struct(F.lit("value_sum").alias("metric"), F.col("value_sum").alias("value")),
    )).alias("m")).select("run", "m.metric", "m.value")
    path = scratch_path(spark, "metrics")
    io.append_metrics(long, path)
    return io.read_metrics(spark, path)


# ------------------------------------------------------------ projections / filters

def project_text_label(spark, d):
    return P.to_labelled(docs(spark, d), "text", "lang", keep=["doc_id"])


def union_strata(spark, d):
    return P.stratum_labels(docs(spark, d), "lang", LANG_NAMES).select("doc_id", "text", "label")


def recode_label(spark, d):
    emb = io.table(spark, d, "embeddings").select("vec_id", "label")
    return P.recode(emb, "label", LABEL_NAMES)


def clean_rows(spark, d):
    df = docs(spark, d).select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang")).alias("label"),
    )
    return P.drop_nulls(df, ["text"]).select("doc_id", "text", P.as_text("label").alias("label"))


def value_counts(spark, d):
    df = docs(spark, d).select(F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"))
    return P.value_counts(df, "source")


def _labelled(spark, d):
    """The whole corpus, labelled lang/source."""
    return docs(spark, d).select("doc_id", F.concat_ws("/", "lang", "source").alias("label"))


def frequent_labels(spark, d):
    return P.frequent_labels(_labelled(spark, d), "label", 25)


def filter_frequent(spark, d):
    return P.filter_frequent(_labelled(spark, d), "label", 25).select("doc_id", "label")


def table_stats(spark, d):
    return P.frequency_stats(_labelled(spark, d), "label", 25)


def prompt_counts(spark, d):
    df = docs(spark, d).select(F.col("lang").alias("label_lang"), F.col("source").alias("label_source"))
    return P.prompt_counts(df)


def _lang_quotas(spark, d, total):
    lab = docs(spark, d).select("doc_id", F.col("lang").alias("label"))
    return lab, P.allocate(P.value_counts(lab, "label"), total)


def allocate_quota(spark, d):
    _, q = _lang_quotas(spark, d, 600)
    return q.select("label", "n", "quota")


def stratified_sample(spark, d):
    return flagship(spark, d, 600)


def stratum_prefix(spark, d):
    lab, q = _lang_quotas(spark, d, 150)
    return P.take_per_group(lab, "label", q, ["doc_id"], name="rn").select("doc_id", "label", "rn")


def prefix_rows(spark, d):
    return P.prefix(docs(spark, d).select("doc_id"), 300, ["doc_id"])


def sample_exact(spark, d):
    return P.sample_exact(docs(spark, d).select("doc_id"), 200.0 / 560.0, SEED, "doc_id")


def split_two_way(spark, d):
    return P.split_exact(docs(spark, d).select("doc_id"), 5.0 / 200.0, SEED, "doc_id")


def split_three_way(spark, d):
    return P.split_three_way(docs(spark, d).select("doc_id"), 0.02, 0.02, SEED, "doc_id")


def shuffle_rows(spark, d):
    return P.shuffle(docs(spark, d).select("doc_id"), SEED, "doc_id")


# ------------------------------------------------------------ text, tokens, windows


PAD = "[PAD]"


def _two_labels(spark, d):
    return docs(spark, d).select("doc_id", "text", F.col("lang").alias("label_lang"),
                                 F.col("source").alias("label_source"))


def control_prompt(spark, d):
    return TX.control_prompt(_two_labels(spark, d), ["label_lang", "label_source"]).select("doc_id", "prompt")


def training_text(spark, d):
    df = _two_labels(spark, d)
    return TX.training_text(df, ["label_lang", "label_source"], "<eos>", use_cc=(F.col("doc_id") % 2 == 0)).select(
        "doc_id", "train_text")


def tokenize_pad(spark, d):
    return TX.tokenize_pad(tdocs(spark, d), 128, PAD)


def _vocab(spark, d):
    return TX.build_vocab(TX.token_rows(tdocs(spark, d)), min_count=1, pad=PAD)


def build_vocab(spark, d):
    return _vocab(spark, d)


def encode_tokens(spark, d):
    return TX.encode(TX.token_rows(tdocs(spark, d)), _vocab(spark, d)).select("doc_id", "pos", "token_id")


def decode_text(spark, d):
    vocab = _vocab(spark, d)
    enc = TX.encode(TX.token_rows(tdocs(spark, d)), vocab).select("doc_id", "pos", "token_id")
    # Pad (n = 0) and unknown ids (no vocabulary row) are skipped.
    return TX.decode(enc, vocab.where(F.col("n") > 0))


def pack_blocks(spark, d):
    return WN.pack_blocks(tdocs(spark, d), ["doc_id"], "doc_id", batch_rows=1000, block=128)


def _offsets(spark, d):
    return WN.corpus_offsets(WN.with_token_counts(tdocs(spark, d)).select("doc_id", "n_tokens"), ["doc_id"])


def corpus_offsets(spark, d):
    return _offsets(spark, d).select("doc_id", "n_tokens", "start_offset")


def corpus_windows(spark, d):
    return WN.corpus_windows(_offsets(spark, d), 128, 128)


def windows_lookback(spark, d):
    return WN.strided_windows(WN.with_token_counts(tdocs(spark, d)), "n_tokens", 1024, 512, "lookback",
                              keep=["doc_id"])


def windows_forward(spark, d):
    return WN.strided_windows(WN.with_token_counts(tdocs(spark, d)), "n_tokens", 256, 128, "forward",
                              keep=["doc_id"])


def masked_windows(spark, d):
    """Forward windows (64 / 32) over the ids of every whole text; only the
    last window is padded.  Context positions are masked (``mask_targets``) and
    so is padding (``mask_value``), both to -100."""
    from quill.functions.arrays import mask_targets, mask_value

    vocab = _vocab(spark, d)
    pad_id = vocab.where(F.col("token") == PAD).first()["token_id"]
    ids = TX.encode(TX.token_rows(tdocs(spark, d)), vocab)
    arrays = VC.long_to_array(ids.select("doc_id", "pos", "token_id"), ["doc_id"], "token_id", "ids")
    # A text's windows are cut where its array is, without a join.
    j = WN.strided_windows(arrays.where(F.col("doc_id").isNotNull()).withColumn("n", F.size("ids")), "n", 64, 32, "forward",
                           keep=["doc_id", "ids"])
    piece = F.slice(F.col("ids"), F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int"))
    target = mask_targets(piece, F.col("trg_len").cast("int"))
    pad = F.array_repeat(F.lit(pad_id).cast("long"), 64 - (F.col("end") - F.col("begin")).cast("int"))
    target = mask_value(F.concat(target, pad), F.lit(pad_id).cast("long"))
    return j.select("doc_id", "begin", F.posexplode(target).alias("pos", "target")).select(
        "doc_id", "begin", F.col("pos").cast("long").alias("pos"), "target")


def parse_generated(spark, d):
    df = docs(spark, d)
    prompt = F.concat(F.col("lang"), F.lit("\t"), F.col("source"), F.lit("\n\n"))
    g = df.select("doc_id", F.concat(prompt, F.col("text")).alias("g"), F.length(prompt).alias("n"))
    return TX.parse_generated(g, "g", F.col("n"), ["label_lang", "label_source"], keep=["doc_id"])


def expand_prompts(spark, d):
    _, q = _lang_quotas(spark, d, 600)
    return TX.expand_prompts(q, 8, 2)


# ------------------------------------------------------------ vectors and losses


T_KD = 2.0


def _emb(spark, d):
    return io.table(spark, d, "embeddings")


def softmax_t(spark, d):
    return VC.softmax_long(_emb(spark, d), "vec_id", "embedding", T_KD).select(
        "vec_id", "pos", F.round("p", 6).alias("p"))


def log_softmax_t(spark, d):
    return VC.softmax_long(_emb(spark, d), "vec_id", "embedding", T_KD, log=True, name="logp").select(
        "vec_id", "pos", F.round("logp", 6).alias("logp"))


def mean_vector(spark, d):
    m = VC.mean_vector(_emb(spark, d), "embedding", "label")
    return m.select("label", "pos", F.round("mean", 6).alias("mean"))


def append_mean_vector(spark, d):
    out = VC.append_mean_vectors(_emb(spark, d), "vec_id", "embedding", 1)
    return out.select("vec_id", "pos", F.round("value", 6).alias("value"))


def _students(spark, d):
    return _emb(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("student"))


def _kd_pairs(spark, d):
    return VC.with_teacher_mean(_students(spark, d), "student", "label")


def kd_kl(spark, d):
    return VC.kd_kl(_kd_pairs(spark, d), "student", "teacher", T_KD, "label").select(
        "label", F.round("kl", 6).alias("kl"))


def kd_sequence_loss(spark, d):
    pairs = value_rank(_kd_pairs(spark, d), ["vec_id"], by=["label"], name="_r").withColumn("seq_pos", F.col("_r") - 1)
    return VC.kd_sequence_loss(pairs, "student", "teacher", T_KD, "label", "seq_pos", 5).select(
        "label", F.round("kl", 6).alias("kl"))


def hidden_mse(spark, d):
    return VC.hidden_mse(_kd_pairs(spark, d), "student", "teacher", "label").select(
        "label", F.round("mse", 6).alias("mse"))


def kd_loss(spark, d):
    pairs = _kd_pairs(spark, d)
    a = VC.kd_loss(pairs, "student", "teacher", "label", "label", T_KD, 0.4, 0.1)
    b = VC.kd_loss(_students(spark, d), "student", "teacher", "label", "label", T_KD, 0.0, 0.0)
    return a.unionByName(b).select("label", "lambda", F.round("loss", 6).alias("loss"))


def kd_loss_terms(spark, d):
    """Cross-entropy with a term of the user's own: a hundredth of the squared norm of the scores."""
    norm = F.aggregate("student", F.lit(0.0), lambda s, x: s + x * x)
    loss = VC.kd_loss(_students(spark, d), "student", "teacher", "label", "label", T_KD, 0.0, 0.0,
                      terms={"norm": F.lit(0.01) * norm})
    return loss.select("label", F.round("loss", 6).alias("loss"))


# ------------------------------------------------------------ privacy

def _scaled(spark, d):
    e = _emb(spark, d)
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * (
        F.lit(1) + F.col("vec_id") % 3)).alias("v"))


def clip_vectors(spark, d):
    c = PV.clip_vectors(_scaled(spark, d), "v", 1.5)
    return VC.to_long(c, "vec_id", "v").select("vec_id", "pos", F.round("value", 6).alias("value"))


def dp_clipped_mean(spark, d):
    return PV.dp_mean(_scaled(spark, d), "v", "label", 1.5, 0.0).select(
        "label", "pos", F.round("mean", 6).alias("mean"))


def dp_mean_noisy(spark, d):
    """Both releases noisy (sums and sizes), the labels public."""
    sigma = PV.gaussian_sigma(2.0, 1e-5, 1.0)
    return PV.dp_mean(_scaled(spark, d), "v", "label", 1.5, sigma, seed=SEED).select(
        "label", "pos", F.round("mean", 6).alias("mean"))


def dp_histogram(spark, d):
    sigma = PV.gaussian_sigma(2.0, 1e-5, 1.0)
    h = PV.dp_label_histogram(docs(spark, d), "lang", sigma, seed=SEED)
    return h.select("label", F.round("noisy_n", 6).alias("noisy_n"))


def _mechanisms(spark, d):
    """The event log as a mechanism table: a Gaussian release for each event, by type and user."""
    from quill.session import scratch_path

    ev = io.table(spark, d, "events")
    rows = ev.select(
        F.concat("event_type", F.lit("/user-"), F.col("user_id").cast("string")).alias("node"),
        F.lit("gaussian").alias("kind"), (F.lit(50.0) + F.abs("value")).alias("sigma"), F.lit(1.0).alias("sensitivity"),
        F.lit(1).alias("steps"), F.lit(1e-9).alias("delta"))
    path = scratch_path(spark, "mechanisms")
    PV.write_mechanisms(rows, path)
    return PV.read_mechanisms(spark, path)


def dp_sigma(spark, d):
    """Noise for one more release in each run's budget: the scale at which it may spend what is left of a target of
    1.25, 1.5, 2 or 4 times what the ledger says the run has spent."""
    runs = PV.spent(_mechanisms(spark, d)).where(~F.col("node").contains("/"))
    g = runs.select(F.col("node").alias("run"), "epsilon_rdp", F.explode(F.array(*[F.lit(x) for x in (1.25, 1.5, 2.0, 4.0)])).alias("share"))
    left = g.select("run", "share", (F.col("epsilon_rdp") * (F.col("share") - 1.0)).alias("epsilon"))
    return left.select("run", "share", F.round("epsilon", 6).alias("epsilon"),
                       F.round(PV.gaussian_sigma_col(F.col("epsilon"), 1e-5, 1.0), 6).alias("sigma"))


def bounded_contributions(spark, d):
    ev = io.table(spark, d, "events").select("event_id", "user_id")
    return PV.bound_contributions(ev, "user_id", 10, SEED, "event_id")


def privacy_ledger(spark, d):
    ev = io.table(spark, d, "events")
    mech = ev.select(F.col("event_type").alias("run"), (F.lit(50.0) + F.abs("value")).alias("sigma"),
                     F.lit(1).alias("steps"))
    led = PV.privacy_ledger(mech, 1e-5, range(2, 65))
    return led.select("run", "order", F.round("epsilon", 6).alias("epsilon"))


def budget_compose(spark, d):
    """What every run and every user of it has spent, by basic composition and by the Renyi rule."""
    return PV.spent(_mechanisms(spark, d)).select("node", F.round("epsilon_basic", 6).alias("epsilon_basic"),
                                                  F.round("epsilon_rdp", 6).alias("epsilon_rdp"),
                                                  F.round("delta", 12).alias("delta"))


# ------------------------------------------------------------ count models, candidates, scoring


PUBLIC = ["src0", "src1"]


def _lang_token_counts(spark, d):
    return MD.count_ngrams(tdocs(spark, d), label="lang", order=1)


def topk_candidates(spark, d):
    top = MD.top_k(_lang_token_counts(spark, d), ["label"], [F.col("n").desc(), F.col("token").asc()], 50)
    return top.select("label", "token", F.col("n").cast("long").alias("n"), F.col("rk").cast("long").alias("rk"))


def topp_candidates(spark, d):
    kept = MD.top_p(_lang_token_counts(spark, d), ["label"], 9, 10)
    return kept.select("label", "token", F.col("n").cast("long").alias("n"))


def penalised_candidates(spark, d):
    counts = _lang_token_counts(spark, d)
    tot = counts.groupBy("label").agg(F.sum("n").alias("_tot"))
    df = tdocs(spark, d)
    first = df.groupBy(F.col("lang").alias("label")).agg(F.min("doc_id").alias("doc_id"))
    seen = (df.join(first, "doc_id").select("label", F.explode(TX.tokens_col("text")).alias("token"))
            .distinct().withColumn("_seen", F.lit(True)))
    c = counts.join(tot, "label").join(seen, ["label", "token"], "left")
    score = MD.repetition_penalty(F.log(F.col("n") / F.col("_tot")), F.coalesce(F.col("_seen"), F.lit(False)), 1.2)
    return c.select("label", "token", F.round(score, 6).alias("score"))


def _dp_bigram_by_lang(spark, d, df=None):
    src = df if df is not None else tdocs(spark, d)
    return MD.fit_ngram(src, label="lang", order=2)


def fit_bigram(spark, d):
    return _dp_bigram_by_lang(spark, d).select("label", "prev", "token", "n")


#: Distinct pairs a text may count for in the noisy fit; its budget (half of delta for counts, half for keys).
NOISY_K, NOISY_EPSILON, NOISY_DELTA = 100, 8.0, 1e-5


def fit_bigram_noisy(spark, d):
    """A private bigram release: contributions bounded, counts noisy, keys under the safe threshold left out."""
    sigma = PV.gaussian_sigma(NOISY_EPSILON, NOISY_DELTA / 2, NOISY_K ** 0.5)
    fitted = MD.fit_ngram(tdocs(spark, d), label="lang", order=2, k=NOISY_K, sigma=sigma, tau="auto", seed=SEED,
                          delta_key=NOISY_DELTA / 2)
    return fitted.select("label", "prev", "token", F.round("n", 6).alias("n"))


def _train_test(spark, d):
    df = tdocs(spark, d)
    return df.where(F.col("doc_id") % 10 != 0), df.where(F.col("doc_id") % 10 == 0)


def _train_model(spark, d):
    train, _ = _train_test(spark, d)
    return MD.NgramModel.from_bigrams(MD.count_ngrams(train, order=2), alpha=1.0, kappa=1.0)


def ngram_nll(spark, d):
    _, test = _train_test(spark, d)
    rows = MD.bigram_rows(test, "doc_id")
    scored = EV.score_counted(_train_model(spark, d), rows, ["doc_id"])
    return scored.groupBy("doc_id").agg(F.sum("cnt").alias("n_tokens"),
                                        F.round(F.sum(F.col("nll") * F.col("cnt")) / F.sum("cnt"), 6).alias("nll"))


def ppl_macro(spark, d):
    _, test = _train_test(spark, d)
    t = EV.stream_targets(test, "doc_id", 128, 128)
    r = EV.ppl_macro(EV.score_counted(_train_model(spark, d), t, ["window"]))
    return r.select("n_windows", F.round("ppl", 6).alias("ppl"))


def _ppl_weighted(spark, d):
    _, test = _train_test(spark, d)
    t = EV.doc_lookback_targets(test, "doc_id", 1024, 512)
    scored = EV.score_counted(_train_model(spark, d), t, ["doc_id", "window", "trg_len", "n"])
    return EV.for_every_text(EV.ppl_weighted(scored, "doc_id"), test, "doc_id")


def ppl_weighted(spark, d):
    return _ppl_weighted(spark, d).select("doc_id", F.round("ppl", 6).alias("ppl"))


def ppl_mean_std(spark, d):
    r = EV.mean_std(_ppl_weighted(spark, d), "ppl")
    return r.select(F.round("ppl_mean", 6).alias("ppl_mean"), F.round("ppl_std", 6).alias("ppl_std"))


def _private(spark, d):
    return tdocs(spark, d).where(~F.col("source").isin(*PUBLIC))


def distil_mix(spark, d):
    teacher = MD.count_ngrams(_private(spark, d), order=2)
    conv = io.table(spark, d, "conversations")
    student = MD.count_ngrams(conv, order=2)
    return MD.mle_mix(teacher, student, 0.4).select("prev", "token", F.round("p", 6).alias("p"))


def dp_distil(spark, d):
    priv = _private(spark, d)
    teacher = MD.marginalise(_dp_bigram_by_lang(spark, d, priv))
    student = MD.fit_ngram(priv, order=2, beside="lang")
    return MD.mle_mix(teacher, student, 0.4).select("prev", "token", F.round("p", 6).alias("p"))


def _langs(spark, d):
    return docs(spark, d).select(F.col("lang").alias("label")).distinct()


#: Tokens of a sequence, its prompt among them.
SEQ_LEN = 128


def _teacher(spark, d):
    """The teacher by language, fitted on training texts: control code, text, end marker.  Written once: generation
    reads it more than once."""
    from quill.session import written

    return written(SY.fit_coded(tdocs(spark, d), ["lang"]), "teacher")


def fit_coded(spark, d):
    """The teacher by language and source."""
    coded = tdocs(spark, d).select("text", F.col("lang").alias("label_lang"), F.col("source").alias("label_source"))
    return SY.fit_coded(coded, P.label_columns(coded)).select("label", "prev", "token", "n")


def _prompts(spark, d, n):
    return GN.prompts_per_label(_langs(spark, d), n).withColumn("n_prompt", F.size(TX.tokens_col("label")))


def generate_greedy(spark, d):
    """The most frequent token at each step, up to the end marker or the full length."""
    return GN.generate(_teacher(spark, d), _prompts(spark, d, 3), SEQ_LEN, greedy=True, no_repeat=False,
                       eos=SY.EOS).select("seq_id", "label", "text")


def generate_greedy_ruled(spark, d):
    """Greedy under the bigram ban and a repetition penalty of 1.2."""
    return GN.generate(_teacher(spark, d), _prompts(spark, d, 3), SEQ_LEN, greedy=True, penalty=1.2,
                       eos=SY.EOS).select("seq_id", "label", "text")


def generate_warped(spark, d):
    """Sampled at temperature 0.7 under the bigram ban and a repetition penalty of 1.2."""
    return GN.generate(_teacher(spark, d), _prompts(spark, d, 50), SEQ_LEN, k=50, p=0.9, temperature=0.7, penalty=1.2,
                       seed=SEED, eos=SY.EOS).select("seq_id", "label", "text")


def _generate_text(spark, d):
    return GN.generate(_teacher(spark, d), _prompts(spark, d, 50), SEQ_LEN, k=50, p=0.9, temperature=1.0, penalty=1.0,
                       no_repeat=True, seed=SEED, eos=SY.EOS)


def generate_text(spark, d):
    return _generate_text(spark, d).select("seq_id", "label", "text")


def generated_no_repeat(spark, d):
    return GN.repeated_bigrams(_generate_text(spark, d))


# ------------------------------------------------------------ synthetic table, batched map, model report


def synthetic_rows(spark, d):
    """Conversations stand in for generated rows (label = role, text emptied
    for every ninth conversation): clean, cut to quotas (total 300), shuffle,
    store, read back."""
    from quill.session import scratch_path

    conv = io.table(spark, d, "conversations")
    gen = conv.select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
                      F.col("role").alias("label"))
    quotas = SY.label_quotas(conv.select(F.col("role").alias("label")), "label", 300)
    out = SY.finish_synthetic(gen, quotas, SEED, ["conv_id", "turn"])
    path = io.write_synthetic(out.select("text", "label", "conv_id", "turn"), scratch_path(spark, "synthetic"),
                              128, "conversations", 2.0)
    return spark.read.parquet(path).select("conv_id", "turn", "text", "label")


def map_batches(spark, d):
    return UD.map_batches(tdocs(spark, d).select("doc_id", "text"), UD.word_count, "doc_id long, n_words long")


def map_batches_args(spark, d):
    """The batched map with an argument for the user's function: words of five characters and more."""
    return UD.map_batches(tdocs(spark, d).select("doc_id", "text"), UD.word_count, "doc_id long, n_words long",
                          min_chars=5)


def model_report(spark, d):
    """Eight models on the held-out tenth; the synthetic one is fitted on a synthesis run over the private texts."""
    from quill.session import scratch_path

    train, test = _train_test(spark, d)
    public = train.where(F.col("source").isin(*PUBLIC))
    private = train.where(~F.col("source").isin(*PUBLIC))
    synthetic = spark.read.parquet(_synthesize(spark, _two_label_texts(private)))
    models = RP.build_models(private, public, synthetic, 2.0, 1e-5, scratch_path(spark, "report-models"), noise=False)
    r = RP.model_report(test, models)
    return r.select("model", "epsilon", F.round("ppl", 6).alias("ppl"))


def _synthesize(spark, train, metrics=None, total=600):
    from quill.session import scratch_path

    return SY.synthesize(train, P.label_columns(train), total, SEQ_LEN, scratch_path(spark, "synthesize"), "documents",
                         epsilon=2.0, batch=8, returns=2, k=50, p=0.9, seed=SEED, metrics=metrics)


def _two_label_texts(df):
    return df.select("text", F.col("lang").alias("label_lang"), F.col("source").alias("label_source"))


def synthetic_table(spark, d):
    """The whole synthesis chain on the corpus, two label columns: teacher by control code with end marker, quotas
    from the code counts (total 600), 8 x 2 candidates per batch, sampled generation (128 tokens with the prompt, k
    50, p 0.9), parsing, cleaning, cut to quota, shuffle, store, read back."""
    path = _synthesize(spark, _two_label_texts(tdocs(spark, d)))
    return spark.read.parquet(path).select("text", "label_lang", "label_source", "seq_id", "shuffle_key")


def generated_ppl(spark, d):
    """Metrics of a synthesis run: sequences generated, rows kept, and the mean and spread of the self-perplexity of
    everything generated under the teacher without codes."""
    from quill.session import scratch_path

    metrics = scratch_path(spark, "synthesis-metrics")
    _synthesize(spark, _two_label_texts(tdocs(spark, d)), metrics)
    return io.read_metrics(spark, metrics).select("run", "metric", F.round("value", 6).alias("value"))


def prepared_splits(spark, d):
    """The whole preparation job: all rows, labels
    lang/source seen more than 25 times, ``(text, label)``, 2 % test then 2 %
    val, written as CSV splits and read back ``(split, text, label)``."""
    from pyspark.sql.types import _parse_datatype_string

    from quill.plans import corpora
    from quill.session import scratch_path

    df = docs(spark, d).select("doc_id", "text", F.concat_ws("/", "lang", "source").alias("label"))
    out = scratch_path(spark, "prepared")
    corpora.prepare_frequent(df, "text", "label", "doc_id", out, 25, 0.02, 0.02, SEED, scan_frac=1.0,
                             fmt="csv", shards=8)
    back = io.read_splits(spark, out, _parse_datatype_string("text string, label string"), fmt="csv")
    return back.select("split", "text", "label")
