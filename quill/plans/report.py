"""The model report: eight models scored on the held-out text.

Each row mirrors one model of the distillation study, re-aimed onto count
tables (private = training texts outside the public sources):

  student_dpkd        what ``dp_distil_student`` stored: half-budget DP bigram teacher and DP unigram student, 0.4 / 0.6
  student_syn_kd      what ``distil_student`` stored: teacher_cc without codes and the synthetic table, 0.4 / 0.6
  student_syn         bigram counts of the synthetic table
  student_dpsgd       DP unigram of private texts
  student_pretrained  unigram of public texts
  teacher_dpkd        DP bigram of private texts, half budget
  teacher_cc          DP bigram by control code of private texts, marginalised
  teacher_pretrained  bigram of public texts

Perplexity: forward windows over the held-out corpus stream.

One structure scores them all.  A model gives ``p(w | h) = a(h, w) + sum_i
b_i(h) u_i(w)``: a part for each stored pair and, for each of its back-off
distributions ``u_i``, a weight of the context.  Count models are that with ``a =
n / (c(h) + kappa)`` and ``b = kappa / (c(h) + kappa)``; stored distilled models
bring the numbers themselves, so unseen pairs need no count table.  All models'
rows form one long table of pairs, one of contexts and one of tokens, each pivoted
by a single aggregate to an array with a slot for each model; the held-out pairs
meet each of the three once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.operators import evaluate as EV
from quill.operators import model as MD
from quill.operators import privacy as PV
from quill.plans import training as TR


def build_models(private: DataFrame, public: DataFrame, synthetic: DataFrame, epsilon: float, delta: float, folder: str,
                 k: int = 200, noise: bool = True, seed=None, lam: float = 0.4, labels: tuple[str, ...] = ("lang",),
                 events: str | None = None) -> dict:
    """The eight models.  ``noise=False`` counts every key of every private
    text (the exact oracle).  Otherwise a fit at (eps, delta) spends half of
    delta on the Gaussian counts (sensitivity sqrt(k)) and half on releasing
    an unknown key set.  The DPKD student mixes a teacher and a student of
    its own, each at (epsilon / 2, delta / 2), and so spends (epsilon, delta).

    Distilled students are stored below ``folder``; with ``events`` every noisy fit is written to that mechanism
    table (see :func:`privacy.mechanism_rows`)."""
    def spec(part, budget, tag, **more):
        if not noise:
            return more
        half = delta * part / 2
        return dict(more, k=k, sigma=PV.gaussian_sigma(budget, half, float(k) ** 0.5), tau="auto",
                    delta_key=half, seed=None if seed is None else int(seed) + 2 * tag)

    from quill.functions.text import control_prompt_expr

    # The private fits share one tokenisation and one shuffle.
    specs = {
        "dpsgd": spec(1.0, epsilon, 0, order=1),
        "t_dpkd": spec(0.5, epsilon / 2, 1, order=2),
        "t_cc": spec(1.0, epsilon, 2, order=2, label="_code"),
    }
    if noise:
        specs["s_dpkd"] = spec(0.5, epsilon / 2, 3, order=1)
    coded = private.withColumn("_code", control_prompt_expr(list(labels), end=""))
    fits = MD.fit_ngram_many(coded, specs)
    if events is not None and noise:
        runs = {"dpsgd": "student_dpsgd", "t_dpkd": "student_dpkd", "s_dpkd": "student_dpkd", "t_cc": "teacher_cc"}
        for name, sp in specs.items():
            PV.write_mechanisms(PV.mechanism_rows(private.sparkSession, runs[name], name, sp["sigma"], float(k) ** 0.5,
                                                  sp["delta_key"], sp["delta_key"]), events)
    dpsgd = MD.NgramModel.unigram(fits["dpsgd"])
    s_dpkd = MD.NgramModel.unigram(fits["s_dpkd"]) if noise else dpsgd
    t_dpkd = MD.NgramModel.from_bigrams(fits["t_dpkd"])
    t_cc = MD.NgramModel.from_bigrams(MD.marginalise(fits["t_cc"]))
    syn = MD.NgramModel.from_bigrams(MD.count_ngrams(synthetic, order=2))
    # Public unigram counts are the marginal of the public bigram counts (each
    # token occurrence is one bigram): one pass over the public texts.
    t_pre = MD.NgramModel.from_bigrams(MD.count_ngrams(public, order=2))
    s_pre = MD.NgramModel.unigram(t_pre.unigrams, materialize=False)
    return {
        "student_dpkd": (TR.store_mixture(t_dpkd, s_dpkd, lam, f"{folder}/student_dpkd"), epsilon),
        "student_syn_kd": (TR.store_mixture(t_cc, syn, lam, f"{folder}/student_syn_kd"), epsilon),
        "student_syn": (syn, epsilon),
        "student_dpsgd": (dpsgd, epsilon),
        "student_pretrained": (s_pre, None),
        "teacher_dpkd": (t_dpkd, epsilon / 2),
        "teacher_cc": (t_cc, epsilon),
        "teacher_pretrained": (t_pre, None),
    }


@dataclass
class _Slots:
    """Rows of the three long tables, and each model's probability in terms of their slots."""

    pairs: list[DataFrame]
    contexts: list[DataFrame]
    tokens: list[DataFrame]
    probs: list[Column]


def _slot(df: DataFrame, slot: int, **cols) -> DataFrame:
    return df.select(F.lit(slot).alias("slot"), *[c.alias(n) for n, c in cols.items()])


def _at(array: str, slot: int, default: float = 0.0) -> Column:
    return F.coalesce(F.get(F.col(array), slot), F.lit(default))


def _laid_out(models: list) -> _Slots:
    out, seen = _Slots([], [], [], []), {}
    for m in models:
        if isinstance(m, TR.StoredModel):
            pair = len(out.pairs)
            out.pairs.append(_slot(m.part("pair"), pair, h=MD.ctx_key("prev"), w=F.col("token"), v=F.col("v")[0]))
            p = _at("pa", pair)
            for i, (weight, unseen) in enumerate(m.defaults()):
                c, t = len(out.contexts), len(out.tokens)
                out.contexts.append(_slot(m.part("context"), c, h=MD.ctx_key("prev"), v=F.col("v")[i]))
                out.tokens.append(_slot(m.part("token"), t, w=F.col("token"), v=F.col("v")[i]))
                p = p + _at("ca", c, weight) * _at("ta", t, unseen)
        else:
            if id(m.unigrams) not in seen:
                seen[id(m.unigrams)] = len(out.tokens)
                out.tokens.append(_slot(m.unigrams, len(out.tokens), w=F.col("token"), v=F.col("n")))
            t = seen[id(m.unigrams)]
            big_n, v = m.totals()
            p = (_at("ta", t) + m.alpha) / F.lit(big_n + m.alpha * (v + 1.0))
            if m.bigrams is not None:
                pair, c = len(out.pairs), len(out.contexts)
                key = MD.ctx_key("prev")
                out.pairs.append(_slot(m.bigrams, pair, h=key, w=F.col("token"), v=F.col("n")))
                out.contexts.append(_slot(m.bigrams, c, h=key, v=F.col("n")))
                p = (_at("pa", pair) + m.kappa * p) / (_at("ca", c) + m.kappa)
        out.probs.append(p)
    return out


def _pivoted(parts: list[DataFrame], keys: list[str], name: str) -> DataFrame:
    """One row a key with an array of the slots' sums; a slot without a row is null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    sums = F.array(*(F.sum(F.when(F.col("slot") == i, F.col("v"))) for i in range(len(parts))))
    return whole.groupBy(*keys).agg(sums.alias(name))


def scored_pairs(pairs: DataFrame, models: list) -> DataFrame:
    """``pairs`` (distinct ``prev, token``) with ``p``, the array of the models' probabilities: three joins."""
    laid = _laid_out(models)
    out = pairs.withColumn("h", MD.ctx_key("prev")).withColumnRenamed("token", "w").drop("prev")
    if laid.pairs:
        out = out.join(_pivoted(laid.pairs, ["h", "w"], "pa"), ["h", "w"], "left")
        out = out.join(_pivoted(laid.contexts, ["h"], "ca"), ["h"], "left")
    out = out.join(_pivoted(laid.tokens, ["w"], "ta"), ["w"], "left")
    return out.select("h", "w", F.array(*laid.probs).alias("p"))


def model_report(test: DataFrame, models: dict, id_col: str = "doc_id", max_len: int = 128,
                 stride: int = 128) -> DataFrame:
    """``(model, epsilon, ppl)``, one row per model.

    The scored targets are aggregated per ``(window, prev, token)`` and
    checkpointed; their distinct pairs are scored under all models at once and
    joined back, one window aggregate and one unpivot follow."""
    t = EV.stream_targets(test, id_col, max_len, stride)
    agg = t.groupBy("window", "prev", "token").agg(F.count(F.lit(1)).alias("cnt")).checkpoint(eager=True)
    names = list(models)
    pairs = scored_pairs(agg.select("prev", "token").distinct(), [models[n][0] for n in names])
    logs = pairs.select("h", "w", *[(-F.log(F.get("p", i))).alias(f"_l{i}") for i in range(len(names))])
    s = agg.select("window", "cnt", MD.ctx_key("prev").alias("h"), F.col("token").alias("w")).join(logs, ["h", "w"])
    w = s.groupBy("window").agg(*[(EV.exact_sum(F.col(f"_l{i}"), F.col("cnt")) / F.sum("cnt")).alias(f"_w{i}")
                                  for i in range(len(names))])
    r = w.agg(*[F.exp(EV.exact_sum(F.col(f"_w{i}")) / F.count(f"_w{i}")).alias(f"_q{i}") for i in range(len(names))])
    rows = [F.struct(F.lit(n).alias("model"), F.lit(models[n][1]).cast("double").alias("epsilon"),
                     F.col(f"_q{i}").alias("ppl")) for i, n in enumerate(names)]
    return r.select(F.explode(F.array(*rows)).alias("_r")).select("_r.model", "_r.epsilon", "_r.ppl")


def evaluate(test: DataFrame, models: dict, id_col: str = "doc_id", max_len: int = 128, stride: int = 128) -> DataFrame:
    """Score all models on the held-out texts (same as :func:`model_report`)."""
    return model_report(test, models, id_col, max_len, stride)


score_models = evaluate
