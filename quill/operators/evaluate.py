"""Scoring models on held-out text: per-token NLL, window perplexities and
the model report.

A window's loss is the mean NLL of its target tokens that have a context
inside the window (a causal model cannot predict the first position), so

* corpus stream, forward windows: token ``g`` is a target of the one window
  whose target range ``[prev_end, end)`` holds it, and is scored when
  ``g > begin``; ``ppl = exp(mean over windows of window NLL)``;
* per text, lookback windows: ``ppl = exp(sum(NLL_w * trg_len_w) / n)``.

Losses are summed in whole units of 10^-12 (:func:`exact_sum`), so a perplexity
has the same bits under any partitioning.

Every token row is scored through a join of its distinct ``(prev, token)``
pair to the model (not a per-row model lookup).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.text import tokens
from quill.operators.model import bigram_rows, ctx_key
from quill.operators.windows import corpus_offsets


UNIT = 1e-12
LARGEST = 1e6


def exact_sum(x: Column, times: Column | None = None) -> Column:
    """Sum of doubles (each ``times`` a whole number) that no order of the rows
    changes: every term is rounded to whole ``UNIT``s and the units are added as
    decimals.  Terms of ``LARGEST`` and more, infinite ones or NaN are added as
    doubles and are the sum alone."""
    small = F.abs(x) < F.lit(LARGEST)
    units = F.floor(F.when(small, x) * F.lit(1 / UNIT) + F.lit(0.5)).cast("decimal(19,0)")
    if times is not None:
        units = units * times.cast("decimal(18,0)")
        x = x * times
    return F.coalesce(F.sum(F.when(~small, x)), F.sum(units).cast("double") / F.lit(1 / UNIT))


def mean_std(df: DataFrame, col: str, prefix: str = "ppl") -> DataFrame:
    """Mean and population standard deviation."""
    return df.agg(F.avg(col).alias(f"{prefix}_mean"), F.stddev_pop(col).alias(f"{prefix}_std"))


def score_pairs(model, targets: DataFrame, name: str = "nll") -> DataFrame:
    """Add ``name`` = -ln p(token | prev) to every target row.  The model is
    evaluated once per distinct pair, then joined back."""
    pairs = targets.select("prev", "token").distinct()
    probs = model.prob(pairs, "_p").select(ctx_key("prev").alias("_sk"), F.col("token").alias("_st"),
                                           (-F.log("_p")).alias(name))
    t = targets.withColumn("_tk", ctx_key("prev"))
    return t.join(probs, (F.col("_tk") == F.col("_sk")) & (F.col("token") == F.col("_st"))).drop("_tk", "_sk", "_st")


def score_counted(model, targets: DataFrame, keys: list[str], name: str = "nll") -> DataFrame:
    """Pre-aggregate target tokens to ``(keys..., prev, token, cnt)`` before the
    join to the model (repeated pairs cross the shuffle once), then score."""
    agg = targets.groupBy(*keys, "prev", "token").agg(F.count(F.lit(1)).alias("cnt"))
    return score_pairs(model, agg, name)


def doc_lookback_targets(docs: DataFrame, id_col: str, max_len: int, stride: int, text: str = "text") -> DataFrame:
    """Scored tokens of each text under lookback windows:
    ``(id, window, trg_len, n, prev, token)``."""
    d = docs.select(id_col, tokens(text).alias("_toks")).withColumn("n", F.size("_toks").cast("long"))
    rows = bigram_rows(d, id_col, keep=["n"], toks="_toks")
    i = (F.col("pos") / F.lit(stride)).cast("long") * F.lit(stride)
    begin = F.greatest(i + F.lit(stride - max_len), F.lit(0))
    end = F.least(i + F.lit(stride), F.col("n"))
    rows = rows.withColumn("window", i).withColumn("trg_len", end - i)
    return rows.where(F.col("pos") > begin).select(id_col, "window", "trg_len", "n", "prev", "token")


def ppl_weighted(scored: DataFrame, id_col: str) -> DataFrame:
    """``exp(sum_w NLL_w * trg_len_w / n)`` per text; ``scored`` holds counted
    targets (``cnt``) or single tokens."""
    cnt = F.col("cnt") if "cnt" in scored.columns else F.lit(1)
    w = scored.groupBy(id_col, "window").agg((exact_sum(F.col("nll"), cnt) / F.sum(cnt)).alias("_nll"),
                                             F.first("trg_len").alias("_trg"), F.first("n").alias("_n"))
    return w.groupBy(id_col).agg(F.exp(exact_sum(F.col("_nll") * F.col("_trg")) / F.first("_n")).alias("ppl"))


def for_every_text(per: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """One row for every text: one without a scored token (fewer than two
    tokens) has a null value, which means and spreads leave out."""
    return texts.select(id_col).join(per, id_col, "left")


def stream_targets(docs: DataFrame, id_col: str, max_len: int, stride: int, text: str = "text") -> DataFrame:
    """Scored tokens of the corpus stream (texts in ``id_col`` order joined end
    to end; a blank-line joint adds no token): ``(window, prev, token)``.

    The context of a text's first token is the last token of the text that
    ends where this one starts (an equi-join on offsets), never a corpus-sized
    array or string.  Texts are tokenised twice: once for the table of lengths
    and last tokens, which is written, and once for the rows."""
    d = docs.select(id_col, tokens(text).alias("_toks")).withColumn("n_tokens", F.size("_toks").cast("long"))
    d = d.where(F.col("n_tokens") > 0).withColumn("_last", F.element_at("_toks", -1))
    offs = corpus_offsets(d.select(id_col, "n_tokens", "_last").checkpoint(), [id_col])
    ends = offs.select((F.col("start_offset") + F.col("n_tokens")).alias("_end"), F.col("_last").alias("_carry"))
    info = offs.join(ends, F.col("start_offset") == F.col("_end"), "left").select(id_col, "start_offset", "_carry")
    rows = bigram_rows(d.select(id_col, "_toks").join(info, id_col), id_col, keep=["start_offset", "_carry"],
                       toks="_toks")
    rows = rows.withColumn("prev", F.when(F.col("pos") == 0, F.col("_carry")).otherwise(F.col("prev")))
    g = F.col("start_offset") + F.col("pos")
    i = F.when(g < F.lit(max_len), F.lit(0).cast("long")).otherwise(
        ((g - F.lit(max_len - stride)) / F.lit(stride)).cast("long") * F.lit(stride))
    rows = rows.withColumn("_g", g).withColumn("_i", i)
    return rows.where(F.col("_g") > F.col("_i")).select((F.col("_i") / F.lit(stride)).cast("long").alias("window"),
                                                        "prev", "token")


def ppl_macro(scored: DataFrame) -> DataFrame:
    """``exp(mean over windows of the window's mean NLL)`` and the window count."""
    cnt = F.col("cnt") if "cnt" in scored.columns else F.lit(1)
    w = scored.groupBy("window").agg((exact_sum(F.col("nll"), cnt) / F.sum(cnt)).alias("_nll"))
    return w.agg(F.count(F.lit(1)).alias("n_windows"), F.exp(exact_sum(F.col("_nll")) / F.count("_nll")).alias("ppl"))


def score_generated(gen: DataFrame, model, id_col: str = "seq_id", max_len: int = 1024, stride: int = 512,
                    text: str = "text") -> DataFrame:
    """Self-perplexity of generated sequences: lookback windows, token-weighted
    (``(id, ppl)``, null for a sequence of fewer than two tokens);
    ``mean_std`` over it gives the mean and spread."""
    t = doc_lookback_targets(gen.select(id_col, text), id_col, max_len, stride, text)
    return for_every_text(ppl_weighted(score_counted(model, t, [id_col, "window", "trg_len", "n"]), id_col),
                          gen, id_col)


def nll(targets: DataFrame, model, name: str = "nll") -> DataFrame:
    """Negative log-likelihood of every target token under ``model`` (an
    alias of :func:`score_counted` for uncounted rows)."""
    return score_pairs(model, targets, name)


def perplexity(scored: DataFrame, how: str = "weighted", id_col: str = "doc_id") -> DataFrame:
    """``weighted``: per text, ``exp(sum NLL_w * trg_len_w / n)`` (lookback
    windows); ``macro``: ``exp(mean window NLL)`` over the corpus stream."""
    if how == "weighted":
        return ppl_weighted(scored, id_col)
    if how == "macro":
        return ppl_macro(scored)
    raise ValueError(how)
