"""Text operators: control-code prompts, tokenising, padding, vocabulary,
encode/decode, parsing generated text, prompt replication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.text import control_prompt_expr, squash_ws, strip_ws, tokens
from quill.operators.rank import value_rank


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def control_prompt(df: DataFrame, labels: Sequence[str], name: str = "prompt") -> DataFrame:
    """``label1<TAB>label2...<LF><LF>``; a null label raises."""
    return df.withColumn(name, control_prompt_expr(list(labels)))


def training_text(df: DataFrame, labels: Sequence[str], eos: str, use_cc=True, text: str = "text",
                  name: str = "train_text") -> DataFrame:
    """Prompt + text + end marker when control codes are on, the bare text otherwise.
    ``use_cc`` may be a bool or a boolean column (per-row choice)."""
    cc = F.concat(control_prompt_expr(list(labels)), _c(text), F.lit(eos))
    flag = use_cc if isinstance(use_cc, Column) else F.lit(bool(use_cc))
    return df.withColumn(name, F.when(flag, cc).otherwise(_c(text)))


def tokens_col(text) -> Column:
    return tokens(text)


def token_array(df: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
    return df.withColumn(name, tokens(text))


def padded(toks, length: int, pad) -> Column:
    """Truncate to ``length`` and right-pad with ``pad`` to exactly ``length``."""
    toks = _c(toks)
    head = F.slice(toks, 1, length)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(head), F.lit(0)))
    return F.concat(head, fill)


def tokenize_pad(df: DataFrame, length: int, pad: str, id_col: str = "doc_id", text: str = "text",
                 mask_pad: bool = True) -> DataFrame:
    """Long form ``(id, pos, token, mask, target)``, exactly ``length`` rows per text.

    ``target`` copies the token (the model's labels); with ``mask_pad`` padding
    positions get a null target, the long-form ``-100``.
    """
    d = df.select(_c(id_col).alias(id_col), tokens(text).alias("_t"))
    d = d.select(id_col, F.least(F.size("_t"), F.lit(length)).alias("_n"),
                 F.posexplode(padded("_t", length, pad)).alias("pos", "token"))
    real = F.col("pos") < F.col("_n")
    tgt = F.when(real, F.col("token")) if mask_pad else F.col("token")
    return d.select(id_col, F.col("pos").cast("long").alias("pos"), "token",
                    real.cast("int").alias("mask"), tgt.alias("target"))


def token_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per token: ``(id, pos, token)`` with 0-based positions."""
    return df.select(_c(id_col).alias(id_col), *keep, F.posexplode(tokens(text)).alias("pos", "token")).withColumn(
        "pos", F.col("pos").cast("long"))


def build_vocab(tok: DataFrame, min_count: int = 1, pad: str | None = "[PAD]", token: str = "token") -> DataFrame:
    """``(token_id, token, n)``: tokens seen at least ``min_count`` times, ids by
    count descending then token, from 0; the pad token comes last with n = 0.

    Counting is a partial aggregate; ids come from a range-partitioned rank, so
    no single task sees the whole vocabulary.
    """
    counts = tok.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= F.lit(min_count)).checkpoint()  # ranks, ids and the pad's id read them, not the texts
    ranked = value_rank(counts, [F.col("n").desc(), F.col("token").asc()], name="_r")
    vocab = ranked.select((F.col("_r") - 1).alias("token_id"), "token", "n")
    if pad is None:
        return vocab
    pad_row = counts.agg(F.count(F.lit(1)).alias("token_id")).select(
        "token_id", F.lit(pad).alias("token"), F.lit(0).cast("long").alias("n"))
    return vocab.unionByName(pad_row)


def encode(tok: DataFrame, vocab: DataFrame, unknown: int = -1, token: str = "token") -> DataFrame:
    """Token -> id through the vocabulary (equi-join; unknown tokens get ``unknown``).

    The vocabulary grows with the corpus, so it is not forced to broadcast: AQE
    broadcasts it when small and splits skewed (very frequent) tokens otherwise.
    """
    v = vocab.select(F.col("token").alias("_tok"), F.col("token_id").alias("_id"))
    j = tok.join(v, F.col(token) == F.col("_tok"), "left")
    return j.withColumn("token_id", F.coalesce(F.col("_id"), F.lit(unknown).cast("long"))).drop("_tok", "_id")


def decode(ids: DataFrame, vocab: DataFrame, id_col: str = "doc_id", skip_ids: Column | None = None,
           name: str = "text") -> DataFrame:
    """Ids -> text per sequence, skipping special ids (pad, unknown): join the
    vocabulary, then rebuild each sequence in position order.  A sequence is
    bounded by its own length."""
    v = vocab.select(F.col("token_id").alias("_id"), F.col("token").alias("_tok"))
    d = ids
    if skip_ids is not None:
        d = d.where(~skip_ids)
    d = d.join(v, F.col("token_id") == F.col("_id"))
    return d.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_tok"))), lambda x: x["_tok"]),
                     " ").alias(name))


def split_prompt(generated, n) -> tuple[Column, Column]:
    """Cut generated text at the prompt length (characters)."""
    g = _c(generated)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.substring(g, F.lit(1), n), F.substring(g, n + 1, F.lit(1 << 30))


def parse_labels(prompt_part) -> Column:
    """Labels from the prompt part of a generated text: strip, split on TAB."""
    return F.split(strip_ws(_c(prompt_part)), "\t")


def parse_generated(df: DataFrame, generated: str, prompt_len, label_names: Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    """Generated text -> ``(labels..., text)``: labels from the stripped prompt
    part split on TAB, text with blank runs collapsed."""
    head, tail = split_prompt(generated, prompt_len)
    parts = parse_labels(head)
    cols = [F.get(parts, i).alias(nm) for i, nm in enumerate(label_names)]
    return df.select(*keep, *cols, squash_ws(tail).alias("text"))


def expand_prompts(quotas: DataFrame, batch: int, returns: int, key: str = "label", chunk: int = 4096) -> DataFrame:
    """``(q // batch + 1) * batch * returns`` candidate rows per prompt, numbered
    from 1.  Large counts are first cut into chunks so no single task emits a
    whole prompt's candidates."""
    total = ((F.col("quota") / F.lit(batch)).cast("long") + 1) * F.lit(batch * returns)
    c = quotas.select(key, total.alias("_tot"))
    c = c.select(key, "_tot", F.explode(F.sequence(F.lit(0).cast("long"),
                                                   ((F.col("_tot") - 1) / F.lit(chunk)).cast("long"))).alias("_ch"))
    c = c.repartition(key, "_ch")
    lo = F.col("_ch") * F.lit(chunk) + 1
    hi = F.least(F.col("_tot"), (F.col("_ch") + 1) * F.lit(chunk))
    return c.select(key, F.explode(F.sequence(lo, hi)).alias("seq_no"))
