"""Token-position windows, corpus offsets and packing.

Window bounds follow the two scoring loops of the reference:

* lookback (``i`` in steps of ``stride``): ``begin = max(i + stride - max_len, 0)``,
  ``end = min(i + stride, n)``, ``trg_len = end - i``;
* forward: ``begin = i``, ``end = min(i + max_len, n)``, ``trg_len = end - prev_end``,
  stopping after the first window that reaches ``n``; in closed form
  ``prev_end = 0`` for ``i = 0`` else ``min(i - stride + max_len, n)`` and a
  window exists when ``i = 0`` or ``prev_end < n``.

A whole corpus is never joined into one string: each document knows its
token offset in the corpus (a running sum), and corpus windows and packed
blocks are generated from the documents that overlap them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.text import tokens
from quill.operators.rank import offsets, rank_and_offset, value_rank


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window_struct(i: Column, n: Column, max_len: int, stride: int, kind: str) -> Column:
    if kind == "lookback":
        begin = F.greatest(i + F.lit(stride - max_len), F.lit(0))
        end = F.least(i + F.lit(stride), n)
        trg = end - i
    elif kind == "forward":
        begin = i
        end = F.least(i + F.lit(max_len), n)
        trg = end - F.when(i == 0, F.lit(0)).otherwise(F.least(i + F.lit(max_len - stride), n))
    else:
        raise ValueError(kind)
    return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"), trg.cast("long").alias("trg_len"))


def forward_exists(i: Column, n: Column, max_len: int, stride: int) -> Column:
    return (i == 0) | (F.least(i + F.lit(max_len - stride), n) < n)


def strided_windows(df: DataFrame, n_col: str, max_len: int, stride: int, kind: str = "forward",
                    keep: Sequence[str] = ()) -> DataFrame:
    """One row per window of each sequence of length ``n_col``: ``begin, end, trg_len``."""
    n = F.col(n_col).cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stride).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))
    d = df.select(*keep, n.alias("_n"), F.explode(starts).alias("_i"))
    if kind == "forward":
        d = d.where(forward_exists(F.col("_i"), F.col("_n"), max_len, stride))
    w = window_struct(F.col("_i"), F.col("_n"), max_len, stride, kind)
    return d.select(*keep, w.alias("_w")).select(*keep, "_w.begin", "_w.end", "_w.trg_len")


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens") -> DataFrame:
    return df.withColumn(name, F.size(tokens(text)).cast("long"))


def corpus_offsets(df: DataFrame, order: Sequence, size: str = "n_tokens", name: str = "start_offset") -> DataFrame:
    """Each row's start offset in the concatenation of all rows in ``order``."""
    return offsets(df, order, F.col(size), name=name)


def global_offsets(df: DataFrame, order: Sequence, size: str, name: str = "start_offset") -> DataFrame:
    """Running offset of each row in the concatenation of all rows (W4)."""
    return corpus_offsets(df, order, size, name)


def corpus_windows(offsets: DataFrame, max_len: int, stride: int, size: str = "n_tokens",
                   start: str = "start_offset") -> DataFrame:
    """Forward windows over the whole corpus token stream, generated by the
    documents holding each window's first token (no corpus-sized array)."""
    total = offsets.agg(F.sum(size)).first()[0] or 0
    n = F.lit(int(total)).cast("long")
    s = F.col(start)
    k0 = F.ceil(s / F.lit(stride)).cast("long")
    k1 = F.floor((s + F.col(size) - 1) / F.lit(stride)).cast("long")
    starts = F.when((F.col(size) > 0) & (k0 <= k1), F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))
    d = offsets.select(F.explode(starts).alias("window_id"))
    i = F.col("window_id") * F.lit(stride)
    d = d.where(forward_exists(i, n, max_len, stride))
    w = window_struct(i, n, max_len, stride, "forward")
    return d.select("window_id", w.alias("_w")).select("window_id", "_w.begin", "_w.end", "_w.trg_len")


def pack_blocks(df: DataFrame, order: Sequence, id_col: str, batch_rows: int = 1000, block: int = 128,
                text: str = "text") -> DataFrame:
    """Concatenate the tokens of each batch of ``batch_rows`` consecutive rows,
    drop the batch's remainder and cut it into blocks of ``block`` tokens:
    ``(block_id, pos, token)`` with block ids numbered across batches."""
    cols = list(dict.fromkeys([id_col, *order]))
    # Lengths are written once: ranks, offsets and batches read them instead of the texts.
    d = df.select(*cols, F.size(tokens(text)).cast("long").alias("_nt")).checkpoint()
    if len(order) == 1 and isinstance(order[0], str) and type(d.schema[order[0]].dataType).__name__ in (
            "LongType", "IntegerType", "ShortType", "ByteType"):
        # One bucketed pass: row rank (for batches) and token offset together.
        d = rank_and_offset(d, order[0], F.col("_nt"), rank="_r", offset="_g")
        d = d.withColumn("batch", ((F.col("_r") - 1) / F.lit(batch_rows)).cast("long"))
        per = d.groupBy("batch").agg(F.min("_g").alias("_b0"), (F.sum("_nt") / F.lit(block)).cast("long").alias("_nb"))
        d = d.join(per.select("batch", "_b0"), "batch").withColumn("_off", F.col("_g") - F.col("_b0"))
        batches = offsets(per.select("batch", "_nb"), ["batch"], F.col("_nb"), name="_bb")
    else:
        d = value_rank(d, order, name="_r").withColumn("batch", ((F.col("_r") - 1) / F.lit(batch_rows)).cast("long"))
        d = offsets(d, order, F.col("_nt"), by=["batch"], name="_off")
        batches = d.groupBy("batch").agg((F.sum("_nt") / F.lit(block)).cast("long").alias("_nb"))
        batches = offsets(batches, ["batch"], F.col("_nb"), name="_bb")
    starts = d.select(id_col, "batch", "_off").join(batches, "batch")
    # Join per-row offsets to the rows first, then explode: one row per text
    # crosses the shuffle, not one row per token.
    t = df.select(id_col, text).join(starts, id_col)
    t = t.select("_off", "_nb", "_bb", F.posexplode(tokens(text)).alias("_p", "token"))
    t = t.withColumn("_o", F.col("_off") + F.col("_p"))
    t = t.where((F.col("_o") / F.lit(block)).cast("long") < F.col("_nb"))
    return t.select((F.col("_bb") + (F.col("_o") / F.lit(block)).cast("long")).alias("block_id"),
                    (F.col("_o") % F.lit(block)).cast("long").alias("pos"), "token")
