"""Synthetic table assembly (over-generate, clean, cut to quota, shuffle, store).

A label is a control code: all label columns joined by TAB, as they stand before
a training text.  The teacher is fitted on training texts (control code, text, end
marker); every prompt is a control code, generation stops at the marker or where
prompt and text have the full length, and what was generated is parsed back into
label columns and text.  The step produces more candidates than needed per
prompt; each code's clean rows are cut to its quota at random, shuffled and written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions.text import control_prompt_expr, squash_ws, strip_ws, tokens
from quill.operators import evaluate as EV
from quill.operators import generate as GN
from quill.operators import model as MD
from quill.operators import prepare as P
from quill.operators import text as TX
from quill.session import written
from quill.sources import io

#: The end marker; a token of its own that texts do not hold.
EOS = "<eos>"


def coded_texts(df: DataFrame, labels: Sequence[str], eos: str = EOS, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., label, text)`` of the training texts of ``df``: control code + text + end marker, cut again at the
    code's length, so ``label`` is the code and the last token of ``text`` is the marker.  Null texts have no row."""
    prompt = control_prompt_expr(list(labels))
    t = TX.training_text(df.where(F.col(text).isNotNull()), labels, " " + eos, text=text, name="_train")
    head, tail = TX.split_prompt("_train", F.length(prompt))
    return t.select(*keep, strip_ws(head).alias("label"), tail.alias("text"))


def fit_coded(df: DataFrame, labels: Sequence[str], eos: str = EOS, text: str = "text", **fit) -> DataFrame:
    """A teacher ``(label, prev, token, n)`` by control code, end marker included (see :func:`model.fit_ngram`)."""
    return MD.fit_ngram(coded_texts(df, labels, eos, text), label="label", **fit)


def code_prompts(codes: DataFrame, number: str = "seq_no") -> DataFrame:
    """``(seq_id, label, n_prompt)`` of numbered control codes: the tokens of a code count in a sequence's length."""
    return codes.select(F.concat(F.col("label"), F.lit(":"), F.col(number).cast("string")).alias("seq_id"), "label",
                        F.size(tokens("label")).alias("n_prompt"))


def label_quotas(train: DataFrame, label: str, total: int) -> DataFrame:
    """Quota per label from the training table's label counts."""
    return P.allocate(P.value_counts(train.select(F.col(label).alias("label")), "label"), total)


def finish_synthetic(generated: DataFrame, quotas: DataFrame, seed, ids: Sequence[str],
                     text: str = "text", label: str = "label") -> DataFrame:
    """Collapse blanks, drop empty texts, cut each label to its quota at random
    and add a seeded shuffle position ``shuffle_key``."""
    clean = P.non_empty(generated.withColumn(text, squash_ws(text)), text)
    cut = P.stratified_sample(clean, label, quotas.select(F.col("label").alias(label), "quota"), seed, list(ids))
    return P.shuffle(cut, int(seed) + 1, list(ids))


def split_codes(df: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a control code and a text, parsed as one generated text: ``(keep..., labels..., text)``."""
    prompt = F.concat(F.col("label"), F.lit("\n\n"))
    return TX.parse_generated(df.select(*keep, F.concat(prompt, F.col("text")).alias("_g"), F.length(prompt).alias("_n")),
                              "_g", F.col("_n"), labels, keep=keep)


def synthesize(train: DataFrame, labels: Sequence[str], total: int, steps: int, folder: str, dataset: str,
               epsilon: float, batch: int = 64, returns: int = 2, k: int = 50, p: float = 0.9,
               temperature: float = 1.0, penalty: float = 1.0, seed=42, metrics: str | None = None,
               run: str = "synthesis", eos: str = EOS, **fit) -> str:
    """Teacher on ``train`` by control code, quotas from its codes, ``(q // batch + 1) * batch * returns`` candidates
    per code, generation, cleaning, cut, shuffle, write ``(text, labels..., seq_id, shuffle_key)``.  Returns the path.

    With a ``metrics`` folder it appends ``n_generated``, ``n_rows`` and the mean and spread of the self-perplexity of
    everything generated (``ppl_mean``, ``ppl_std``), scored by the teacher without codes."""
    teacher = written(fit_coded(train, labels, eos, **fit), "teacher")
    codes = train.where(F.col("text").isNotNull()).select(strip_ws(control_prompt_expr(list(labels))).alias("label"))
    quotas = label_quotas(codes, "label", total)
    prompts = code_prompts(TX.expand_prompts(quotas, batch, returns))
    gen = GN.generate(teacher, prompts, steps, k=k, p=p, temperature=temperature, penalty=penalty, seed=seed, eos=eos)
    out = finish_synthetic(gen, quotas, seed, ["seq_id"])
    path = io.write_synthetic(split_codes(out, labels, ["seq_id", "shuffle_key"]).select(
        "text", *labels, "seq_id", "shuffle_key"), folder, steps, dataset, epsilon)
    if metrics is not None:
        per = EV.score_generated(gen, MD.NgramModel.from_bigrams(
            written(MD.marginalise(teacher), "marginal"), materialize=False))
        rows = train.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
        stats = per.agg(F.count(F.lit(1)).cast("double").alias("n_generated"), F.avg("ppl").alias("ppl_mean"),
                        F.stddev_pop("ppl").alias("ppl_std"))
        both = stats.select("n_generated", "ppl_mean", "ppl_std").withColumn("_j", F.lit(1)).join(
            rows.withColumn("_j", F.lit(1)), "_j")
        io.append_metrics(both.select(F.lit(run).alias("run"), F.explode(F.array(*(
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("n_generated", "n_rows", "ppl_mean", "ppl_std")))).alias("_m")).select("run", "_m.metric", "_m.value"), metrics)
    return path
