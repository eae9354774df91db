"""Model stages as jobs: a DP teacher, distilled students, and their ledger
and metrics rows.  Teachers are count tables, distilled students probability
tables with back-off, written as Parquet."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions.text import control_prompt_expr
from quill.operators import model as MD
from quill.operators import privacy as PV
from quill.sources import io


def _ledger_rows(spark: SparkSession, run: str, sigma: float, delta: float, steps: int = 1) -> DataFrame:
    mech = spark.createDataFrame([(run, float(sigma), int(steps))], "run string, sigma double, steps int")
    return PV.ledger_epsilon(PV.privacy_ledger(mech, delta))


def fit_teacher(train: DataFrame, labels: Sequence[str], epsilon: float, delta: float, out: str,
                metrics: str, run: str, k: int = 200, text: str = "text", seed=None) -> DataFrame:
    """DP bigram conditioned on the control code (all label columns joined).

    The budget's delta is split evenly: half for the Gaussian counts (sigma
    calibrated for (epsilon, delta/2) with sensitivity sqrt(k)), half for
    releasing an unknown key set (the automatic threshold).  Writes the model
    and appends ``(run, metric, value)`` rows: the RDP epsilon at delta/2 and
    both delta parts.  Returns the model."""
    code = control_prompt_expr(list(labels), end="")  # a null label is an error, not a skip
    d_gauss, d_keys = delta / 2, delta / 2
    sigma = PV.gaussian_sigma(epsilon, d_gauss, math.sqrt(k))
    model = MD.fit_ngram(train.select(code.alias("label"), text), text, label="label", k=k, sigma=sigma,
                         tau="auto", seed=seed, delta_key=d_keys)
    model.write.mode("overwrite").parquet(out)
    spark = train.sparkSession
    spent = _ledger_rows(spark, run, sigma / math.sqrt(k), d_gauss)
    rows = spent.select("run", F.lit("final_epsilon_rdp").alias("metric"), F.col("epsilon").alias("value")).unionByName(
        spark.createDataFrame([(run, "delta_gaussian", d_gauss), (run, "delta_key_release", d_keys)],
                              "run string, metric string, value double"))
    io.append_metrics(rows, metrics)
    return spark.read.parquet(out)


@dataclass
class StoredModel:
    """A model that is a written table ``(part, prev, token, v)``; it needs no counts to give every pair its mass:
    ``p(w | h) = pair(h, w) + sum_i context(h)[i] * token(w)[i]``.

    ``pair`` rows hold one number, ``context`` rows the weights of the back-off distributions behind a context, ``token``
    rows the probabilities under them; what has no row has 0, the row ``weight`` and the row ``unseen``."""

    table: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.table.where(F.col("part") == name).select("prev", "token", "v")

    def defaults(self) -> list[tuple[float, float]]:
        """Weight behind an unseen context and probability of an unseen token, for each back-off distribution."""
        rows = {r["part"]: r["v"] for r in self.table.where(F.col("part").isin("weight", "unseen")).collect()}
        return list(zip(rows["weight"], rows["unseen"], strict=True))

    def prob(self, pairs: DataFrame, name: str = "p") -> DataFrame:
        """Add ``name`` = p(token | prev) to a table of distinct ``(prev, token)``."""
        key = MD.ctx_key("prev")
        a = self.part("pair").select(key.alias("_h"), F.col("token").alias("_w"), F.col("v")[0].alias("_a"))
        c = self.part("context").select(key.alias("_ch"), F.col("v").alias("_b"))
        t = self.part("token").select(F.col("token").alias("_tw"), F.col("v").alias("_u"))
        d = pairs.withColumn("_k", key)
        d = d.join(a, (F.col("_k") == F.col("_h")) & (F.col("token") == F.col("_w")), "left").drop("_h", "_w")
        d = d.join(c, F.col("_k") == F.col("_ch"), "left").drop("_ch", "_k").join(t, F.col("token") == F.col("_tw"), "left")
        p = F.coalesce(F.col("_a"), F.lit(0.0))
        for i, (weight, unseen) in enumerate(self.defaults()):
            p = p + F.coalesce(F.col("_b")[i], F.lit(weight)) * F.coalesce(F.col("_u")[i], F.lit(unseen))
        return d.withColumn(name, p).drop("_a", "_b", "_u", "_tw")


def store_mixture(teacher: MD.NgramModel, student: MD.NgramModel, lam: float, out: str) -> StoredModel:
    """``lam * teacher + (1 - lam) * student`` (the minimiser of the mixed KL / CE loss per context at T = 1) as a stored
    model: the parts' pairs add up, each part brings its back-off distribution."""
    parts = [(lam, teacher), (1.0 - lam, student)]
    pairs, contexts, tokens, weight, unseen = [], [], [], [], []
    for i, (share, m) in enumerate(parts):
        big_n, v = m.totals()
        floor = big_n + m.alpha * (v + 1.0)
        weight.append(share)
        unseen.append(m.alpha / floor)
        tokens.append(m.unigrams.select(F.lit(i).alias("i"), "token", ((F.col("n") + m.alpha) / F.lit(floor)).alias("x")))
        if m.bigrams is not None:
            counts = m.bigrams.select(MD.ctx_key("prev").alias("h"), "token", "n")
            whole = counts.groupBy(F.col("h").alias("_h")).agg((F.sum("n") + m.kappa).alias("_c"))
            pairs.append(counts.join(whole, F.col("h") == F.col("_h")).select(
                "h", "token", (F.lit(share) * F.col("n") / F.col("_c")).alias("x")))
            contexts.append(whole.select(F.lit(i).alias("i"), F.col("_h").alias("h"),
                                         (F.lit(share * m.kappa) / F.col("_c")).alias("x")))

    def union(dfs: list[DataFrame]) -> DataFrame:
        whole = dfs[0]
        for df in dfs[1:]:
            whole = whole.unionByName(df)
        return whole

    def slots(default: list[float]):
        return F.array(*(F.coalesce(F.sum(F.when(F.col("i") == i, F.col("x"))), F.lit(x)) for i, x in enumerate(default)))

    def row(df: DataFrame, part: str, prev, token, v) -> DataFrame:
        return df.select(F.lit(part).alias("part"), prev.cast("string").alias("prev"), token.cast("string").alias("token"),
                         v.alias("v"))

    none, h = F.lit(None), F.when(F.col("h") != "", F.col("h"))
    spark = teacher.unigrams.sparkSession
    rows = [row(union(tokens).groupBy("token").agg(slots(unseen).alias("v")), "token", none, F.col("token"), F.col("v")),
            row(spark.range(1), "weight", none, none, F.array(*map(F.lit, weight))),
            row(spark.range(1), "unseen", none, none, F.array(*map(F.lit, unseen)))]
    if pairs:
        rows.append(row(union(pairs).groupBy("h", "token").agg(F.sum("x").alias("x")), "pair", h, F.col("token"), F.array("x")))
        rows.append(row(union(contexts).groupBy("h").agg(slots(weight).alias("v")), "context", h, none, F.col("v")))
    union(rows).write.mode("overwrite").partitionBy("part").parquet(out)
    return StoredModel(spark.read.schema("prev string, token string, v array<double>, part string").parquet(out))


def distil_student(teacher: DataFrame, student_text: DataFrame, lam: float, out: str, text: str = "text",
                   label: str | None = "label") -> StoredModel:
    """Student from synthetic (or any non-private) text: the label-marginalised teacher mixed with the student's own
    bigram counts, ``lam * teacher + (1 - lam) * empirical``, both smoothed; stored with its back-off weights."""
    t = MD.marginalise(teacher, label) if label and label in teacher.columns else teacher
    s = MD.count_ngrams(student_text, text, order=2)
    return store_mixture(MD.NgramModel.from_bigrams(t), MD.NgramModel.from_bigrams(s), lam, out)


def dp_distil_student(private: DataFrame, label: str, epsilon: float, delta: float, lam: float, out: str,
                      metrics: str, run: str, k: int = 200, text: str = "text", seed=None,
                      events: str | None = None) -> StoredModel:
    """Distillation on private text: teacher and student counts each get half
    the budget (basic composition), both are DP fits, the student mixes them.
    Each fit has half of epsilon and of delta, and spends half of its delta on
    the Gaussian counts and half on the key release.  Writes the stored student
    and the ledger rows: epsilon and both sums of delta parts; with ``events``
    also both fits to that mechanism table, below the run's name."""
    half, part = epsilon / 2, delta / 4
    sigma = PV.gaussian_sigma(half, part, math.sqrt(k))
    teacher = MD.marginalise(MD.fit_ngram(private, text, label=label, k=k, sigma=sigma, tau="auto", seed=seed,
                                          delta_key=part))
    student = MD.fit_ngram(private, text, k=k, sigma=sigma, tau="auto", delta_key=part,
                           seed=None if seed is None else int(seed) + 2)
    model = store_mixture(MD.NgramModel.from_bigrams(teacher), MD.NgramModel.from_bigrams(student), lam, out)
    spark = private.sparkSession
    if events is not None:
        for part_name in ("teacher", "student"):
            PV.write_mechanisms(PV.mechanism_rows(spark, run, part_name, sigma, math.sqrt(k), part, part), events)
    parts = spark.createDataFrame([(run, "teacher", half), (run, "student", half)], "run string, part string, epsilon double")
    rows = PV.compose(parts).select("run", F.lit("epsilon_basic").alias("metric"), F.col("epsilon").alias("value"))
    io.append_metrics(rows.unionByName(spark.createDataFrame(
        [(run, "delta_gaussian", 2 * part), (run, "delta_key_release", 2 * part)],
        "run string, metric string, value double")), metrics)
    return model
