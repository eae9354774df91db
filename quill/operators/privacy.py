"""Differential-privacy operators on tables: clip, noisy sums and means,
noise calibration, contribution bounding, and an RDP privacy ledger.

Mechanism accounting here is the unsubsampled Gaussian mechanism: it gives
an upper bound and ignores amplification by subsampling.  Test runs pass a
seed for repeatable noise, which is NOT private; releases use ``seed=None``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.arrays import clip_l2
from quill.functions.hashing import gaussian
from quill.operators.rank import hash_rank, join_on


def _names(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    """Noise scale reaching (epsilon, delta) for one Gaussian release, from the
    RDP bound ``eps = D^2/(2 s^2) + D L / s`` with ``L = sqrt(2 ln(1/delta))``:
    ``s = D / (sqrt(L^2 + 2 eps) - L)``.  Valid for every eps > 0."""
    L = math.sqrt(2.0 * math.log(1.0 / delta))
    return sensitivity / (math.sqrt(L * L + 2.0 * epsilon) - L)


def gaussian_sigma_col(epsilon: Column, delta: float, sensitivity: float = 1.0) -> Column:
    L = math.sqrt(2.0 * math.log(1.0 / delta))
    return F.lit(sensitivity) / (F.sqrt(F.lit(L * L) + F.lit(2.0) * epsilon) - F.lit(L))


def key_threshold(sigma: float, k: int, delta_key: float) -> float:
    """Release threshold for an unknown key set: ``1 + sigma sqrt(2 ln(k/delta'))``."""
    return 1.0 + sigma * math.sqrt(2.0 * math.log(k / delta_key))


def clip_vectors(df: DataFrame, vec: str, c: float, name: str | None = None) -> DataFrame:
    return df.withColumn(name or vec, clip_l2(vec, c))


def dp_mean(df: DataFrame, vec: str, by, c: float, sigma: float, seed=None, name: str = "mean",
            tau: float | None = None) -> DataFrame:
    """Noisy clipped mean per group, long form: clip every record to L2 norm
    ``c``, sum per (group, position), add ``N(0, (sigma c)^2)``, divide by the
    group size.  With noise the size is noisy too (``N(0, sigma^2)``, one draw
    a group, at least 1): two Gaussian releases of multiplier ``sigma``.
    Groups whose noisy size is under ``tau`` are left out; without ``tau`` the
    caller vouches that the groups are public (see :func:`key_threshold`)."""
    by = _names(by)
    if sigma:
        return _dp_mean_noisy(df, vec, by, c, sigma, seed, name, tau)
    x = df.select(*by, F.posexplode(clip_l2(vec, c)).alias("pos", "_x"))
    agg = x.groupBy(*by, F.col("pos").cast("long").alias("pos")).agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return agg.select(*by, "pos", (F.col("_s") / F.col("_n")).alias(name))


def _dp_mean_noisy(df: DataFrame, vec: str, by: list[str], c: float, sigma: float, seed, name: str,
                   tau: float | None) -> DataFrame:
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    ids = [F.coalesce(F.col(b).cast("string"), F.lit("")) for b in keys]
    sizes = rows.where(F.size(vec) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_n", F.col("_n") + F.lit(float(sigma)) * gaussian(
        None if seed is None else int(seed) + 2, *ids))
    if tau is not None:
        sizes = _drawn_once(sizes, sigma, seed).where(F.col("_n") >= F.lit(float(tau)))
    sizes = sizes.withColumn("_n", F.greatest(F.col("_n"), F.lit(1.0)))
    sums = rows.select(*keys, F.posexplode(clip_l2(vec, c)).alias("pos", "_x")).groupBy(
        *keys, F.col("pos").cast("long").alias("pos")).agg(F.sum("_x").alias("_s"))
    noisy = sums.withColumn("_s", F.col("_s") + F.lit(sigma * c) * gaussian(seed, *ids, F.col("pos")))
    out = join_on(noisy, _drawn_once(sizes, sigma, seed), keys).select(
        *by, "pos", (F.col("_s") / F.col("_n")).alias(name))
    return _drawn_once(out, sigma, seed)


def _drawn_once(df: DataFrame, sigma: float, seed) -> DataFrame:
    """Materialise a release carrying real (unseeded) noise, so a recomputed
    stage never redraws it; seeded test noise is a function of the row and
    needs no copy."""
    return df.checkpoint(eager=True) if sigma and seed is None else df


def dp_label_histogram(df: DataFrame, label: str, sigma: float, seed=None, name: str = "noisy_n",
                       tau: float | None = None) -> DataFrame:
    """Label counts plus Gaussian noise, clamped at 0 (sensitivity 1 per row).
    Labels whose noisy count is under ``tau`` are left out; without ``tau`` the
    caller vouches that the labels are public (see :func:`key_threshold`)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    noise = gaussian(seed, F.col("label"))
    out = counts.select("label", F.greatest(F.lit(0.0), F.col("_n") + F.lit(sigma) * noise).alias(name))
    out = _drawn_once(out, sigma, seed)
    return out if tau is None else out.where(F.col(name) >= F.lit(float(tau)))


def bound_contributions(df: DataFrame, who: str, k: int, seed, ids) -> DataFrame:
    """At most ``k`` rows per contributor, chosen in hash order.  A contributor
    holding a large share of rows is spread over many hash buckets."""
    return hash_rank(df, seed, ids, by=who, limit=int(k), name="_r").drop("_r")


def privacy_ledger(mechanisms: DataFrame, delta: float, orders: Sequence[int] = range(2, 65),
                   run: str = "run", sigma: str = "sigma", steps: str = "steps") -> DataFrame:
    """epsilon at each Renyi order for each run: ``sum(steps * a / (2 s^2)) +
    ln(1/delta) / (a - 1)``.  Mechanisms are summed per run first (partial
    aggregate), then the order grid is generated per run."""
    per = mechanisms.groupBy(F.col(run).alias("run")).agg(
        F.sum(F.col(steps).cast("double") / (F.lit(2.0) * F.col(sigma) * F.col(sigma))).alias("_rho"))
    grid = F.array(*[F.lit(int(o)) for o in orders])
    x = per.select("run", "_rho", F.explode(grid).alias("order"))
    eps = F.col("order") * F.col("_rho") + F.lit(math.log(1.0 / delta)) / (F.col("order") - 1)
    return x.select("run", F.col("order").cast("int").alias("order"), eps.alias("epsilon"))


def ledger_epsilon(ledger: DataFrame) -> DataFrame:
    """The spent epsilon of each run: the minimum over orders."""
    return ledger.groupBy("run").agg(F.min("epsilon").alias("epsilon"))


def compose(ledger: DataFrame, how: str = "basic", run: str = "run", epsilon: str = "epsilon") -> DataFrame:
    """Basic composition: epsilons of the mechanisms of a run add up."""
    if how != "basic":
        raise ValueError(how)
    return ledger.groupBy(F.col(run).alias("run")).agg(F.sum(epsilon).alias("epsilon"))


# ------------------------------------------------------------ ledger of mechanism events

#: A table of events: every noisy release of a run writes what it used.  ``node`` is the place in the budget's tree, as a
#: path (``run/teacher``); ``kind`` is ``gaussian`` (noise ``sigma`` at ``sensitivity``, ``steps`` times, each at its part
#: ``delta``) or ``keys`` (the release of an unknown key set, which costs ``delta`` only).
MECHANISMS = "node string, kind string, sigma double, sensitivity double, steps int, delta double"


def mechanism_rows(spark, run: str, part: str, sigma: float, sensitivity: float, delta: float, delta_keys: float = 0.0,
                   steps: int = 1) -> DataFrame:
    """The events of one noisy fit: its Gaussian counts and, with ``delta_keys``, its key release."""
    rows = [(f"{run}/{part}", "gaussian", float(sigma), float(sensitivity), int(steps), float(delta))]
    if delta_keys:
        rows.append((f"{run}/{part}", "keys", None, None, 1, float(delta_keys)))
    return spark.createDataFrame(rows, MECHANISMS)


def write_mechanisms(events: DataFrame, path: str) -> None:
    """Append events to a mechanism table."""
    events.write.mode("append").parquet(path)


def read_mechanisms(spark, path: str) -> DataFrame:
    return spark.read.schema(MECHANISMS).parquet(path)


def spent(events: DataFrame, orders: Sequence[int] = range(2, 65)) -> DataFrame:
    """``(node, epsilon_basic, epsilon_rdp, delta)`` of every node of the budget's tree, from the events at and below it.

    Basic composition adds up what each Gaussian release spends at its own delta, ``1 / (2 m^2) + sqrt(2 ln(1 / delta))
    / m`` with ``m = sigma / sensitivity``; the Renyi rule adds up ``steps / (2 m^2)`` and takes the best order at the
    sum of those deltas.  ``delta`` adds up all parts, key releases too.  One aggregate; orders are a list in the row."""
    m = F.col("sigma") / F.col("sensitivity")
    noise = F.col("kind") == "gaussian"
    rho = F.lit(1.0) / (2.0 * m * m)
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    times = F.col("steps").cast("double")
    per = events.select(
        F.explode(above).alias("node"), F.when(noise, times * rho).alias("rho"),
        F.when(noise, times * (rho + F.sqrt(2.0 * F.log(1.0 / F.col("delta"))) / m)).alias("eps"),
        F.when(noise, times * F.col("delta")).alias("dg"), (times * F.col("delta")).alias("d"))
    whole = per.groupBy("node").agg(F.sum("rho").alias("rho"), F.sum("eps").alias("eps"), F.sum("dg").alias("dg"),
                                    F.sum("d").alias("delta"))
    best = F.array_min(F.array(*(F.col("rho") * int(o) + F.log(1.0 / F.col("dg")) / (int(o) - 1) for o in orders)))
    return whole.select("node", F.coalesce("eps", F.lit(0.0)).alias("epsilon_basic"),
                        F.when(F.col("rho") > 0, best).otherwise(0.0).alias("epsilon_rdp"), "delta")
