"""Array (vector / sequence) expressions built on higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dbl(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_dbl(v), F.lit(0.0), lambda acc, x: acc + x * x))


def clip_l2(v, c: float) -> Column:
    """Scale a vector so its L2 norm is at most ``c`` (per-record clipping).

    The norm is computed once per row and handed to the element-wise step
    through ``aggregate``'s finish function (a value referenced inside a
    ``transform`` lambda would be recomputed for every element)."""
    v = _c(v)

    def finish(acc):
        n = F.sqrt(acc)
        scale = F.when(n > F.lit(c), F.lit(c) / n).otherwise(F.lit(1.0))
        return F.transform(v, lambda x: x.cast("double") * scale)

    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"), finish)


def log_softmax(v, temperature: float = 1.0) -> Column:
    """``x/T - logsumexp(x/T)`` element-wise; one streaming pass computes the
    log-sum-exp (running max and rescaled sum), the finish step subtracts it."""
    v = _c(v)
    t = F.lit(float(temperature))
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def merge(acc, x):
        z = x.cast("double") / t
        m = F.greatest(acc["m"], z)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(z - m)).alias("s"))

    def finish(acc):
        lse = acc["m"] + F.log(acc["s"])
        return F.transform(v, lambda x: x.cast("double") / t - lse)

    return F.aggregate(v, init, merge, finish)


def softmax(v, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(v, temperature), lambda x: F.exp(x))


def mask_targets(ids, trg_len) -> Column:
    """All but the last ``trg_len`` positions become -100 (``trg_len=0`` masks all)."""
    ids = _c(ids)
    keep_from = F.size(ids) - _c(trg_len) if not isinstance(trg_len, int) else F.size(ids) - F.lit(trg_len)
    return F.transform(ids, lambda x, i: F.when(i < keep_from, F.lit(-100).cast("long")).otherwise(x.cast("long")))


def mask_value(ids, value) -> Column:
    """Positions equal to ``value`` (the pad id) become -100."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.transform(_c(ids), lambda x: F.when(x == v, F.lit(-100).cast("long")).otherwise(x.cast("long")))
