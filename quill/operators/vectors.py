"""Vector tables: element-wise means, appended mean rows, softmax at a
temperature and the distillation losses (KL, hidden-state MSE, CE, mixture).

Vectors stay arrays inside a row (higher-order functions, no Python);
aggregates over many rows go through ``posexplode`` + ``groupBy(key, pos)``,
a partial aggregate that a hot key cannot overload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.arrays import log_softmax


def _names(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def to_long(df: DataFrame, id_col: str, vec: str, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``(id, pos, value)`` rows from an array column (doubles)."""
    return df.select(id_col, *keep, F.posexplode(vec).alias("pos", value)).select(
        id_col, *keep, F.col("pos").cast("long").alias("pos"), F.col(value).cast("double").alias(value))


def mean_vector(df: DataFrame, vec: str, by=None, name: str = "mean") -> DataFrame:
    """Element-wise mean per group, long form ``(by..., pos, mean)``."""
    by = _names(by)
    x = df.select(*by, F.posexplode(vec).alias("pos", "_x"))
    return x.groupBy(*by, F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("_x").cast("double")).alias(name))


def long_to_array(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Reassemble a long vector per group; a group is one vector (its dimension)."""
    by = _names(by)
    return df.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(name))


def append_mean_vectors(df: DataFrame, id_col: str, vec: str, n: int = 1) -> DataFrame:
    """All vectors in long form plus ``n`` rows holding the mean vector, with ids
    ``max(id) + 1 .. max(id) + n`` (new rows are appended, never written over an
    existing row)."""
    long = to_long(df, id_col, vec)
    mean = long.groupBy("pos").agg(F.avg("value").alias("value"), F.max(id_col).alias("_max"))
    added = mean.select(F.explode(F.sequence(F.col("_max") + 1, F.col("_max") + n)).alias(id_col), "pos", "value")
    return long.unionByName(added)


def softmax_long(df: DataFrame, id_col: str, vec: str, temperature: float, log: bool = False,
                 name: str = "p") -> DataFrame:
    ls = log_softmax(vec, temperature)
    arr = ls if log else F.transform(ls, lambda x: F.exp(x))
    return df.select(id_col, F.posexplode(arr).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def kl_row(student: Column, teacher: Column, temperature: float) -> Column:
    """``sum_j q_j (ln q_j - ln p_j)`` with q = softmax(teacher/T), p = softmax(student/T)."""
    lq = log_softmax(teacher, temperature)
    lp = log_softmax(student, temperature)
    terms = F.zip_with(lq, lp, lambda a, b: F.exp(a) * (a - b))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def sq_err_row(student: Column, teacher: Column) -> Column:
    terms = F.zip_with(student, teacher, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def ce_row(student: Column, target: Column) -> Column:
    """Cross-entropy of the true class: ``-log_softmax(student)[target]``."""
    return -F.get(log_softmax(student, 1.0), target)


def align(student: DataFrame, teacher: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pair student and teacher outputs for the same input (inner equi-join)."""
    return student.join(teacher, list(on))


#: Numbers a table of group vectors may hold to be sent to every task (64 MB of doubles).
BROADCAST_NUMBERS = 8 << 20
#: Slices into which the rows of each group are dealt where the table is too large for that.
SALTS = 16


def attach(df: DataFrame, table: DataFrame, by: str, vec: str, numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """``df`` beside the vector of its group; ``table`` has one row ``(by, vec)`` a group.

    The table is written to the shared folder and counted: where its vectors hold at most ``numbers`` numbers they are
    broadcast, so no row of ``df`` moves; else both sides are dealt by group and hash slice (the table's rows repeated
    for each slice), so a group with a third of the rows is spread over ``SALTS`` tasks."""
    t = table.select(by, vec).checkpoint(eager=True)
    size = t.agg(F.sum(F.size(vec)).alias("n")).first()["n"] or 0
    if size <= numbers:
        return align(df, F.broadcast(t), [by])
    rest = [F.col(c) for c, kind in df.dtypes if "map<" not in kind]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    copies = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return align(salted, copies, [by, "_salt"]).drop("_salt")


def with_teacher_mean(df: DataFrame, vec: str, by: str, name: str = "teacher",
                      numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """Attach each row's group mean vector as its teacher output (see :func:`attach`)."""
    t = long_to_array(mean_vector(df, vec, by, "mean"), [by], "mean", name)
    return attach(df, t, by, name, numbers)


def kd_kl(df: DataFrame, student: str, teacher: str, temperature: float, batch: str) -> DataFrame:
    """``T^2 * sum KL / rows`` per batch (KL 'batchmean')."""
    t2 = float(temperature) ** 2
    return df.groupBy(batch).agg((F.lit(t2) * F.sum(kl_row(F.col(student), F.col(teacher), temperature))
                                  / F.count(F.lit(1))).alias("kl"))


def kd_sequence_loss(df: DataFrame, student: str, teacher: str, temperature: float, seq: str, pos: str,
                     skip_prefix: int = 5) -> DataFrame:
    """KL summed over the positions of each sequence from ``skip_prefix`` on (T^2 scaled)."""
    t2 = float(temperature) ** 2
    return df.where(F.col(pos) >= skip_prefix).groupBy(seq).agg(
        (F.lit(t2) * F.sum(kl_row(F.col(student), F.col(teacher), temperature))).alias("kl"))


def hidden_mse(df: DataFrame, student: str, teacher: str, batch: str, mask: Column | None = None) -> DataFrame:
    """Mean squared error over every element of every row of the batch."""
    d = df if mask is None else df.where(mask)
    return d.groupBy(batch).agg((F.sum(sq_err_row(F.col(student), F.col(teacher)))
                                 / F.sum(F.size(student))).alias("mse"))


def kd_loss(df: DataFrame, student: str, teacher: str, target: str, batch: str, temperature: float,
            lam: float, alpha: float, terms: dict[str, Column] | None = None) -> DataFrame:
    """``lam * T^2 * KL + alpha * MSE + (1 - lam) * CE`` per batch.  A term with a
    zero weight is left out of the plan (no teacher needed at ``lam = alpha = 0``).
    ``terms`` adds user-defined per-row loss columns, averaged per batch."""
    aggs = [F.avg(ce_row(F.col(student), F.col(target))).alias("_ce")]
    loss = F.lit(1.0 - lam) * F.col("_ce")
    if lam > 0:
        t2 = float(temperature) ** 2
        aggs.append((F.lit(t2) * F.sum(kl_row(F.col(student), F.col(teacher), temperature)) / F.count(F.lit(1))).alias("_kl"))
        loss = loss + F.lit(lam) * F.col("_kl")
    if alpha > 0:
        aggs.append((F.sum(sq_err_row(F.col(student), F.col(teacher))) / F.sum(F.size(student))).alias("_mse"))
        loss = loss + F.lit(alpha) * F.col("_mse")
    for nm, expr in (terms or {}).items():
        aggs.append(F.avg(expr).alias(f"_t_{nm}"))
        loss = loss + F.col(f"_t_{nm}")
    return df.groupBy(batch).agg(*aggs).select(batch, F.lit(float(lam)).alias("lambda"), loss.alias("loss"))
