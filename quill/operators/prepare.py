"""Preparing labelled text tables: project, recode, filter by frequency,
allocate quotas, sample and split with exact sizes, shuffle, union."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.operators.rank import exact_take, hash_cut, hash_rank, hash_take, value_rank


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- projections

def label_columns(df: DataFrame) -> list[str]:
    """Label columns are found by name: any column whose name contains 'label'."""
    return [c for c in df.columns if "label" in c]


def to_labelled(df: DataFrame, text: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select and rename to ``text``, ``label`` (plus pass-through ``keep`` columns)."""
    if text not in df.columns:
        raise ValueError(f"text column {text!r} missing")
    return df.select(*keep, F.col(text).alias("text"), F.col(label).cast("string").alias("label"))


def with_label(df: DataFrame, name: str, col: str = "label") -> DataFrame:
    """A constant label for a whole stratum."""
    return df.withColumn(col, F.lit(name))


def stratum_labels(df: DataFrame, code_col: str, names: Mapping[str, str], col: str = "label") -> DataFrame:
    """One scan, every stratum at once: rows whose code has a name get it as label;
    rows of other codes are not in any stratum and are dropped."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(col, F.element_at(m, F.col(code_col))).where(F.col(col).isNotNull())


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def recode(df: DataFrame, col: str, mapping: Mapping, on_missing: str = "error", out: str | None = None) -> DataFrame:
    """Recode ``col`` through a dictionary.

    The dictionary is caller data of fixed, known size, so it is broadcast; an
    unknown (non-null) key raises like a missing dict key would.
    """
    out = out or col
    key_type = df.schema[col].dataType
    spark = df.sparkSession
    lut = spark.createDataFrame(
        [(k, str(v)) for k, v in mapping.items()],
        T.StructType([T.StructField("_k", key_type), T.StructField("_v", T.StringType())]),
    )
    j = df.join(F.broadcast(lut), F.col(col) == F.col("_k"), "left")
    if on_missing == "error":
        val = F.when(F.col(col).isNotNull() & F.col("_v").isNull(),
                     F.raise_error(F.concat(F.lit("unknown key in recode: "), F.col(col).cast("string")))
                     ).otherwise(F.col("_v"))
    else:
        val = F.col("_v")
    cols = [val.alias(out) if c == col else F.col(c) for c in df.columns]
    if out != col:
        cols.append(val.alias(out))
    return j.select(*cols)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Really drop rows holding a null (the reference discards this result)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def as_text(col, null: str = "None") -> Column:
    """Any value as a string; null becomes the text ``null`` (Python ``str(None)``)."""
    return F.coalesce(_c(col).cast("string"), F.lit(null))


def non_empty(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.length(col) > 0))


# ---------------------------------------------------------------- counting

def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value, nulls excluded (descending order is a presentation detail)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def frequent_labels(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Values seen strictly more than ``min_count`` times."""
    return value_counts(df, col).where(F.col("n") > F.lit(min_count))


def filter_frequent(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Keep rows whose ``col`` is frequent (left semi join; null never matches).

    The frequent-value table is an aggregate of unknown size; AQE turns the
    join into a broadcast at run time when it is small.
    """
    top = frequent_labels(df, col, min_count).select(col)
    return df.join(top, col, "left_semi")


def table_stats(df: DataFrame, col: str, stage: str) -> DataFrame:
    """One row: stage name, row count and distinct non-null ``col`` values."""
    return df.agg(
        F.lit(stage).alias("stage"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(col).alias("n_labels"),
    )


def frequency_stats(df: DataFrame, col: str, min_count: int, before: str = "before",
                    after: str = "after") -> DataFrame:
    """Rows and distinct labels before and after the frequency filter, from one
    count per label (a partial aggregate) instead of filtering and recounting:
    ``(stage, n_rows, n_labels)``.  Null labels count as rows only before."""
    per = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col(col).isNotNull() & (F.col("_n") > F.lit(min_count))
    t = per.agg(
        F.sum("_n").cast("long").alias("_r0"), F.count(col).alias("_l0"),
        F.coalesce(F.sum(F.when(keep, F.col("_n"))), F.lit(0)).cast("long").alias("_r1"),
        F.count(F.when(keep, F.lit(1))).alias("_l1"),
    )
    rows = F.array(
        F.struct(F.lit(before).alias("stage"), F.col("_r0").alias("n_rows"), F.col("_l0").alias("n_labels")),
        F.struct(F.lit(after).alias("stage"), F.col("_r1").alias("n_rows"), F.col("_l1").alias("n_labels")),
    )
    return t.select(F.explode(rows).alias("_s")).select("_s.stage", "_s.n_rows", "_s.n_labels")


def prompt_counts(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Rows per control-code prompt (every label column, TAB-joined, blank line)."""
    from quill.functions.text import control_prompt_expr

    labels = list(labels) if labels else label_columns(df)
    return df.groupBy(control_prompt_expr(labels).alias("prompt")).agg(F.count(F.lit(1)).alias("n"))


def allocate(counts: DataFrame, total: int, key: str = "label", n: str = "n") -> DataFrame:
    """Proportional quotas ``round_half_even(n * (total / sum(n)))``; groups with
    a zero quota are dropped.  The grand total is one scalar, fetched first and
    used as a literal (ratio computed first, as Python would)."""
    grand = counts.agg(F.sum(n)).first()[0] or 0
    ratio = float(total) / float(grand) if grand else 0.0
    out = counts.withColumn("quota", F.bround(F.col(n).cast("double") * F.lit(ratio), 0).cast("long"))
    return out.where(F.col("quota") > 0)


def quota_table(df: DataFrame, by: str, total: int) -> DataFrame:
    """``(by, n, quota)``: each stratum's size and its proportional share of
    ``total`` (strata with a zero share are dropped)."""
    counts = value_counts(df, by)
    return allocate(counts, total, key=by)


# ---------------------------------------------------------------- sampling / splitting

def prefix(df: DataFrame, n: int | None, order: Sequence, frac: float | None = None) -> DataFrame:
    """The first ``n`` rows in a total ``order`` (positional slice ``[:n]``), or
    the first ``round(frac * rows)`` rows; the row count comes from the
    bucket table, not a separate pass."""
    if frac is not None:
        return value_rank(df, order, name="_r",
                          limit=lambda rows: F.bround(rows.cast("double") * F.lit(float(frac)), 0)).drop("_r")
    return exact_take(df, n, order=order)


def sample_exact(df: DataFrame, frac: float, seed, ids) -> DataFrame:
    """Exactly ``round(frac * rows)`` rows without replacement (pandas
    ``sample(frac)``); the row count comes from the hash-bucket table, and no row is moved."""
    return hash_take(df, seed, ids, lambda n: F.bround(n.cast("double") * F.lit(float(frac)), 0))


def split_sizes(rows: int, test_size: float) -> int:
    """Test-part size of a two-way split: ``ceil(test_size * rows)``."""
    return int(math.ceil(test_size * rows))


def split_exact(df: DataFrame, test_size: float, seed, ids, test: str = "test", train: str = "train",
                col: str = "split") -> DataFrame:
    """Label every row ``test`` or ``train``; the test part has exactly
    ``ceil(test_size * rows)`` rows chosen in hash order.  Rows are compared with
    the hash at the cut and stay where they are; only where rows of equal ids
    lie on both sides of it are they ranked."""
    cut = hash_cut(df, seed, ids, _part(test_size))
    if cut is not None:
        return df.withColumn(col, F.when(cut, F.lit(test)).otherwise(F.lit(train)))
    ranked = hash_rank(df, seed, ids, name="_r", total="_rows")
    n_test = _part(test_size)(F.col("_rows"))
    return ranked.withColumn(col, F.when(F.col("_r") <= n_test, F.lit(test)).otherwise(F.lit(train))).drop("_r", "_rows")


def _part(size: float):
    """``ceil(size * rows)`` as a function of the row count."""
    return lambda rows: F.ceil(rows.cast("double") * F.lit(float(size)))


def split_three_way(df: DataFrame, test_size: float, val_size: float, seed, ids, col: str = "split") -> DataFrame:
    """Nested split: ``test`` first, then ``validation`` from the rest (seed + 1).
    Both cuts are single hashes, so one projection labels every row."""
    outer = hash_cut(df, seed, ids, _part(test_size))
    inner = None if outer is None else hash_cut(df.where(~outer), int(seed) + 1, ids, _part(val_size))
    if inner is not None:
        return df.withColumn(col, F.when(outer, F.lit("test")).when(inner, F.lit("validation"))
                             .otherwise(F.lit("train")))
    first = split_exact(df, test_size, seed, ids, col="_s1")
    rest = first.where(F.col("_s1") == "train").drop("_s1")
    tst = first.where(F.col("_s1") == "test").drop("_s1").withColumn(col, F.lit("test"))
    second = split_exact(rest, val_size, int(seed) + 1, ids, test="validation", col=col)
    return tst.unionByName(second)


def stratified_sample(df: DataFrame, by: Sequence[str] | str, quotas: DataFrame, seed, ids) -> DataFrame:
    """Cut each group to its ``quota`` rows at random (groups under quota are kept whole)."""
    return hash_rank(df, seed, ids, by=by, limit=quotas, name="_r").drop("_r")


def take_per_group(df: DataFrame, by: Sequence[str] | str, quotas: DataFrame, order: Sequence,
                   name: str = "rn") -> DataFrame:
    """First ``quota`` rows of each group in a value order, with their 1-based rank."""
    by = [by] if isinstance(by, str) else list(by)
    return value_rank(df, order, by=by, name=name, limit=quotas)


def shuffle(df: DataFrame, seed, ids, name: str = "shuffle_key") -> DataFrame:
    """A seeded permutation: ``name`` is each row's 1-based position in it."""
    return hash_rank(df, seed, ids, name=name)
