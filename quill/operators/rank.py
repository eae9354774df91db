"""Exact ranks, cut-offs and running sums without a single-partition sort.

Every ordered operator reduces to "prefix sums over an order-preserving
bucket" (:func:`bucket_rank`) or, for orders that have no cheap bucket, a
range-partitioned numbering (:func:`running_total`):

* **Hash order** (random samples, splits, shuffles, per-group cuts):
  rows are ranked by ``md5(seed:id)``.  The first hex digits of the hash form
  a bucket that preserves the order, so counting rows per bucket (a partial
  aggregate), prefix-summing that small table and ranking inside each bucket
  gives an exact global rank.  A cut-off ``n`` only shuffles the buckets that
  start before the cut.
  Where only the cut matters (samples, splits), :func:`hash_cut` finds the hash
  of the last row inside from two aggregates, and no row is moved at all.
* **Integral value order** (prefix by id, corpus offsets, rank in a group):
  the bucket is a value range between quantiles of a bounded sample, as many
  as the row count asks for (:func:`with_key_bucket`).
* **Other value orders** (vocabulary ids by count, nucleus sums): rows are
  range-partitioned on the order key (Spark samples the bounds), numbered
  inside each partition, and shifted by the totals of earlier partitions, a
  table with one row per partition.  The numbered rows are checkpointed
  (reliable checkpoint) so the totals and the rows come from one
  materialisation; callers pass a *total* order (ending in a unique id).

Neither shape puts a whole group in one task: a hot group is spread over many
buckets / range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.hashing import hash_bucket, hash_hex

_LOW33 = (1 << 33) - 1


def _cols(xs) -> list[Column]:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _names(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (a start context is null)."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on needs keys")
    bb = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return a.join(bb, cond, how).drop(*[f"_r_{k}" for k in keys])


def bucket_rank(
    df: DataFrame,
    bucket: Column,
    order: Sequence,
    by: Sequence[str] | str = (),
    limit=None,
    name: str = "rank",
    total: str | None = None,
    weight: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Rank rows inside ``by`` groups by ``order`` through an order-preserving
    ``bucket`` (a bucket that sorts before another holds only rows that sort
    before it).

    Without ``weight``, ``name`` is the 1-based rank.  With ``weight``, it is the
    exclusive running sum of the weight.  ``limit`` (only without weight)
    keeps rank <= limit: an int, a DataFrame ``(*by, quota)``, or a function of
    the group's row count.  Only buckets that start before the cut reach the
    ranking shuffle.  ``bounded`` says the bucket table is known to be small
    (at most a fixed number of buckets and no groups), so it is broadcast.
    """
    by = _names(by)
    order = _cols(order)
    d = df.withColumn("_b", bucket)
    wexpr = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = d.groupBy(*by, "_b").agg(wexpr.alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")))
    if callable(limit) or total:
        counts = counts.withColumn("_tot", F.sum("_n").over(Window.partitionBy(*by)))
    lim = None
    if isinstance(limit, int):
        lim = F.lit(limit)
    elif isinstance(limit, DataFrame):
        q = limit.select(*by, F.col("quota").alias("_quota"))
        counts = join_on(counts, q, by)
        lim = F.col("_quota")
    elif callable(limit):
        counts = counts.withColumn("_quota", limit(F.col("_tot")))
        lim = F.col("_quota")
    if lim is not None:
        counts = counts.where(F.col("_before") < lim)
    counts = counts.drop("_n")
    side = F.broadcast(counts) if (bounded and not by) else counts
    d = join_on(d, side, [*by, "_b"]) if by else d.join(side, "_b")
    wr = Window.partitionBy(*by, "_b").orderBy(*order)
    if weight is None:
        d = d.withColumn(name, F.col("_before") + F.row_number().over(wr))
    else:
        wx = wr.rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn(name, F.col("_before") + F.coalesce(F.sum(weight).over(wx), F.lit(0).cast("long")))
    if isinstance(limit, int):
        d = d.where(F.col(name) <= F.lit(limit))
    elif lim is not None:
        d = d.where(F.col(name) <= F.col("_quota")).drop("_quota")
    if total:
        d = d.withColumnRenamed("_tot", total)
    elif "_tot" in d.columns:
        d = d.drop("_tot")
    return d.drop("_b", "_before")


HOT_ROWS = 1_000_000
MAX_HOT_GROUPS = 1_000_000


def hot_groups(df: DataFrame, by: Sequence[str], min_rows: int = HOT_ROWS,
               max_groups: int = MAX_HOT_GROUPS) -> DataFrame:
    """Groups holding more than ``max(min_rows, rows / max_groups)`` rows, as
    ``(*by, _hot)``.  There are at most ``max_groups`` of them, a proven
    bound, so the table may be broadcast."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_gs"))
    rows = sizes.agg(F.sum("_gs")).first()[0] or 0
    cut = max(int(min_rows), int(rows) // int(max_groups))
    return sizes.where(F.col("_gs") > F.lit(cut)).select(*by, F.lit(True).alias("_hot"))


def hash_rank(
    df: DataFrame,
    seed,
    ids: Sequence[str] | str,
    by: Sequence[str] | str = (),
    limit=None,
    name: str = "rank",
    digits: int = 4,
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``name`` = 1-based position of each row in hash order
    ``(md5(seed:id), id)`` within ``by``; see :func:`bucket_rank` for ``limit``
    and ``total``.

    The bucket is the first ``digits`` hex digits of the hash (balanced by
    construction).  Without ``by`` that is at most 16**digits buckets, broadcast.
    With ``by``, only hot groups (see :func:`hot_groups`) are split into hash
    buckets; every other group is one bucket of at most ``hot_rows`` rows.
    Many small groups (users) then cost one bucket row each, and a group
    holding a third of the table is still spread over 16**digits tasks."""
    ids = _names(ids)
    by = _names(by)
    d = df.withColumn("_h", hash_hex(seed, *ids))
    # A non-null bucket keeps Catalyst from inferring an isnotnull(...) filter
    # that would hash every row a second time.
    bucket = F.coalesce(hash_bucket(F.col("_h"), digits), F.lit(""))
    if by:
        hot = hot_groups(df, by, hot_rows)
        d = join_on(d, F.broadcast(hot), by, "left")
        bucket = F.when(F.col("_hot"), bucket).otherwise(F.lit(""))
    out = bucket_rank(d, bucket, [F.col("_h"), *ids], by, limit, name, total, bounded=True)
    return out.drop("_h", "_hot")


def hash_cut(df: DataFrame, seed, ids: Sequence[str] | str, limit, digits: int = 4) -> Column | None:
    """A condition that holds for exactly the first ``limit`` rows of ``df`` in
    hash order: an int, or a function of the row count.

    Rows are counted per hash bucket (at most 16**digits), the prefix sums name
    the bucket that the cut falls into, and only the hashes of that bucket are
    ranked to find the last one inside.  Rows are then compared with that one
    hash, so nothing but counts and one bucket's hashes is shuffled.  Null ids
    sort first.  None when rows of equal ids lie on both sides of the cut: no
    comparison of hashes parts them (rank them with :func:`hash_rank`)."""
    h = F.coalesce(hash_hex(seed, *_names(ids)), F.lit(""))
    d = df.select(h.alias("_h")).withColumn("_b", hash_bucket(F.col("_h"), digits))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.sum("_n").over(Window.partitionBy())
    counts = counts.select("_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.least((limit(rows) if callable(limit) else F.lit(limit)).cast("long"), rows).alias("_cut"))
    at = counts.where((F.col("_before") < F.col("_cut")) & (F.col("_cut") <= F.col("_before") + F.col("_n"))).first()
    if at is None:
        return F.lit(False)
    k = at["_cut"] - at["_before"]
    ranked = d.where(F.col("_b") == at["_b"]).withColumn("_r", F.row_number().over(
        Window.partitionBy("_b").orderBy("_h")))
    near = {r["_r"]: r["_h"] for r in ranked.where(F.col("_r").isin(k, k + 1)).select("_r", "_h").collect()}
    if near[k] == near.get(k + 1):
        return None
    return h <= F.lit(near[k])


_INTEGRAL = ("LongType", "IntegerType", "ShortType", "ByteType")
ROWS_PER_BUCKET = 1 << 20
MAX_BOUNDS = 1 << 12
MAX_SLICES = 1 << 8
SAMPLE_PER_BOUND = 64


def _constants(values: Sequence, kind: str) -> Column:
    """A constant array, folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_key_bucket(df: DataFrame, key: str, name: str = "_b", buckets: int | None = None) -> DataFrame:
    """``df`` with the value-range bucket of an integral key.

    ``buckets`` is by default one for every ``ROWS_PER_BUCKET`` rows and four a
    core at least.  Up to ``MAX_BOUNDS`` ranges lie between quantiles of a
    sample of ``SAMPLE_PER_BOUND`` rows a bound, so they hold about equally many
    rows wherever the keys lie (negative, sparse, with far outliers); beyond that each
    range is cut into up to ``MAX_SLICES`` equal widths, the first and last ones,
    where outliers lie, at geometric quantiles before.  The bucket table has
    some ``MAX_BOUNDS * MAX_SLICES`` rows at most, few enough to broadcast.  The
    bounds are fixed before any row is compared with them: the sample decides
    how even the buckets are, never their order.  Nulls are bucket -1."""
    value = F.col(f"`{key}`").cast("long")
    rows = df.select(value.alias("k")).count()
    if buckets is None:
        buckets = max(-(-rows // ROWS_PER_BUCKET), 4 * df.sparkSession.sparkContext.defaultParallelism)
    ranges = min(buckets, MAX_BOUNDS)
    slices = min(-(-buckets // ranges), MAX_SLICES)
    share = SAMPLE_PER_BOUND * ranges / max(rows, 1)
    drawn = df.select(value.alias("k"))
    drawn = drawn.sample(share, seed=1) if share < 1 else drawn
    inner = [i / ranges for i in range(1, ranges)] or [0.5]
    outer = [(1 << j) / (SAMPLE_PER_BOUND * ranges) for j in range(SAMPLE_PER_BOUND.bit_length() - 1)] if slices > 1 else []
    at = _constants([*inner, *outer, *(1 - x for x in outer)], "double")
    bounds = drawn.agg(F.percentile_approx("k", at, 2 * SAMPLE_PER_BOUND * ranges).alias("q")).first()["q"]
    bounds = sorted(set(bounds or []))
    if not bounds:
        return df.withColumn(name, F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    table = _constants(bounds, "bigint")
    # Binary search: the count of bounds at or under the key grows by halving steps, one
    # projection each, which keeps the search in generated code.
    out = df.withColumn(name, F.lit(0))
    for step in [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]:
        found = F.col(name)
        out = out.withColumn(name, found + F.when(F.get(table, found + F.lit(step - 1)) <= value, F.lit(step))
                             .otherwise(F.lit(0)))
    bucket = F.col(name).cast("long")
    if slices > 1:
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        edges = _constants([ends["lo"], *bounds, ends["hi"]], "double")
        low, high = F.get(edges, F.col(name)), F.get(edges, F.col(name) + 1)
        part = F.floor((value.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * F.lit(float(slices)))
        bucket = bucket * F.lit(slices) + F.least(F.greatest(part, F.lit(0)), F.lit(slices - 1))
    # A non-null bucket keeps Catalyst from inferring a filter that would repeat the search.
    return out.withColumn(name, F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(
        F.coalesce(bucket, F.lit(0).cast("long"))))


def _integral_key(df: DataFrame, order) -> str | None:
    """The leading order column when it is an integral column in ascending order."""
    if not order:
        return None
    first = order[0]
    if not isinstance(first, str) or first not in df.columns:
        return None
    return first if type(df.schema[first].dataType).__name__ in _INTEGRAL else None


def running_total(
    df: DataFrame,
    order: Sequence,
    weight: Column | str | None = None,
    by: Sequence[str] | str = (),
    name: str = "before",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over the rows before this one in ``order``
    (exclusive running sum), restarted for each ``by`` group.  With no weight it
    is the 0-based row number.  ``order`` must be a total order.
    """
    by = _names(by)
    order = _cols(order)
    spark = df.sparkSession
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(by), *order]
    wcol = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("long")
    d = (
        df.withColumn("_w", wcol)
        .repartitionByRange(nparts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_mid"), 33))
    )
    # The numbering depends on sampled range bounds and on row order inside
    # partitions; materialise it once (reliable checkpoint in the shared
    # checkpoint folder) so every branch below, and any recomputed task, sees
    # the same numbers.
    d = d.checkpoint(eager=True)
    if weight is None:
        d = d.withColumn("_in", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    else:
        wp = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_in", F.coalesce(F.sum("_w").over(wp), F.lit(0).cast("long")))
    # One row per range partition: bounded by the partition count, so the
    # unpartitioned window and the broadcast are safe.
    parts = d.groupBy("_part").agg(F.sum("_w").alias("_tot"))
    wall = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_tot").over(wall), F.lit(0).cast("long")).alias("_pbefore"))
    d = d.join(F.broadcast(parts), "_part").withColumn(name, F.col("_pbefore") + F.col("_in"))
    if by:
        start = d.groupBy(*by).agg(F.min(name).alias("_gstart"))
        d = join_on(d, start, by).withColumn(name, F.col(name) - F.col("_gstart")).drop("_gstart")
    return d.drop("_w", "_mid", "_part", "_in", "_pbefore")


def value_rank(df: DataFrame, order: Sequence, by: Sequence[str] | str = (), name: str = "rank",
               limit=None) -> DataFrame:
    """1-based rank in a total ``order`` within ``by`` groups (value order).

    An order that leads with an ascending integral column is ranked through
    value-range buckets (no sort of the whole table; a ``limit`` only ranks
    the buckets before the cut).  Other orders use the range-partitioned
    numbering of :func:`running_total`."""
    order = list(order) if not isinstance(order, (str, Column)) else [order]
    key = _integral_key(df, order)
    if key is not None:
        return bucket_rank(with_key_bucket(df, key), F.col("_b"), order, by, limit, name, bounded=True)
    out = running_total(df, order, None, by, name="_rb").withColumn(name, F.col("_rb") + 1).drop("_rb")
    if callable(limit):
        byl = _names(by)
        tot = out.groupBy(*byl).agg(F.count(F.lit(1)).alias("_tot")) if byl else None
        if tot is None:
            rows = out.count()
            out = out.where(F.col(name) <= limit(F.lit(rows)))
        else:
            out = join_on(out, tot, byl).where(F.col(name) <= limit(F.col("_tot"))).drop("_tot")
    elif isinstance(limit, int):
        out = out.where(F.col(name) <= F.lit(limit))
    elif isinstance(limit, DataFrame):
        byl = _names(by)
        out = join_on(out, limit.select(*byl, F.col("quota").alias("_q")), byl).where(
            F.col(name) <= F.col("_q")).drop("_q")
    return out


def offsets(df: DataFrame, order: Sequence, weight: Column, by: Sequence[str] | str = (),
            name: str = "before") -> DataFrame:
    """Exclusive running sum of ``weight`` in ``order`` within ``by`` (value order);
    value-range buckets for an ascending integral leading key, else
    :func:`running_total`."""
    order = list(order) if not isinstance(order, (str, Column)) else [order]
    key = _integral_key(df, order)
    if key is not None:
        return bucket_rank(with_key_bucket(df, key), F.col("_b"), order, by, None, name, weight=weight.cast("long"),
                           bounded=True)
    return running_total(df, order, weight, by, name=name)


def rank_and_offset(df: DataFrame, key: str, weight: Column, rank: str = "rank",
                    offset: str = "before") -> DataFrame:
    """One bucketed pass over an integral unique ``key`` giving both the
    1-based rank and the exclusive running sum of ``weight``."""
    d = with_key_bucket(df, key).withColumn("_w", weight.cast("long"))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")).alias("_nb"),
                           F.coalesce(F.sum("_s").over(w), F.lit(0).cast("long")).alias("_sb"))
    # At most MAX_BOUNDS * MAX_SLICES rows: broadcast.
    d = d.join(F.broadcast(counts), "_b")
    wr = Window.partitionBy("_b").orderBy(key)
    d = d.withColumn(rank, F.col("_nb") + F.row_number().over(wr)).withColumn(
        offset, F.col("_sb") + F.coalesce(F.sum("_w").over(wr.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0).cast("long")))
    return d.drop("_b", "_w", "_nb", "_sb")


def exact_take(df: DataFrame, n: int, seed=None, ids=None, order=None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the first ``n`` in hash order (``seed``/``ids``)
    or in a value ``order``.  Never a single-partition ``orderBy().limit()``."""
    if order is not None:
        return value_rank(df, order, name="_r", limit=int(n)).drop("_r")
    return hash_take(df, seed, ids, int(n))


def hash_take(df: DataFrame, seed, ids, limit) -> DataFrame:
    """Exactly the first ``limit`` rows (an int, or a function of the row count) in
    hash order; rows are only moved where equal ids lie on both sides of the cut."""
    cut = hash_cut(df, seed, ids, limit)
    if cut is None:
        return hash_rank(df, seed, ids, limit=limit, name="_r").drop("_r")
    return df.where(cut)
