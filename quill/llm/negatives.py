"""Hard-negative mining with lists that clusters of anchors share.

Anchors are clustered by direction.  For a cluster with centre ``c`` whose
members lie within the angle ``t`` of it, no member's cosine with a row ``x`` is
above ``cos(max(0, angle(c, x) - t))``; times ``|x|`` that bounds the row's score
with any member, divided by the member's length.  The rows are sorted by this
bound once a cluster, and every member walks the same list: while the bound times
its own length can still reach what it needs, it takes the next rows, and where
it cannot, the walk ends and what was found is certified.

Two walks: one for the positives (the ``positives`` best other rows of the
anchor's label), and, given their scores over all rows, one for the negatives
(for every positive the first ``negatives`` rows of another label whose score
lies in the window of two fractions of the positive's score).

On Spark: rows are dealt into blocks of about ``ITEMS`` rows and clusters into
blocks of about ``ANCHORS`` anchors, both by hash.  A task walks one block of
rows for one block of anchors and returns at most what one result can need; a
window function over these partial results gives the whole one.  A cluster with
more than ``MEMBERS`` anchors is split by hash, so no key holds more than that.

Scores are exact integers: components are ``floor(scale * x)``, sums are taken in
doubles where a hundred times every partial sum is below 2^53, else in Python integers (scores
outside the range of a long are put at its ends in the result).  Bounds are
doubles with a margin far above their rounding.

Bounded sample (documented parameter): ``SAMPLE`` anchors, the first in hash
order, fit the cluster centres, one for ``PER_CENTRE`` anchors, ``CENTRES`` at
most; every anchor is assigned and every row takes part.

Defined results: rows with a null id, null label, null vector or any null or
non-finite component take no part; vectors of different lengths are not
compared; of several rows of one id the smallest by label and vector counts;
ties go to the smaller id; an anchor without
positives, or a positive without a row in its window, gives no row; zero vectors
have score 0 with every row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.common import written

ITEMS = 4096
ANCHORS = 2048
MEMBERS = 512
SAMPLE = 10_000
PER_CENTRE = 32
CENTRES = 1024
STEPS = 8
FIRST, NEXT = 256, 1024
SEED = 67
_EXACT = float(1 << 53) / 100


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(x: Column) -> Column:
    """The floor of a double, as a double; from 2^52 on every double is whole."""
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)


def centres(points: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Unit centres of a spherical k-means over the points' directions."""
    size = np.linalg.norm(points, axis=1)
    x = points[size > 0] / size[size > 0, None]
    if not len(x):
        return np.zeros((1, points.shape[1]))
    rng = np.random.default_rng(seed)
    found = x[rng.permutation(len(x))[:k]]
    for _ in range(STEPS):
        own = (x @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], found)
    return found


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1.0)[:, None], size


def shared_list(members: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their bound for this cluster, best first, and the bounds in that order.

    A row's score with a member is at most the bound times the member's length."""
    m, m_size = _unit(members)
    r, r_size = _unit(rows)
    centre = m[m_size > 0].sum(0) if (m_size > 0).any() else np.zeros(members.shape[1])
    length = np.linalg.norm(centre)
    if length == 0:
        bound = r_size
    else:
        centre = centre / length
        wide = np.arccos(np.clip(m[m_size > 0] @ centre, -1, 1)).max()
        apart = np.arccos(np.clip(r @ centre, -1, 1))
        bound = r_size * np.cos(np.maximum(0.0, apart - wide))
    # Rounding of cosines and angles is far below this.
    bound = bound + 1e-6 * r_size
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Best:
    """The ``k`` best (score, smaller id first) of every slot."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k = k
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, floor.dtype)
        self.id = np.zeros(0, np.int64)
        #: The least score that can still enter a slot.
        self.need = floor.copy()

    def add(self, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, row_id = (np.concatenate(p) for p in (
            (self.slot, slot), (self.score, score), (self.id, row_id)))
        order = np.lexsort((row_id, -score, slot))
        slot, score, row_id = slot[order], score[order], row_id[order]
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        at = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        keep = at < self.k
        full = at == self.k - 1
        self.need[slot[full]] = np.maximum(self.need[slot[full]], score[full])
        self.slot, self.score, self.id = slot[keep], score[keep], row_id[keep]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of integral vectors."""
    top = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < _EXACT:
        return a @ b.T
    whole = [[[int(x) for x in row] for row in part] for part in (a, b)]
    return np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in whole[1]] for p in whole[0]],
                    dtype=object).reshape(len(a), len(b))


def walk(members: dict, rows: dict, order: np.ndarray, bound: np.ndarray, wanted, best: Best, per: int) -> int:
    """Every member walks the list; ``wanted(members, rows, scores, need)`` marks the pairs to keep by slot.

    A member owns ``per`` slots.  Returns the number of scores computed."""
    reach = np.linalg.norm(members["vec"], axis=1)
    alive = np.arange(len(reach))
    at, step, done = 0, FIRST, 0
    while at < len(order) and len(alive):
        part = order[at:at + step]
        scores = _scores(members["vec"][alive], rows["vec"][part])
        done += scores.size
        need = best.need.reshape(-1, per)[alive]
        for j in range(per):
            r, c = np.nonzero(wanted(alive, part, scores, need[:, j], j))
            best.add(alive[r] * per + j, scores[r, c], rows["id"][part[c]])
        at, step = at + step, NEXT
        if at < len(order):
            least = best.need.reshape(-1, per)[alive].min(1).astype(float)
            alive = alive[reach[alive] * bound[at] >= least - 1e-9 * np.abs(least) - 1.0]
    return done


def _side(table: pa.Table, more: tuple[str, ...] = ()) -> dict:
    n = table.num_rows
    flat = np.asarray(table.column("vec").combine_chunks().flatten(), np.float64)
    out = {"vec": flat.reshape(n, -1) if len(flat) else np.zeros((n, 0)),
           "id": np.asarray(table.column("id"), np.int64), "label": np.asarray(table.column("label"), np.int64)}
    return out | {c: table.column(c).to_pylist() for c in more}


def _parts(left: pa.Table):
    """The clusters of a block of anchors, one after the other."""
    left = left.sort_by([("unit", "ascending"), ("id", "ascending"), ("label", "ascending")])
    if not left.num_rows:
        return
    unit = np.asarray(left.column("unit"))
    begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    for a, b in zip(begin, [*begin[1:], len(unit)], strict=True):
        yield left.slice(int(a), int(b - a))


_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _longs(values) -> pa.Array:
    return pa.array([min(max(int(v), _LOW), _HIGH) for v in values], pa.int64())


def _find_positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _side(right)
        out = [[], [], []]
        for part in _parts(left) if right.num_rows else ():
            own = _side(part)
            order, bound = shared_list(own["vec"], rows["vec"])
            best = Best(len(own["id"]), k, np.full(len(own["id"]), -np.inf))

            def wanted(alive, part_, scores, need, _, own=own):
                return ((rows["label"][part_][None] == own["label"][alive][:, None])
                        & (rows["id"][part_][None] != own["id"][alive][:, None]) & (scores >= need[:, None]))

            walk(own, rows, order, bound, wanted, best, 1)
            out[0].append(own["id"][best.slot])
            out[1].append(best.id)
            out[2] += list(best.score)
        empty = np.zeros(0, np.int64)
        return pa.table({"anchor": np.concatenate([empty, *out[0]]), "positive": np.concatenate([empty, *out[1]]),
                         "score": _longs(out[2])})

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _side(right)
        out = [[], [], [], [], []]
        for part in _parts(left) if right.num_rows else ():
            own = _side(part, ("positives",))
            width = max((len(p) for p in own["positives"]), default=0)
            if not width:
                continue
            m = len(own["id"])
            order, bound = shared_list(own["vec"], rows["vec"])
            scores_of = np.full((m, width), -np.inf)
            for i, p in enumerate(own["positives"]):
                scores_of[i, :len(p)] = [x["score"] for x in p]
            # No row fits a missing positive, nor a negative score: its window is empty.
            floor = np.where(scores_of >= 0, np.ceil(scores_of * low / 100), np.inf)
            best = Best(m * width, k, floor.reshape(-1))

            def wanted(alive, part_, scores, need, j, own=own, scores_of=scores_of):
                top = scores_of[alive, j]
                return ((rows["label"][part_][None] != own["label"][alive][:, None])
                        & (rows["id"][part_][None] != own["id"][alive][:, None])
                        & (100 * scores <= (high * top)[:, None]) & (100 * scores >= (low * top)[:, None])
                        & (scores >= need[:, None]))

            walk(own, rows, order, bound, wanted, best, width)
            who, which = best.slot // width, best.slot % width
            found = [own["positives"][i][j] for i, j in zip(who.tolist(), which.tolist(), strict=True)]
            out[0].append(own["id"][who])
            out[1] += [p["positive"] for p in found]
            out[2] += [p["score"] for p in found]
            out[3].append(best.id)
            out[4] += list(best.score)
        empty = np.zeros(0, np.int64)
        return pa.table({
            "anchor": np.concatenate([empty, *out[0]]), "positive": pa.array(out[1], pa.int64()),
            "positive_score": pa.array(out[2], pa.int64()), "negative": np.concatenate([empty, *out[3]]),
            "score": _longs(out[4])})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over every block of anchors and every block of rows."""
    keys = ["dim", "side", "block"]
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         items: int = ITEMS, anchors_a_block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For every anchor (``is_anchor`` is a condition on the columns ``id`` and ``label``) and each of its best ``positives``
    rows of the same label: the first ``negatives`` rows of another label whose score is from ``low`` to ``high``
    hundredths of the positive's."""
    spark = table.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    ready = written(one.select("id", "label", F.transform("vec", lambda x: whole(x * F.lit(scale))).alias("vec"),
                               F.size("vec").alias("dim")), "negatives-rows")
    asked = ready.filter(is_anchor)
    n_rows, n_anchors = ready.count(), asked.count()
    if not n_anchors:
        return spark.createDataFrame([], out)

    # Clusters of anchors, from a bounded sample of the most frequent vector length.
    dim = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()["dim"]
    drawn = asked.filter(F.col("dim") == dim).select("vec", F.xxhash64(F.lit(SEED), "id", "label").alias("o"), "id").orderBy(
        "o", "id").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    points = np.asarray(drawn.flatten(), float).reshape(len(drawn), dim)
    fitted = spark.sparkContext.broadcast(centres(points, min(CENTRES, max(1, n_anchors // PER_CENTRE))))

    def assign(batches):
        for batch in batches:
            vec = batch.column("vec")
            own = np.zeros(batch.num_rows, np.int32)
            fits = np.flatnonzero(np.asarray(batch.column("dim")) == dim)
            if len(fits) and dim:
                x = np.asarray(vec.take(pa.array(fits)).flatten(), float).reshape(len(fits), dim)
                own[fits] = (x @ fitted.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "cluster"])

    blocks, sides = max(1, -(-n_rows // items)), max(1, -(-n_anchors // anchors_a_block))
    clustered = written(asked.mapInArrow(
        assign, "id long, label long, vec array<double>, dim int, cluster int"), "negatives-anchors")
    per = clustered.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).alias("parts"))
    # A large cluster lies in several units; units are dealt to blocks of anchors by hash.
    units = clustered.join(F.broadcast(per), "cluster").withColumn(
        "unit", F.col("cluster") * F.lit(1 << 31) + F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn(
        "side", F.pmod(F.xxhash64(F.lit(SEED), "unit"), F.lit(sides)).cast("int")).select("id", "label", "vec", "dim", "unit", "side")

    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_side = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    listed = ready.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("side", each_side)
    near = _meet(units.withColumn("block", each_block), listed, _find_positives(positives),
                 "anchor long, positive long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    best = near.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= positives)
    chosen = written(best.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct("at", "positive", "score"))).alias("positives")), "negatives-positives")
    asking = units.join(chosen.withColumnRenamed("anchor", "id"), "id")
    far = _meet(asking.withColumn("block", each_block), listed, _find_negatives(negatives, low, high),
                "anchor long, positive long, positive_score long, negative long, score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative")
    return far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
