"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (runs of letters, lower case) and the first four
and five letters of longer ones, so inflected and compound forms share evidence.
A term's feature is the crc32 of the term, its value ``SCALE * sqrt(count /
words)``, which does not depend on the length of the text.  The machine scores

    margin = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with ``FACTORS`` numbers a term for the pairs, so that two terms can speak
together (an insult beside the mention of a group) where each alone says little;
the pair sum takes one pass, ``(|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.

Learning is distributed: the sample's rows lie in hash blocks of about
``BLOCK_ROWS`` rows.  In each of ``ROUNDS`` rounds every block runs ``EPOCHS``
epochs of adaptive gradient steps from the common parameters, in one task a
block, and the blocks' parameters are averaged by their number of rows.  Every
``KEPT``-th row by hash is not learnt from: a logistic curve on the margins of
those turns margins into probabilities, at the classes' shares among all labels
that may be learnt from.

Bounded samples and sizes (documented parameters; scoring covers all rows and
whole texts): at most ``ROWS`` labelled rows of a class, the first in hash order,
whole texts; of the terms in ``LEAST`` of them or more whose presence differs
between the classes by a chi-square of ``APART``, the ``TERMS`` that differ most.

Defined results: null and empty texts, and texts without a letter, have no terms
and get the curve's value at ``w0``; with labels of one class only, every score is
that class's share (0.5 without labels); rows that repeat id and label count once
as a label, of several texts of one id the smallest is learnt from; equal texts
get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.common import between, crc_of_id, written
from quill.llm.quality import logistic

ROWS = 10_000
TERMS = 1 << 15
LEAST = 3
APART = 6.0
FACTORS = 8
BLOCK_ROWS = 2500
KEPT = 9
ROUNDS = 4
EPOCHS = 3
BATCH = 128
RATE = 0.1
RIDGE = 3e-3
SCALE = 10.0
SEED = 59

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


def word_counts(text: str | None) -> Counter:
    """Counts of the lower-case words of a whole text."""
    counts: Counter = Counter()
    for piece in between(text, _GAP):
        counts.update(_WORD.findall(piece.lower()))
    return counts


def word_terms(word: str) -> list[int]:
    """Hashed terms of one word."""
    terms = [zlib.crc32(word.encode("utf-8", "replace"))]
    for n in (4, 5):
        if len(word) > n:
            terms.append(zlib.crc32((word[:n] + "*").encode("utf-8", "replace")))
    return terms


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a text, ascending, and their values."""
    counts = word_counts(text)
    sums: dict[int, int] = {}
    for word, n in counts.items():
        for term in word_terms(word):
            sums[term] = sums.get(term, 0) + n
    terms = np.fromiter(sums.keys(), np.int64, len(sums))
    number = np.fromiter(sums.values(), np.float64, len(sums))
    order = np.argsort(terms)
    return terms[order], SCALE * np.sqrt(number[order] / max(1, counts.total()))


@dataclass
class Machine:
    """Parameters by place in ``terms`` (ascending); the curve is ``slope * margin + shift``."""

    terms: np.ndarray
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, terms: np.ndarray, values: np.ndarray) -> float:
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, x = at[known], values[known]
        both = self.pairs[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * ((both.sum(0) ** 2) - (both ** 2).sum(0)).sum())


def start(terms: np.ndarray, seed: int = SEED) -> Machine:
    rng = np.random.default_rng(seed)
    return Machine(terms, 0.0, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), FACTORS)))


def gradients(machine: Machine, starts: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray,
              weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the weighted logistic loss: by row for the bias, by entry for ``linear`` and ``pairs``.

    Row ``i`` owns the entries from ``starts[i]`` to ``starts[i + 1]``."""
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(y)), sizes)
    both = machine.pairs[at] * x[:, None]
    sums = np.zeros((len(y), FACTORS))
    full = sizes > 0
    if len(at):
        sums[full] = np.add.reduceat(both, starts[:-1][full])
    margin = (machine.bias + np.bincount(row, machine.linear[at] * x, len(y))
              + 0.5 * ((sums ** 2).sum(1) - np.bincount(row, (both ** 2).sum(1), len(y))))
    g = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
    return g, g[row] * x, (g[row] * x)[:, None] * (sums[row] - both)


def learn(machine: Machine, starts: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray,
          weight: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Adaptive gradient steps over small batches of rows, in the given order."""
    out = Machine(machine.terms, machine.bias, machine.linear.copy(), machine.pairs.copy())
    seen0, seen1, seen2 = 1e-6, np.full(len(out.linear), 1e-6), np.full(out.pairs.shape, 1e-6)
    for _ in range(epochs):
        for first in range(0, len(y), BATCH):
            last = min(first + BATCH, len(y))
            a, b = starts[first], starts[last]
            g0, g1, g2 = gradients(out, starts[first:last + 1] - a, at[a:b], x[a:b], y[first:last], weight[first:last])
            n = last - first
            step = g0.sum() / n
            seen0 += step ** 2
            out.bias -= RATE * step / np.sqrt(seen0)
            if a == b:
                continue
            used, place = np.unique(at[a:b], return_inverse=True)
            d1 = np.bincount(place, g1) / n + RIDGE * out.linear[used]
            seen1[used] += d1 ** 2
            out.linear[used] -= RATE * d1 / np.sqrt(seen1[used])
            d2 = np.stack([np.bincount(place, g2[:, f]) for f in range(FACTORS)], 1) / n + RIDGE * out.pairs[used]
            seen2[used] += d2 ** 2
            out.pairs[used] -= RATE * d2 / np.sqrt(seen2[used])
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("id", "y", "block", "o")]
            + [pa.array([f[0] for f in found], pa.list_(pa.int64())),
               pa.array([f[1] for f in found], pa.list_(pa.float64()))],
            ["id", "y", "block", "o", "terms", "vals"])


def _packed(machine: Machine) -> bytes:
    return b"".join([np.float64(machine.bias).tobytes(), machine.linear.tobytes(), machine.pairs.tobytes()])


def _unpacked(terms: np.ndarray, data: bytes) -> Machine:
    n = len(terms)
    all_ = np.frombuffer(data, np.float64)
    return Machine(terms, float(all_[0]), all_[1:n + 1].copy(), all_[n + 1:].reshape(n, FACTORS).copy())


def _average(parts: list[tuple[Machine, int]]) -> Machine:
    total = sum(n for _, n in parts)
    out = Machine(parts[0][0].terms, 0.0, np.zeros_like(parts[0][0].linear), np.zeros_like(parts[0][0].pairs))
    for m, n in parts:
        out.bias += m.bias * n / total
        out.linear += m.linear * (n / total)
        out.pairs += m.pairs * (n / total)
    return out


def _block_step(sent, weight: dict[int, float]):
    """What one block does in a round: epochs from the common parameters, rows in hash order."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("o", "ascending"), ("id", "ascending")])
        starts, at, x = _entries(sent.value, part)
        y = np.asarray(part.column("y"), float)
        new = learn(sent.value, starts, at, x, y, np.where(y == 1, weight[1], weight[0]))
        return pa.table({"data": pa.array([_packed(new)], pa.binary()), "n": pa.array([len(y)], pa.int64())})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Machine:
    """The machine of the labelled rows of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1)).distinct().join(rows.select("id"), "id", "left_semi")
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 0.5
    if len(count) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(np.zeros(0, np.int64), shift=float(np.log(p / (1 - p))))

    # A top-k of ROWS ids a class in hash order: the broadcast of ids is bounded.
    keyed = known.withColumn("o", F.xxhash64(F.lit(SEED), "id", "y"))
    first = [keyed.filter(F.col("y") == y).orderBy("o", "id").limit(ROWS) for y in (0, 1)]
    sample = rows.join(F.broadcast(first[0].unionByName(first[1])), "id").groupBy("id", "y", "o").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"))
    blocks = max(1, -(-sum(min(ROWS, n) for n in count.values()) // BLOCK_ROWS))
    blocked = sample.select("id", "y", "o", "text", F.when(
        F.pmod("o", F.lit(KEPT)) == 0, -1).otherwise(F.pmod(F.xxhash64("o"), F.lit(blocks))).cast("int").alias("block"))
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, y int, block int, o long, terms array<long>, vals array<double>"
    table = written(blocked.select("id", "y", "block", "o", "text").mapInArrow(_extract, shape), "toxicity-terms")

    # Terms that differ most between the classes; TERMS of them come to the driver.
    drawn = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(drawn.get(1, 0)), float(drawn.get(0, 0))
    per = table.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n")).filter(F.col("n") >= LEAST)
    odd = F.col("a") * n0 - (F.col("n") - F.col("a")) * n1
    chi = odd * odd * (n0 + n1) / (n0 * n1 * F.col("n") * F.greatest(F.lit(n0 + n1) - F.col("n"), F.lit(1.0)))
    best = per.select("term", chi.alias("d")).filter(F.col("d") >= APART).orderBy(F.desc("d"), "term").limit(
        TERMS).select("term").collect()
    machine = start(np.sort(np.asarray([r["term"] for r in best], np.int64)))
    weight = {0: (n0 + n1) / (2 * n0), 1: (n0 + n1) / (2 * n1)}

    for _ in range(ROUNDS):
        step = _block_step(spark.sparkContext.broadcast(machine), weight)
        found = table.filter(F.col("block") >= 0).groupBy("block").applyInArrow(step, "data binary, n long").collect()
        if found:
            # In a fixed order: a sum of floats depends on it.
            parts = sorted(((bytes(r["data"]), r["n"]) for r in found), key=lambda p: (p[1], p[0]))
            machine = _average([(_unpacked(machine.terms, d), n) for d, n in parts])

    # The curve, from rows that were not learnt from (from all, where there are too few).
    sent = spark.sparkContext.broadcast(machine)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [sent.value.margin(np.asarray(t, np.int64), np.asarray(v, float)) for t, v in
                 zip(batch.column("terms").to_pylist(), batch.column("vals").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("block"), batch.column("o"),
                                              pa.array(m, pa.float64())], ["y", "block", "o", "margin"])

    seen = table.select("y", "block", "o", "terms", "vals").mapInArrow(margins, "y int, block int, o long, margin double") \
        .orderBy("o", "y").collect()
    kept = [r for r in seen if r["block"] < 0]
    if len({r["y"] for r in kept}) < 2:
        kept = seen
    x, y = np.asarray([[r["margin"]] for r in kept]), np.asarray([r["y"] for r in kept], float)
    scale = float(x.std()) or 1.0
    slope, shift = logistic(x / scale, y)
    drawn_share = y.mean()
    machine.slope = float(slope / scale)
    machine.shift = float(shift + np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share)))
    return machine


def _entries(machine: Machine, part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, places and values of the entries whose term the machine knows."""
    terms = part.column("terms").combine_chunks()
    vals = part.column("vals").combine_chunks()
    all_terms, all_vals = np.asarray(terms.flatten()), np.asarray(vals.flatten())
    sizes = np.asarray(pa.compute.list_value_length(terms), np.int64)
    at = np.searchsorted(machine.terms, all_terms)
    at[at == len(machine.terms)] = 0
    known = machine.terms[at] == all_terms if len(machine.terms) else np.zeros(len(all_terms), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)[known]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int64)
    return starts, at[known], all_vals[known]


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, margin)``: the probability of label 1 for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = {int(t): i for i, t in enumerate(m.terms)}
        known: dict[str, list[int]] = {}
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                counts = word_counts(text)
                sums: dict[int, int] = {}
                for word, n in counts.items():
                    own = known.get(word)
                    if own is None:
                        if len(known) >= 500_000:
                            known.clear()
                        own = known[word] = [place[t] for t in word_terms(word) if t in place]
                    for at in own:
                        sums[at] = sums.get(at, 0) + n
                at = np.fromiter(sorted(sums), np.int64, len(sums))
                n = np.fromiter((sums[i] for i in at.tolist()), np.float64, len(sums))
                found.append(m.margin(m.terms[at], SCALE * np.sqrt(n / max(1, counts.total()))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "margin"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    z = F.lit(machine.slope) * F.col("margin") + F.lit(machine.shift)
    return rows.mapInArrow(run, f"id {kind}, margin double").select("id", (1 / (1 + F.exp(-z))).alias("score"), "margin")


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels no model may learn from."""
    return crc_of_id(F.col(id_col)) % 4 == 2
