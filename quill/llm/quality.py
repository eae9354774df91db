"""Quality by compression.

Two zstandard dictionaries are made of labelled text, one good and one bad.
Every text is compressed with each, in blocks of ``BLOCK`` bytes that start
from the dictionary anew, so a long text speaks about its whole length.  The
difference of the two sizes per byte says which dictionary knows the text
better; a logistic curve on it and on the smaller size per byte (how much the
text repeats itself), fitted to labelled rows that are not in the dictionaries,
turns it into a probability.

Bounded samples (documented parameters; everything else covers all rows): the
dictionaries take ``DICT_BYTES`` each from the ``DICT_ROWS`` labelled rows of a
class that come first in hash order, slices of ``SLICE`` bytes of each in turn, from places
all over its length that a hash of its id draws; the curve is
fitted to the next ``FIT_ROWS`` rows of each class, whole texts.

Defined results: null and empty texts have no evidence and no size, and get the
curve's value there; a class without labelled rows gets an empty
dictionary, and without both classes every score is the share of label 1
(0.5 without labels).  Equal texts get equal scores.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.common import crc_of_id, written

DICT_BYTES = 256 << 10
DICT_ROWS = 1000
SLICE = 256
FIT_ROWS = 3000
BLOCK = 2048
LEVEL = 9


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slopes: tuple[float, float] = (0.0, 0.0)
    shift: float = 0.0


def dictionary(texts: list[str], room: int = DICT_BYTES, each: int = SLICE) -> bytes:
    """Raw dictionary content: slices of the texts, taken in turn from all of them until the room is full."""
    out, size, at = [], 0, 0
    raw = [t.encode("utf-8", "replace") for t in texts]
    while size < room:
        found = [r[at:at + each] for r in raw if len(r) > at]
        if not found:
            break
        for part in found:
            out.append(part[:room - size])
            size += len(out[-1])
            if size >= room:
                break
        at += each
    return b"\n".join(out)


class Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [self._compressor(good), self._compressor(bad)]

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        params = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if len(content) < 8:
            return zstd.ZstdCompressor(**params)
        made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(dict_data=made, **params)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """(bad size - good size) and the smaller size, per byte, over all blocks of the whole text."""
        raw = memoryview((text or "").encode("utf-8", "replace"))
        n = len(raw)
        if not n:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(raw[at:at + BLOCK])) for at in range(0, n, BLOCK)) for c in self.by)
        return (bad - good) / n, min(good, bad) / n


_KEPT: dict[int, Sizer] = {}


def _sizer(model: Model) -> Sizer:
    key = hash((model.good, model.bad))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Sizer(model.good, model.bad)
    return _KEPT[key]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Slopes and shift of P(y = 1 | x), by Newton steps on the penalised likelihood."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(hessian, a.T @ (y - p) - ridge * w), -5, 5)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def drawn_slices(room: int) -> Column:
    """``room`` characters of a text at most: its slices of ``SLICE`` characters in the hash order of their places."""
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / F.lit(SLICE)).cast("int")
    places = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.xxhash64(F.lit(37), F.col("id"), i).alias("h"), i.alias("i"))))
    some = F.slice(places, 1, -(-room // SLICE))
    return F.substring(F.array_join(F.transform(
        some, lambda x: F.substring(F.col("text"), x["i"] * SLICE + 1, F.lit(SLICE))), ""), 1, room)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Dictionaries and curve from the labelled rows of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        F.col("text").isNotNull())
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1)).join(rows.select("id"), "id", "left_semi")
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 0.5
    # The first rows of a class in hash order: a top-k of DICT_ROWS + FIT_ROWS ids, so the broadcast is bounded.
    keyed = known.distinct().withColumn("o", F.xxhash64(F.lit(23), "id", "y"))
    first = [keyed.filter(F.col("y") == y).orderBy("o", "id").limit(DICT_ROWS + FIT_ROWS) for y in (0, 1)]
    texts = rows.join(F.broadcast(first[0].unionByName(first[1])), "id").groupBy("id", "y", "o").agg(
        F.min("text").alias("text"))
    kept = written(texts, "quality-sample")
    # Of the sample, half its rows at most make the dictionaries.
    part: dict[int, list[str]] = {}
    rest: list[DataFrame] = []
    for y in (0, 1):
        own = kept.filter(F.col("y") == y)
        n = own.count()
        use = min(DICT_ROWS, n // 2) if n > 1 else n
        head = own.orderBy("o", "id").limit(use)
        room = max(SLICE, 4 * DICT_BYTES // max(use, 1))
        part[y] = [r["text"] for r in head.select(drawn_slices(room).alias("text")).collect()]
        rest.append(own.join(F.broadcast(head.select("id")), "id", "left_anti"))
    good, bad = dictionary(part[1]), dictionary(part[0])
    found = evidence(rest[0].unionByName(rest[1]), Model(good, bad), "id", "text", ["y"]).collect()
    x = np.asarray([(r["evidence"], r["density"]) for r in found], float)
    y = np.asarray([r["y"] for r in found], float)
    p = min(max(share, 1e-3), 1 - 1e-3)
    if len(set(y)) < 2:
        return Model(good, bad, shift=float(np.log(p / (1 - p))))
    # Rows are sampled by class; the curve's shift is set back to the classes' shares among all labels.
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    *slopes, shift = logistic(x / scale, y)
    drawn = y.mean()
    shift += np.log(p / (1 - p)) - np.log(drawn / (1 - drawn))
    a, b = (slopes / scale).tolist()
    return Model(good, bad, (a, b), float(shift))


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``(id, evidence, density)`` of every whole text, and the columns to keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _sizer(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [sizer.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in keep), *(pa.array(f, pa.float64()) for f in zip(*found, strict=True))],
                ["id", *keep, "evidence", "density"])

    kinds = dict(docs.dtypes)
    return docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, ", ".join([f"id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "evidence double, density double"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, evidence)``: the probability of label 1 for every whole text."""
    z = model.slopes[0] * F.col("evidence") + model.slopes[1] * F.col("density") + model.shift
    return evidence(docs, model, id_col, text_col).select(
        "id", (1 / (1 + F.exp(-z))).alias("score"), "evidence", "density")


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels no model may learn from."""
    return crc_of_id(F.col(id_col)) % 3 == 1
