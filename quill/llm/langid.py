"""Language identification by multilingual mixture inference.

Model: byte-trigram distributions, one for each language, over ``BUCKETS``
hashed trigrams, counted over every labelled training document (map tasks
count, one small aggregate adds up).  A document is a mixture of languages:
expectation-maximisation estimates the proportions from the likelihoods of its
trigrams.  Its set of languages grows one by one from the best single language;
a language joins while it raises the log-likelihood by more than a penalty of
``PENALTY * log(trigrams)`` (Bayesian information criterion; overlapping
trigrams carry about a third of their number of independent observations).
The log-likelihood is concave in the proportions, so its gradient bounds the
possible gain: where the bound is under the penalty, no further language can
pay and the search ends.

Prediction: the language with the largest proportion; score: that proportion.

The whole text counts, in blocks of ``BLOCK`` characters, so memory stays
bounded for very long texts.  Upper and lower case are folded, every ASCII
character but letters separates words.

Defined results: a null text or one without a letter is ``und`` with score 0;
with no training rows every text is ``und``; ties go to the language first in
alphabetical order; rows are scored one by one, so repeated rows get equal
results.  More than ``MAX_LANGUAGES`` labels are refused (the model, of
``BUCKETS`` floats a language, is sent to every task).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.common import crc_of_id, written

BUCKETS = 1 << 15
BLOCK = 1 << 20
PENALTY = 1.5
SMOOTH = 0.5
MAX_LANGUAGES = 500
EM_STEPS = 40
EM_TOL = 1e-4
UNKNOWN = "und"

#: Runs of what is no decimal digit, mark or blank; letters and other numerals (such as a superscript two).
_RUN = re.compile(r"[^\W\d_]+")
#: Every ASCII byte that is no lower-case letter separates words.
_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the words of a text, each word with a blank on both sides."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(_WORDS).split())
    if not words:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the whole text and their counts."""
    if len(text) <= BLOCK:
        return np.unique(trigrams(text), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), BLOCK):
        total += np.bincount(trigrams(text[at:at + BLOCK]), minlength=BUCKETS)
    grams = np.flatnonzero(total)
    return grams, total[grams]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for at in range(0, len(text), BLOCK):
                table += np.bincount(trigrams(text[at:at + BLOCK]), minlength=BUCKETS)
        if len(tables) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for lang, table in tables.items():
        grams = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(table[grams])],
            ["lang", "gram", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram distributions from all rows of ``(text, lang)``.

    Languages x ``BUCKETS`` numbers come to the driver, whatever the rows.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.mapInArrow(_count_batches, "lang string, gram int, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("gram", "n"))).alias("t")) \
        .select("lang", F.col("t.gram").alias("g"), F.col("t.n").alias("c"))
    found = written(packed, "langid-model")
    if found.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = sorted(found.collect(), key=lambda r: r["lang"])
    probs = np.full((BUCKETS, len(model)), SMOOTH)
    for i, r in enumerate(model):
        probs[np.asarray(r["g"], int), i] += np.asarray(r["c"], float)
    return [r["lang"] for r in model], probs / probs.sum(0) if len(model) else probs


def proportions(counts: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Language proportions of one document: ``counts`` of its trigrams, ``like`` their likelihoods (trigrams x languages)."""
    n, k = counts.sum(), like.shape[1]
    if k == 1:
        return np.ones(1)
    theta = np.zeros(k)
    chosen = [int(np.argmax(counts @ np.log(like)))]
    theta[chosen] = 1.0
    penalty = PENALTY * np.log(max(n, 2))
    mixed = like[:, chosen[0]]
    while len(chosen) < k:
        gradient = (counts / mixed) @ like / n
        gradient[chosen] = 0
        best = int(np.argmax(gradient))
        if n * (gradient[best] - 1) <= penalty:
            break
        now, old = counts @ np.log(mixed), theta
        pick = [*chosen, best]
        part = like[:, pick]
        share = np.append(theta[chosen] * 0.8, 0.2)
        for _ in range(EM_STEPS):
            new = share * ((counts / (part @ share)) @ part) / n
            moved, share = np.abs(new - share).max(), new
            if moved < EM_TOL:
                break
        tried = part @ share
        if counts @ np.log(tried) - now <= penalty:
            theta = old
            break
        theta = np.zeros(k)
        theta[pick] = share / share.sum()
        chosen, mixed = pick, tried
    return theta


def has_letter(text: str) -> bool:
    """Whether a character of a letter category is in the text; numerals that are no digits are none."""
    return any(any(map(str.isalpha, m.group())) for m in _RUN.finditer(text))


def detect(text: str | None, languages: list[str], probs: np.ndarray) -> tuple[str, float, dict[str, float]]:
    """Language, score and mixture of one whole text."""
    if not text or not languages or not has_letter(text):
        return UNKNOWN, 0.0, {}
    grams, counts = gram_counts(text)
    if not len(grams):
        # Letters, but none that has a byte to count: nothing speaks for any language more than for another.
        return languages[0], 1.0 / len(languages), {}
    theta = proportions(counts.astype(float), probs[grams])
    best = int(np.argmax(theta))
    return languages[best], float(min(1.0, theta[best])), {
        languages[i]: float(theta[i]) for i in np.flatnonzero(theta > 0)}


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, mixture)`` for every row, from its text alone."""
    languages, probs = model
    sent = docs.sparkSession.sparkContext.broadcast(probs.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            found = [detect(t, languages, table) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                ["id", "lang_pred", "score", "mixture"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, mixture map<string,double>")


def known(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is in a language that can be told."""
    languages, probs = model
    sent = docs.sparkSession.sparkContext.broadcast(probs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(t, languages, sent.value)[0] != UNKNOWN for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the documents no model may learn from."""
    return crc_of_id(F.col(id_col)) % 4 == 2


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce(held_out(), F.lit(True))).select("text", "lang")
