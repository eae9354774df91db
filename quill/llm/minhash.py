"""Near-duplicate documents by HyperMinHash.

Sketch: the distinct word shingles of a text are hashed into ``REGISTERS``
buckets; a bucket keeps its smallest hash as a 16-bit register, the number of
leading zeros and the ``MANTISSA`` bits after the leading one.  A bucket that
no shingle hits takes the smallest of a hash of its own over all shingles, so
short texts have full sketches and two registers agree with the probability of
the Jaccard similarity, whatever the sizes.

Candidates: texts with the same set of shingles are collapsed first.  The
registers are cut into bands; texts that agree in a band are candidates.  Bands
are as long as the threshold lets them be while a pair at the threshold is
missed with a probability under ``MISSED``: 40 of 7 registers at 0.85, where it
is (1 - 0.85**7)**40 < 2e-7, and 46 of 6 at 0.8, where it is under 9e-7.

Links: agreeing registers, less the collisions expected by chance, estimate the
similarity; pairs more than six standard deviations under the threshold are
dropped and the others are confirmed on the full sets.

No group is expanded into pairs.  In each band's group all members are first
compared with one hub, the member with most candidates, and components are
formed.  Groups that still hold several components are compared in blocks of
``BLOCK`` members: a task has the sketches and sets of two blocks, skips pairs
that are already connected, takes the others by falling estimate, and returns
the links that connect something.  Every candidate pair is thus compared, or is
connected anyway.

Defined results: A-Z are lower-cased, words are runs without ASCII white space;
fewer than ``WORDS`` words make one shingle; a null text or one without words
has no shingle and no link; rows of one id are one document; rows with a null
id are not linked and have a null component; an empty table gives no row; extra
columns are ignored.  Very long texts are hashed in blocks of ``TEXT_BLOCK``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quill.llm.common import written
from quill.llm.graph import attach, components

WORDS = 5
REGISTERS = 280
MISSED = 1e-6
MANTISSA = 10
THRESHOLD = (85, 100)
BLOCK = 128
TEXT_BLOCK = 4 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "replace").lower()
    found, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > TEXT_BLOCK:
            cut = _SPACE.search(raw, at + TEXT_BLOCK)
            end = cut.start() if cut else end
        words = raw[at:end].split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    w = _word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    total = np.full(n, k * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        total += _mixed(w[i:i + n]) * _FACTORS[i % 8] * np.uint64(2 * (i // 8) + 1)
    return np.unique(_mixed(total))


def _packed(smallest: np.ndarray) -> np.ndarray:
    """16-bit registers of 53-bit minima: leading zeros, then the bits after the leading one."""
    part, bits = np.frexp(smallest.astype(np.float64))
    zeros = np.clip(53 - bits, 0, 63).astype(np.uint16)
    rest = np.where(smallest > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | rest


def sketch(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers of a set of hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
    key = (bucket << np.uint64(53)) | (_mixed(hashes + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11))
    key.sort()
    first = np.searchsorted(key, np.arange(registers, dtype=np.uint64) << np.uint64(53))
    hit = first < len(key)
    low = key[np.minimum(first, len(key) - 1)]
    hit &= (low >> np.uint64(53)) == np.arange(registers, dtype=np.uint64)
    smallest = low & np.uint64((1 << 53) - 1)
    for part in np.array_split(np.flatnonzero(~hit), max(1, (~hit).sum() * len(hashes) // (1 << 20))):
        seeds = _mixed((part.astype(np.uint64) + np.uint64(1)) * _FACTORS[0])
        smallest[part] = _mixed(hashes[None, :] ^ seeds[:, None]).min(1) >> np.uint64(11) if len(part) else 0
    return _packed(smallest)


def expected_collisions(n: np.ndarray, m: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of two disjoint sets of n and m members that agree by chance."""
    return 0.1699194871597391 * registers / 2.0 ** MANTISSA * 4.0 * n * m / (n + m) ** 2


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers."""
    return (agree - expected_collisions(n, m, registers)) / registers


def least_estimate(threshold: tuple[int, int] = THRESHOLD, registers: int = REGISTERS) -> float:
    j = threshold[0] / threshold[1]
    return j - 6 * (j * (1 - j) / registers) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bool:
    """Whether two full sets reach the threshold, in integers."""
    part, whole = threshold
    if min(len(a), len(b)) * whole < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * whole >= part * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, n, digest, regs)``: size, fingerprint and registers of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, regs = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n long, digest binary, regs binary")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(id, regs, members)`` of the documents in ``ids``, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([sketch(s).tobytes() if len(s) else None for s in found], pa.binary()),
                 pa.array([s.tobytes() for s in found], pa.binary())], ["id", "regs", "members"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(run, f"id {kind}, regs binary, members binary")


def band_rows(threshold: tuple[int, int] = THRESHOLD, registers: int = REGISTERS) -> int:
    """Registers of a band: the most that miss a pair at the threshold with a probability under ``MISSED``."""
    j = threshold[0] / threshold[1]
    return max((r for r in range(1, registers + 1) if (1 - j ** r) ** (registers // r) <= MISSED), default=1)


def bands(reps: DataFrame, rows: int) -> DataFrame:
    """``(key, id)``: a row for each band of ``rows`` registers of each sketch."""
    width = 2 * rows
    keys = F.array(*(F.xxhash64(F.substring("regs", i * width + 1, width), F.lit(i))
                     for i in range(REGISTERS // rows)))
    return reps.select(F.explode(keys).alias("key"), "id")


def _confirm(threshold: tuple[int, int]):
    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("regs", "members", "hub_regs", "hub_members")]
            for i, (ra, sa, rb, sb) in enumerate(zip(*columns, strict=True)):
                agree = (np.frombuffer(ra, np.uint16) == np.frombuffer(rb, np.uint16)).sum()
                if estimate(agree, len(sa) // 8, len(sb) // 8) >= least and linked(
                        np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), threshold):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("id", "hub")], ["a", "b"])

    return run


def _block_links(threshold: tuple[int, int], schema: pa.Schema):
    """Links between members of one or two blocks that connect components."""
    least = least_estimate(threshold)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        ids = table.column("id").to_pylist()
        block = np.asarray(table.column("block"))
        regs = np.stack([np.frombuffer(r, np.uint16) for r in table.column("regs").to_pylist()])
        sets = [np.frombuffer(s, np.uint64) for s in table.column("members").to_pylist()]
        size = np.asarray([len(s) for s in sets])
        _, comp = np.unique(table.column("component").to_pylist(), return_inverse=True)
        comp = comp.copy()
        one = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        guess, left, right = [], [], []
        for i in range(len(ids) - 1):
            agree = (regs[i + 1:] == regs[i]).sum(1)
            est = estimate(agree, size[i], size[i + 1:])
            ok = (est >= least) & (comp[i + 1:] != comp[i])
            if not one:
                ok &= block[i + 1:] != block[i]
            at = np.flatnonzero(ok)
            guess.append(est[at])
            left.append(np.full(len(at), i))
            right.append(at + i + 1)
        a, b = [], []
        if guess:
            guess, left, right = (np.concatenate(x) for x in (guess, left, right))
            for k in np.argsort(-guess, kind="stable"):
                i, j = left[k], right[k]
                if comp[i] != comp[j] and linked(sets[i], sets[j], threshold):
                    comp[comp == comp[j]] = comp[i]
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": a, "b": b}, schema=schema)

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``(id, n, component)`` of every row: shingles, and the smallest id that links reach."""
    kind = dict(docs.dtypes)[id_col]
    made = written(sketches(docs, id_col, text_col, words), "sketches")
    own = made.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    groups = written(own.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    total = own.count()

    doubled = attach(own.select("id", "digest"), groups.filter("copies > 1"), "digest", "copies", total)
    others = doubled.filter("id <> rep").select("id").distinct()
    reps = own.select("id", "regs").join(others, "id", "left_anti")

    every = written(bands(reps, band_rows(threshold)), "bands")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("hi"), F.min("id").alias("lo")) \
        .filter("n > 1 and hi <> lo").select("key", "n")
    members = written(every.join(shared, "key"), "band-members")

    # The hub of a group: the member with most candidates over all its groups.
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = written(members.join(degree, "id"), "band-degrees")
    hubs = ranked.groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("hub"))
    pairs = ranked.select("key", "id").join(hubs, "key").filter("id <> hub").select("id", "hub").distinct()
    sets = written(full_sets(docs, degree.select("id"), id_col, text_col, words), "sets")
    hub_sets = sets.select(F.col("id").alias("hub"), F.col("regs").alias("hub_regs"),
                           F.col("members").alias("hub_members"))
    stars = written(pairs.join(sets, "id").join(hub_sets, "hub").select(
        "id", "hub", "regs", "members", "hub_regs", "hub_members").mapInArrow(
            _confirm(threshold), f"a {kind}, b {kind}"), "star-links")
    near = components(stars)

    # Groups that still hold several components; groups with the same members are compared once.
    state = ranked.select("key", "id", "n").distinct().join(near, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_ = state.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same")).filter("lo <> hi and n > 2")
    once = open_.groupBy("same", "n").agg(F.min("key").alias("key")).withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("key", "blocks")
    dealt = state.select("key", "id", "component").join(once, "key").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "id", "component", "block", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"))
    node = docs.schema[id_col].dataType
    out = StructType([StructField("a", node), StructField("b", node)])
    rest = both.join(sets, "id").groupBy("key", "low", "high").applyInArrow(
        _block_links(threshold, to_arrow_schema(out)), out)
    links = stars.unionByName(written(rest, "block-links"))
    final = components(links)

    label = groups.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", "copies", F.coalesce("component", "rep").alias("component"))
    found = attach(own.select("id", "n", "digest"), label, "digest", "copies", total).select("id", "n", "component")
    alone = made.filter(F.col("digest").isNull() | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    return found.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with the document of smallest id of each group, all columns kept."""
    gone = near_groups(docs, id_col, text_col, words, threshold).filter(F.col("id") != F.col("component"))
    return docs.join(gone.select(F.col("id").alias(id_col)), id_col, "left_anti")
