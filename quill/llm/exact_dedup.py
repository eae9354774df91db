"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only).

The filter is blocked: a document's hash names one 64-bit word and ``K`` bits in
it.  Pass 1 counts these patterns, 8 bytes a document after a partial aggregate,
and sets the bits of the patterns that were met more than once.  Pass 2 probes
the words: a document whose bits are all set is *possibly repeated* and is
shuffled by its digest; every other document is certainly unique and passes
straight through, without its digest or id being moved.

The filter has a power of two of about ``BITS_PER_ROW`` bits for each repeated
pattern, so it is as empty at any size of the table.  A slice of it, ``MAX_BITS``
at most, is broadcast (``MAX_BITS / 64`` words, a proven bound); a filter of more
slices is probed a slice at a time.  Fingerprints lie sorted by hash within each
file, so the rows of a slice are a range of every file.

Hot texts: sizes of groups come from a partial aggregate.  Groups over
``max(HOT_ROWS, rows / MAX_HOT)`` rows, ``MAX_HOT`` at most, are joined back as
a broadcast table, so no task receives the rows of a hot text; all other groups
are joined by a shuffle on the hash.

Defined results: a null text is the empty text; rows that repeat both id and
text are one document; a null id is a document of its own that sorts below
every other id; extra columns are ignored (``exact_groups``) or kept as they
are (``drop_exact_copies``).  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.common import folded, written

K = 3
BITS_PER_ROW = 16
MIN_BITS = 1 << 16
MAX_BITS = 1 << 26
HOT_ROWS = 100_000
MAX_HOT = 50_000


def total_bits(n: int) -> int:
    """Size of the filter for ``n`` patterns: a power of two, ``MIN_BITS`` at least."""
    return max(MIN_BITS, 1 << (BITS_PER_ROW * max(n, 1) - 1).bit_length())


def filter_bits(n: int) -> int:
    """Size of one slice of the filter for ``n`` patterns: ``MAX_BITS`` at most."""
    return min(MAX_BITS, total_bits(n))


def _word(spot: Column, bits: int) -> Column:
    """Word of a filter of ``bits`` bits: the leading bits of the hash, in its order."""
    lead = (bits // 64).bit_length() - 1
    return F.shiftright(spot, 64 - lead) + F.lit(1 << (lead - 1)) if lead else F.lit(0).cast("long")


def _mask(places: str) -> Column:
    """The ``K`` bits that the low 6 * ``K`` bits of a number name."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({places}, {6 * i}) & 63 as int))" for i in range(K)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, spot)``: the binary SHA-256 of each normalised text and the hash that places it in the filter."""
    digest = F.unhex(F.sha2(folded(F.col(text_col).cast("string")).cast("binary"), 256))
    return docs.select(F.col(id_col).alias("id"), digest.alias("digest")).withColumn("spot", F.xxhash64("digest"))


def repeated_patterns(prints: DataFrame, bits: int) -> DataFrame:
    """Pass 1: ``(pattern)``, word and bits in one number, of those that were met more than once."""
    low = F.col("spot").bitwiseAND(F.lit((1 << 6 * K) - 1))
    pattern = F.shiftleft(_word(F.col("spot"), bits), 6 * K).bitwiseOR(low)
    return prints.groupBy(pattern.alias("pattern")).count().filter("count > 1").select("pattern")


def words_of(patterns: DataFrame, bits: int, fewer: int) -> DataFrame:
    """``(word, mask)`` of the filter of ``fewer`` bits that holds patterns made for ``bits`` bits."""
    shift = 6 * K + (bits // fewer).bit_length() - 1
    return patterns.groupBy(F.shiftright("pattern", shift).alias("word")).agg(F.bit_or(_mask("pattern")).alias("mask"))


def repeated_words(prints: DataFrame, bits: int) -> DataFrame:
    """The filter's words ``(word, mask)`` with the bits of all patterns that were met more than once."""
    return words_of(repeated_patterns(prints, bits), bits, bits)


def probe(prints: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Pass 2: ``maybe`` is true where all bits of a row are set."""
    asked = prints.withColumn("word", _word(F.col("spot"), bits)).withColumn("bits", _mask("spot"))
    hit = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.col("bits")) == F.col("bits")
    return asked.join(F.broadcast(words), "word", "left").select("id", "digest", hit.alias("maybe"))


def probed_by_slices(prints: DataFrame, rows: int) -> DataFrame:
    """``(id, digest, maybe)`` of all rows; each slice of the filter is broadcast and dropped before the next."""
    made = total_bits(rows)
    patterns = written(repeated_patterns(prints, made), "patterns")
    n = patterns.count()
    bits = min(made, total_bits(n))
    words = written(words_of(patterns, made, bits), "filter")
    slices = max(1, bits // filter_bits(n))
    parts = []
    for i in range(slices):
        low, high = (-(1 << 63) + (j << 64) // slices for j in (i, i + 1))
        own = prints.filter((F.col("spot") >= low) & (F.col("spot") <= high - 1))
        each = bits // 64 // slices
        some = words.filter((F.col("word") >= i * each) & (F.col("word") < (i + 1) * each))
        parts.append(written(probe(own, some, bits), "probed"))
    return reduce(DataFrame.unionByName, parts)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``exact_groups``, and ``(id, digest)`` of those that several rows have."""
    prints = written(fingerprints(docs, id_col, text_col).sortWithinPartitions("spot"), "fingerprints")
    rows = prints.count()
    probed = probed_by_slices(prints, rows)

    alone = probed.filter(~F.col("maybe")).select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = written(probed.filter("maybe").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")), "possibly-repeated")
    groups = written(maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                     "groups")
    limit = max(HOT_ROWS, rows // MAX_HOT)
    hot = F.broadcast(groups.filter(F.col("group_size") > limit).withColumnRenamed("digest", "hot_digest"))
    rest = groups.filter(F.col("group_size") <= limit)
    tagged = maybe.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    in_hot = tagged.filter(F.col("hot_digest").isNotNull()).select("id", "digest", "keep_id", "group_size")
    in_rest = (tagged.filter(F.col("hot_digest").isNull()).select("id", "digest")
               .join(rest, "digest").select("id", "digest", "keep_id", "group_size"))
    every = alone.unionByName(in_hot).unionByName(in_rest)
    again = maybe.filter("n > 1").select("id", "digest")
    return every.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))), again


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, keep_id, group_size, kept)``, a row for every document.

    Of equal texts the document with the largest id stays.
    """
    return _grouped(docs, id_col, text_col)[0]


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal texts, all columns kept.

    The ids to drop are few beside the corpus: the join that removes them moves
    the rows only where they are too many to broadcast.  Of rows that repeat
    both id and text, null ids included, one stays, the first by a hash of its
    columns; only such repeats are shuffled, by a partial aggregate.
    """
    groups, again = _grouped(docs, id_col, text_col)
    mark = F.unhex(F.sha2(folded(F.col(text_col).cast("string")).cast("binary"), 256))
    same = F.col(id_col).eqNullSafe(F.col("__gone")) & (mark == F.col("__gone_digest"))
    named = [F.col("id").alias("__gone"), F.col("digest").alias("__gone_digest")]
    left = docs.join(groups.filter(~F.col("kept")).select(*named), same, "left_anti")
    if again.isEmpty():
        return left
    repeats = again.select(*named)
    order = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = left.join(repeats, same, "left_semi").groupBy(F.col(id_col).alias("__id"), mark.alias("__mark")).agg(
        F.min_by(row, order).alias("__row")).select("__row.*")
    return left.join(repeats, same, "left_anti").unionByName(one)
