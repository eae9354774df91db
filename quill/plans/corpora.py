"""End-to-end preparation jobs: raw corpus -> labelled ``(text, label)`` splits.

Three shapes of preparation, each a chain of library operators ending in one
write per split (``split=train|val|test`` folders, CSV at the edge or Parquet):

* frequency-filtered corpus: positional scan prefix, keep labels seen more
  than ``min_count`` times, project, nested test/val split;
* dictionary-coded corpus: exact-fraction sample, recode labels through a
  dictionary, two-way split; the test part is sampled from its own table;
* stratified corpus: per-stratum prefixes whose sizes are proportional
  allocations of a target per split, stratum names as labels.

Each returns a small DataFrame of counts (the figures a script would print).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.operators import prepare as P
from quill.sources import io


def _write(df: DataFrame, out: str, fmt: str, shards: int | None) -> None:
    io.write_splits(df.select("split", "text", "label"), out, fmt=fmt, shards=shards)


def prepare_frequent(corpus: DataFrame, text: str, label: str, order: str, out: str, min_count: int,
                     test_size: float, val_size: float, seed, scan_rows: int | None = None,
                     scan_frac: float | None = None, fmt: str = "csv", shards: int | None = None) -> DataFrame:
    """Scan prefix -> labels with more than ``min_count`` rows -> ``(text, label)``
    -> test, then val from the rest -> write.  Returns ``(stage, n_rows, n_labels)``."""
    df = corpus.select(order, F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    if scan_rows is not None or scan_frac is not None:
        df = P.prefix(df, scan_rows, [order], frac=scan_frac)
    kept = P.filter_frequent(df, "label", min_count)
    split = P.split_three_way(kept, test_size, val_size, seed, order)
    split = split.withColumn("split", F.when(F.col("split") == "validation", "val").otherwise(F.col("split")))
    _write(split, out, fmt, shards)
    return P.table_stats(df, "label", "scanned").unionByName(P.table_stats(kept, "label", "kept"))


def prepare_coded(train: DataFrame, test: DataFrame, text: str, label: str, id_col: str, mapping: Mapping,
                  out: str, train_frac: float, val_size: float, test_frac: float, seed,
                  fmt: str = "csv", shards: int | None = None) -> DataFrame:
    """Exact-fraction samples of both tables, labels recoded through
    ``mapping`` (an unknown code is an error), the train sample split into
    train/val.  Returns ``(split, n)``."""
    def coded(df: DataFrame, frac: float, s) -> DataFrame:
        x = df.select(id_col, F.col(text).alias("text"), F.col(label).alias("label"))
        return P.recode(P.sample_exact(x, frac, s, id_col), "label", mapping)

    tr = P.split_exact(coded(train, train_frac, seed), val_size, int(seed) + 1, id_col, test="val")
    te = coded(test, test_frac, int(seed) + 2).withColumn("split", F.lit("test"))
    allrows = tr.unionByName(te)
    _write(allrows, out, fmt, shards)
    return allrows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def prepare_strata(corpus: DataFrame, text: str, code: str, split: str, order: str, names: Mapping[str, str],
                   targets: Mapping[str, int], out: str, fmt: str = "csv", shards: int | None = None) -> DataFrame:
    """For every split, each stratum (code) keeps its first
    ``round(n_code * target / n_split)`` rows in ``order``; the label is the
    stratum's name.  Sizes come from the data.  Returns ``(split, label, n)``."""
    df = P.stratum_labels(corpus.select(order, split, code, F.col(text).alias("text")), code, names)
    df = df.where(F.col(split).isin(*targets.keys())).withColumnRenamed(split, "split")
    quotas = None
    for sp, total in targets.items():
        counts = P.value_counts(df.where(F.col("split") == sp).select("label"), "label")
        q = P.allocate(counts, total).select(F.lit(sp).alias("split"), "label", "quota")
        quotas = q if quotas is None else quotas.unionByName(q)
    kept = P.take_per_group(df, ["split", "label"], quotas, [order])
    _write(kept, out, fmt, shards)
    return kept.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
