"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.session import scratch_path

#: The letters that ASCII lower-casing maps, in order.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read of the shared files,
    never a re-run of what made them, and every later reader sees one version
    of the rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folded(text: Column) -> Column:
    """Text with A-Z (only) in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text, the split rule of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def clear_of(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with every column whose name is in ``names`` renamed: ``_in`` is appended until the name is free."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c + "_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def between(text: str | None, gap: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """A whole text in pieces of about ``size`` characters that end where ``gap`` matches, never within a word."""
    at, text = 0, text or ""
    while at < len(text):
        found = gap.search(text, min(at + size, len(text)))
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
