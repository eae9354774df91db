"""A corpus pipeline of five stages: language, exact copies, near copies, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept; all but the last return the columns of ``documents``.  ``run``
writes each stage's result to the shared folder and reads it back as the next
stage's input.

A document that the mixture takes more than once is in its result as often, and
every such row is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quill.llm import exact_dedup, langid, minhash, mixing, packing
from quill.llm.common import read, written
from quill.llm.queries import TARGETS, domains

#: Similarity of five-word shingle sets from which two documents are near copies, as a fraction.
SIMILARITY = (80, 100)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.known(docs, langid.fit(langid.training_rows(docs)))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 and more connect."""
    return minhash.drop_near_copies(docs, threshold=SIMILARITY).select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate for the target weights of the quality domains says."""
    return mixing.mixed(docs, domains(read(spark, sf_dir, "labels")), TARGETS).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_exact_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", to_target_weights),
    ("best-fit packing", packed),
]

#: SQL has neither the language model nor the hashed classifier; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
