"""Queries of the subpackage: one ``opN_<name>`` each, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import (
    ann, chat, exact_dedup, html, langid, minhash, mixing, negatives, packing, quality, sharding, spelling, toxicity,
)
from quill.llm.common import read


#: Target weights of the quality domains in tokens.
TARGETS = {"clean": 0.85, "low": 0.05, "toxic": 0.10}


def domains(labels: DataFrame) -> DataFrame:
    """``(id, domain)`` of the labelled documents: low quality, else toxic, else clean."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "low").when(
        (F.col("quality") == 1) & (F.col("toxic") == 1), "toxic").when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), "clean").alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document, for the target weights."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = mixing.rates(docs, domains(labels), TARGETS)
    return found.select(F.col("id").alias("doc_id"), "tokens", "domains", "posterior", "wanted", "reached", "rate",
                        mixing.copies(F.col("rate"), F.col("id")).alias("copies"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"),
                        "lang_pred", "score", "mixture")


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Every piece of every document in its sequence of at most 2,048 tokens."""
    import public_tokenizers

    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
    return packed.withColumnRenamed("id", "doc_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, with its repaired role and its rendered piece."""
    return chat.formatted(read(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~F.coalesce(quality.held_out(), F.lit(True))))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(read(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of near-equal shingle sets."""
    found = minhash.near_groups(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its group of equal texts."""
    groups = exact_dedup.exact_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the two-pass shuffle writes every document: 16 shards under the law ``rows``."""
    placed = sharding.write_shards(read(spark, sf_dir, "documents"), 16)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id", sharding.record_size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.filter(~F.coalesce(toxicity.held_out(), F.lit(True))))
    return toxicity.score(docs, machine).select(
        F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector; every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(table, F.col("id") % 50 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the more frequent spelling it varies."""
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"))).select(
        "word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_langid": op2_langid,
    "op3_packing": op3_packing,
    "op4_ann": op4_ann,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_minhash": op8_minhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_shards": op10_shards,
    "op11_toxicity": op11_toxicity,
    "op12_negatives": op12_negatives,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op8_minhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                 lambda x: x <> '') AS words
          FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest(list_transform(
                 range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 4, 1) + 1 END),
                 lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
          FROM w
        ), n AS (
          SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
        ), shared AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
          FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), link AS (
          SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= 85 * (x.n + y.n - k)
        ), edge AS (
          SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
          SELECT doc_id AS a, doc_id AS b FROM n
          UNION
          SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
        )
        SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, min(reach.b) = n.doc_id AS kept
        FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
    "op9_exact_dedup": """
        WITH t AS (
          SELECT DISTINCT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM t
    """,
    "op12_negatives": """
        WITH t AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pair AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                 list_inner_product(a.v, b.v)::BIGINT AS score
          FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), positive AS (
          SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT p.anchor_id, p.positive_id,
               (row_number() OVER w)::INTEGER AS rank,
               n.other AS negative_id, p.positive_score, n.score AS negative_score
        FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)
        QUALIFY row_number() OVER w <= 3
    """,
}
