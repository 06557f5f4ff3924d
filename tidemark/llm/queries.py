"""The registered queries of the operators, over the driving tables."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    audit, decontam, html, labelled, lattice, lines, minhash, multiindex, negatives, neighbours, packing, quality, sharding, toxicity,
)


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers started from here on also look for the package in this checkout."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    return public_tokenizers.path(name)


def fold(divisor: int, out: int) -> Column:
    """Whether a row's id is in the held-out fold; rows without an id are."""
    return F.coalesce(labelled.remainder("doc_id", divisor) == out, F.lit(True))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def _judged(scores: DataFrame, divisor: int, out: int) -> DataFrame:
    return scores.select(
        "doc_id", fold(divisor, out).alias("held_out"), F.col("score").cast("double").alias("score"),
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold(4, 2))
    return _judged(toxicity.scored(docs, model), 4, 2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~fold(5, 0))
    return _judged(quality.scored(docs, net), 5, 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1024)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_lines(table(spark, sf_dir, "documents"), min_chars=1).drop("_t")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), fold(7, 2))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), sharding.regular(8), sharding.regular(9))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_embedding_near_dedup, op3_toxicity, op4_decontamination, op5_quality, op6_packing, op7_minhash_near_dedup,
        op8_line_dedup, op9_lm_scoring, op10_sharding, op11_hard_negatives, op12_nearest_neighbours, op13_filter_audit, pipeline,
    )
}

# The others are not expressible in DuckDB SQL at the size of the tables: no CRC-32, HTML,
# tokenizers or training there, and all pairs of lines or documents are out of reach.
ORACLE: dict[str, str] = {
    "op11_hard_negatives": """
        WITH whole AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM whole a JOIN whole b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0
        ), positives AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
            n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
    """,
    "op12_nearest_neighbours": """
        WITH whole AS (
            SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
            SELECT a.id AS query_id, b.id AS vec_id, list_inner_product(a.v, b.v) AS score
            FROM whole a JOIN whole b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
    "op13_filter_audit": r"""
        WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
            FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
                JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
        ), rows AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), failing AS (
            SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
            FROM rows
        ), known AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), reduced AS (
            SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM failing LEFT JOIN known USING (doc_id) GROUP BY part, fails
        ), steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
            FROM orders CROSS JOIN generate_series(1, 5) AS s(step)
        ), placed AS (
            SELECT *, contains(fails, f) AS here, length(translate(fails, before, '')) < length(fails) AS earlier FROM reduced CROSS JOIN steps
        )
        SELECT part, filter_order, step,
            CAST(sum(CASE WHEN here OR earlier THEN 0 ELSE n END) AS BIGINT) AS kept,
            CAST(sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
            CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
            CAST(sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
            CAST(sum(sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM placed GROUP BY part, filter_order, step, f
    """,
}
