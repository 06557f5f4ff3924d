"""A corpus pipeline of the training-data operators: filter, deduplicate, decontaminate, pack.

Every stage takes all that the one before kept; all but the last return the columns of
`documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, lines, minhash, packing, queries, toxicity
from tidemark.llm.shared import kept_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.3 or more go."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"), ~queries.fold(4, 2), 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines of a class go, and documents of which nothing else is left."""
    return lines.without_repeats(docs, min_chars=1)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more."""
    return minhash.one_of_each(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a test item's five-word shingles go."""
    return decontam.without_items(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: a row per piece of a document."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

# Training, CRC-32 and tokenizers have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
