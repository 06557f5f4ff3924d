"""Approximate nearest neighbours by inner product, over randomly rotated one-bit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import onebit
from tidemark.llm.shared import kept_table

BITS = 4
DEVIATIONS = 3.0


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, vec: Column) -> DataFrame:
    """Stored rows (row, id, label, dims, vec) that have an id and a vector of finite numbers only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), F.col(vector_col).alias("_raw"))
    whole = F.forall("_raw", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where("id is not null and size(_raw) > 0").where(whole)
    rows = rows.select("id", "label", F.size("_raw").alias("dims"), vec.alias("vec"))
    return kept_table(rows.withColumn("row", F.monotonically_increasing_id()))


def nearest(vectors: DataFrame, asks: Column, k: int = 20, deviations: float = DEVIATIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` rows of the largest inner product found for each row that `asks` (over `id_col`) marks.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision on
    the vectors themselves, nearest first, ties to the smaller id.

    Every row is coded in one bit a number (`onebit.coded`) around the nearest of a few
    centres, which are fitted to a sample of about `onebit.SAMPLE` rows. Bit counts
    against the quantised question and stored scalars estimate the inner product; rows whose estimate
    plus `deviations` times its error stays below the k-th best are passed over, others
    are scored. All rows are estimated, none is sampled.

    Rows without an id, and vectors that are null, empty, zero or hold nulls or non-finite
    numbers take no part. Vectors meet only those of their own length. A row that repeats an
    id is a row of its own: another's neighbour, and a question too where its id is one. Pairs
    whose inner product overflows to an undefined value are left out. An empty table gives
    no rows; other columns are ignored.
    """
    numbers = F.col("_raw")
    rows = usable_rows(vectors, id_col, vector_col, F.lit(None), numbers)
    rows = rows.where(F.exists("vec", lambda x: x != 0))
    sent = rows.sparkSession.sparkContext.broadcast(onebit.fitted_centres(rows, rows.count()))
    codes = kept_table(onebit.with_codes(rows, sent))
    asked = rows.withColumn(id_col, F.col("id")).where(asks).select(
        "row", "label", "dims", "vec", F.array(F.lit(float("inf"))).alias("tops"), F.array(F.lit(float("-inf"))).alias("floors")
    )
    found = onebit.best_in_windows(codes, asked, sent, k, BITS, onebit.likely(deviations))
    best = onebit.first_per(found, ["ask"], k)
    named = rows.select(F.col("row").alias("ask"), F.col("id").alias("query_id"))
    return best.join(named, "ask").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
