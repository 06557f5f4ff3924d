"""Hard negatives over randomly rotated one-bit codes with certain intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import onebit
from tidemark.llm.neighbours import usable_rows
from tidemark.llm.shared import kept_table

BITS = 6
SCALE = 256.0
MOST = 2**63 - 1
LARGEST = 1e100


def _floored(x: Column) -> Column:
    """floor(256 * x) as a double; doubles from 2^53 on are integers already."""
    v = F.greatest(F.least(x.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5,
                   id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels below the positive.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Scores are inner products of the vectors' numbers as floor(256 * x), exact
    integers. `anchors` marks rows by `id_col`; `label` is the label to use. An anchor's
    positives are its first `positives` other rows of the same label; a negative's score
    is at most the positive's and at least four fifths of it. Higher scores come first, ties by
    the smaller id.

    Both searches run over codes of one bit a number (`onebit.coded`): the bit count and
    the stored inner product of a vector with its code give an interval that always holds the
    score, and only rows whose interval reaches into a window are scored. Nothing
    is approximate in the result. The centres of the codes are fitted to a sample.

    Rows without an id or label, and vectors that are null, empty or hold nulls or
    non-finite numbers take no part; zero vectors do. Vectors meet only those of
    their own length. Rows that repeat an id are rows of their own. Positives with a score below zero have
    no negatives. Scores that a 64-bit integer cannot hold become the nearest
    one that it can, numbers beyond 1e100 count as that.
    An empty table gives no rows; other columns are ignored.
    """
    whole = F.transform("_raw", _floored)
    rows = usable_rows(vectors, id_col, vector_col, label, whole).where("label is not null")
    sent = rows.sparkSession.sparkContext.broadcast(onebit.fitted_centres(rows, rows.count()))
    codes = kept_table(onebit.with_codes(rows, sent))
    asked = rows.withColumn(id_col, F.col("id")).where(anchors).select("row", "label", "dims", "vec", F.col("id").alias("anchor_id"))

    spans = [F.array(F.lit(MOST)).alias("tops"), F.array(F.lit(-MOST - 1)).alias("floors")]
    found = onebit.best_in_windows(codes, asked.select("row", "label", "dims", "vec", *spans), sent, positives, BITS, onebit.certain, "same", True, ("dims", "label"))
    chosen = kept_table(onebit.first_per(found, ["ask"], positives).select("ask", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # An unused window has its floor above its top.
    span = F.struct(F.col("positive_score").alias("top"), F.ceil(F.col("positive_score").cast("decimal(38,0)") * 4 / 5).cast("long").alias("floor"))
    held = chosen.where("positive_score >= 0").groupBy("ask").agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    filled = F.concat("_spans", F.array_repeat(F.struct(F.lit(-1).cast("long").alias("top"), F.lit(0).cast("long").alias("floor")), F.lit(positives) - F.size("_spans")))
    ranged = asked.join(held, asked["row"] == held["ask"]).withColumn("_spans", filled)
    asks = ranged.select("row", "label", "dims", "vec", F.col("_spans.top").alias("tops"), F.col("_spans.floor").alias("floors"))
    near = onebit.best_in_windows(codes, asks, sent, negatives, BITS, onebit.certain, "other", True)

    pairs = chosen.where("positive_score >= 0").join(near, "ask")
    wide = [F.col(c).cast("decimal(38,0)") for c in ("positive_score", "score")]
    pairs = pairs.where((wide[0] * 80 <= wide[1] * 100) & (wide[1] <= wide[0])).withColumnRenamed("rank", "_which")
    best = onebit.first_per(pairs, ["ask", "_which"], negatives)
    named = asked.select(F.col("row").alias("ask"), "anchor_id")
    return best.join(named, "ask").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
