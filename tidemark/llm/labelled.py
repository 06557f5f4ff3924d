"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About `most` labelled rows at most: doc_id, text, label, and a hash `pick` from 0 to 99.

    An id that several rows have gives one of them, the one whose text has the smallest hash.

    The sample is drawn from the label table by a hash of the id, so its size is known
    before any text is read, and the sampled labels are broadcast (16 bytes a row). An id
    with several labels counts as 1 if any of them is. `usable` is over `doc_id`.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = most / max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)) if share < 1 else known
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pick = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(100)).cast("int")
    found = rows.join(F.broadcast(drawn), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_one"), F.first("label").alias("label"))
    return one.select("doc_id", F.col("_one.text").alias("text"), "label", pick.alias("pick"))
