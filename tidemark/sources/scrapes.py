"""Reading landed payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import RAW_SCRAPES


def _select(df: DataFrame, sources: Sequence[str] | None, since: int | None, until: int | None) -> DataFrame:
    if sources:
        df = df.filter(F.col("source").isin(*sources))
    if since is not None:
        df = df.filter(F.col("ts_s") >= since)
    if until is not None:
        df = df.filter(F.col("ts_s") < until)
    return df


def read_scrapes(
    spark: SparkSession,
    path: str,
    sources: Sequence[str] | None = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Raw scrapes by source and time range; both filters reach the scan.

    Laid out by `write_scrapes`, the table is pruned to the wanted sources and days.
    """
    df = spark.read.parquet(path)
    if "day" in df.columns:
        if since is not None:
            df = df.filter(F.col("day") >= since // 86_400)
        if until is not None:
            df = df.filter(F.col("day") <= until // 86_400)
    return _select(df, sources, since, until)


def stream_scrapes(
    spark: SparkSession,
    path: str,
    sources: Sequence[str] | None = None,
    max_files: int | None = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Landed scrape files as a stream, of some sources and a time range; both filters reach the scan."""
    reader = spark.readStream.schema(RAW_SCRAPES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _select(reader.parquet(path), sources, since, until)


def write_scrapes(df: DataFrame, path: str, mode: str = "append") -> None:
    """Land scrapes partitioned by source and day."""
    day = F.floor(F.col("ts_s") / 86_400)
    df.withColumn("day", day).write.mode(mode).partitionBy("source", "day").parquet(path)
