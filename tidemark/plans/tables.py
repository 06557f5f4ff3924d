"""The driving tables read as telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import int_text
from tidemark.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(df: DataFrame, col: str) -> Column:
    """Epoch seconds of a timestamp column, zoned or not (UTC)."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        c = c.cast("timestamp")
    return F.unix_seconds(c)


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as samples: host = user, metric = event type, label k from props."""
    ev = table(spark, sf_dir, "events")
    label = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    return ev.select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"),
        F.col("event_id").cast("string").alias("scrape_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("name"),
        epoch_seconds(ev, "ts").alias("ts_s"),
        F.col("value"),
        F.col("value").cast("string").alias("value_raw"),
        F.lit("float").alias("value_kind"),
        F.lit("gauge").alias("check_type"),
        F.lit(None).cast("string").alias("chart_type"),
        F.lit(0).alias("reaction"),
        F.create_map(F.lit("k"), label).alias("tags"),
    )


def event_counters(spark: SparkSession, sf_dir: str, tick_s: int = 1) -> DataFrame:
    """`events` as counters: `total` grows with the event id, falls back where the
    label is below 5 and is unreadable text (`n/a`) where the label is 7.

    `tick_s` coarsens time so that rows of one series share a second.
    """
    ev = table(spark, sf_dir, "events")
    label = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    grown = F.col("event_id") * 1000 + cents("value")
    raw = (
        F.when(label == 7, "n/a").when(label < 5, cents("value").cast("string")).otherwise(grown.cast("string"))
    )
    ts = F.floor(epoch_seconds(ev, "ts") / tick_s) * tick_s
    return ev.select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"),
        F.col("event_type").alias("name"),
        ts.alias("ts_s"),
        F.col("event_id").alias("seq"),
        raw.alias("value_raw"),
    ).withColumn("total", int_text(F.col("value_raw")))
