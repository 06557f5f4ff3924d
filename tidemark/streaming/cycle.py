"""The collection cycle as a streaming query, and the latest-snapshot table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.bucketed import BUCKETS, BucketTable
from tidemark.operators.aggregates import latest_snapshot
from tidemark.shared import checkpoint_root, scratch, stored
from tidemark.streaming.derive import STATE_STORE

# Fixed value: the shipped collection period.
CYCLE = "20 seconds"


def start(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    name: str,
    period: str | None = CYCLE,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Run the cycle: every `period` (once over what is there, when None) feed `sink`.

    `sink(batch, batch_id)` gets each micro-batch; after a failure the same
    batch id comes again, so sinks overwrite by batch id.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # State with a time to live asks for empty batches for ever; without them a
    # run over what is there can end. Expired state is dropped with the next data.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    writer = (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", f"{checkpoint_root(spark, checkpoint)}/cycle/{name}")
        .outputMode("append")
        .foreachBatch(sink)
    )
    trigger = writer.trigger(availableNow=True) if period is None else writer.trigger(processingTime=period)
    return trigger.start()


def table_sink(path: str, partition_by: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """Sink that writes each micro-batch under its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={batch_id}")

    return write


def latest_sink(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the newest scrape of every host as a table, dealt into buckets by host.

    A micro-batch rewrites the buckets of its hosts only and then commits its version; a
    repeated one starts from the version before it and replaces its own.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            BucketTable(spark, path, ["host"], buckets).fold(batch_id, stored(batch, "latest"), _newest)

    return fold


def _newest(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    return latest_snapshot(batch if known is None else known.unionByName(batch, allowMissingColumns=True))


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest-snapshot table, or None before its first version."""
    return BucketTable(spark, path, ["host"]).read(before)


def maintain_latest(
    stream: DataFrame, path: str, name: str = "latest", period: str | None = CYCLE, checkpoint: str | None = None
) -> StreamingQuery:
    """Keep the latest snapshot of every host as a table."""
    return start(stream, latest_sink(path), name, period, checkpoint)


def newest_per_host(stream: DataFrame) -> DataFrame:
    """Newest scrape of every host as a streaming aggregate (output mode `update`)."""
    return stream.groupBy("host").agg(F.max(F.struct("ts_s", "scrape_id")).alias("newest")).select(
        "host", "newest.ts_s", "newest.scrape_id"
    )
