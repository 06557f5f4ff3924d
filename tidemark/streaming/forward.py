"""Store and forward: delivery per micro-batch with a backlog that outlives it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.bucketed import BUCKETS, BucketTable
from tidemark.shared import scratch, stored
from tidemark.sinks.delivery import MAX_CACHE, replay_plan, route_outcomes
from tidemark.streaming.cycle import table_sink

Deliver = Callable[[DataFrame, int], DataFrame]


def _backlog(spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> BucketTable:
    return BucketTable(spark, f"{path}/backlog", keys, buckets)


def forward_sink(deliver: Deliver, path: str, keys: Sequence[str] = ("host",), max_cache: int = MAX_CACHE,
                 buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Sink that delivers each micro-batch of encoded batches, and the backlog before it.

    `deliver(batches, batch_id)` sends batches and returns their outcomes (batch_id,
    code; no row or a NULL code is a transport error). Batches have `keys`, batch_id, seq and
    any other columns. First the backlog is replayed in `seq` order per key up to
    the first failure, then the new batches are routed by their outcomes: what has to be retried joins
    the backlog while no more than `max_cache` batches of its key are there, and overflows
    beyond. The routes go to `path/routes`, a folder per micro-batch: done, refused, cached,
    overflow, and replayed for backlog that got through.

    The backlog in `path/backlog` is dealt into buckets by key, of which only those with new or
    replayed batches are rewritten. A repeated micro-batch starts from the backlog before
    it, so its batches are sent again but neither lost nor cached twice.
    """
    write = table_sink(f"{path}/routes")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = _backlog(spark, path, keys, buckets)
        with scratch(spark):
            fresh = stored(batch, "fresh")
            held = table.read(before=batch_id)
            replayed = None
            if held is not None:
                sent = stored(deliver(held, batch_id).select("batch_id", "code"), "replies")
                plan = stored(replay_plan(held, sent, keys), "replay")
                replayed = plan.filter("replayed").withColumn("route", F.lit("replayed")).drop("replayed")
                kept = plan.filter(~F.col("replayed")).drop("replayed", "code")
                counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("cached"))
            sent = stored(deliver(fresh, batch_id).select("batch_id", "code"), "outcomes")
            routed = stored(route_outcomes(fresh, sent, max_cache, keys, 0 if held is None else counts), "routed")
            write(routed if replayed is None else routed.unionByName(replayed), batch_id)

            # What the backlog gains, and markers for what it loses.
            gains = routed.filter(F.col("route") == "cached").select(*fresh.columns, F.lit(False).alias("_gone"))
            changes = gains if replayed is None else gains.unionByName(replayed.select(*fresh.columns, F.lit(True).alias("_gone")))
            table.fold(batch_id, stored(changes, "changes"), _changed)

    return run


def _changed(known: DataFrame | None, changes: DataFrame) -> DataFrame:
    gained = changes.filter(~F.col("_gone")).drop("_gone")
    if known is None:
        return gained
    gone = changes.filter("_gone").select("batch_id")
    return known.join(gone, "batch_id", "left_anti").unionByName(gained)


def read_backlog(spark: SparkSession, path: str, keys: Sequence[str] = ("host",)) -> DataFrame | None:
    """Batches that wait for the next micro-batch."""
    return _backlog(spark, path, keys, BUCKETS).read()
