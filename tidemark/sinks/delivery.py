"""Delivery outcomes of encoded batches, and replay of the cached ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import rank_in_order

# Response codes.
DONE_CODES = (
    100, 101, 102, 200, 201, 202, 203, 204, 205, 206, 207, 208, 226,
    300, 301, 302, 303, 304, 305, 306, 307, 308,
)
REFUSED_CODES = (402, 406, 411, 415, 424)
MAX_CACHE = 50_000


def route_outcomes(
    batches: DataFrame,
    outcomes: DataFrame,
    max_cache: int = MAX_CACHE,
    keys: Sequence[str] = (),
    cached_before: int | DataFrame = 0,
) -> DataFrame:
    """Batches with a `route`: done, refused (logged and dropped), cached or overflow.

    Other codes and transport errors (NULL code, or no outcome at all) are
    cached for retry in `seq` order, per `keys` (the sending host). A batch is
    still cached while at most `max_cache` are; later ones overflow. `cached_before` is what the
    cache holds already: one number for all, or a frame of `keys` and `cached`. Rows that repeat
    a batch id are one batch and share a rank.
    """
    joined = batches.join(outcomes, "batch_id", "left")
    code = F.col("code")
    route = F.when(code.isin(*DONE_CODES), "done").when(code.isin(*REFUSED_CODES), "refused").otherwise("retry")
    routed = joined.withColumn("route", route)
    # Only what has to be retried is ranked, and only by its id: bodies are not sorted.
    retries = routed.filter(F.col("route") == "retry").select("batch_id", "seq", *[k for k in keys if k not in ("batch_id", "seq")])
    ranked = rank_in_order(retries, keys, "seq", "_rank").groupBy("batch_id").agg(F.min("_rank").alias("_rank"))
    routed = routed.join(ranked, "batch_id", "left")
    if isinstance(cached_before, DataFrame):
        held = cached_before.select(*[F.col(k).alias(f"_held_{k}") for k in keys], F.col("cached").alias("_held"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys])
        routed = routed.join(held, same, "left").drop(*[f"_held_{k}" for k in keys])
    else:
        routed = routed.withColumn("_held", F.lit(cached_before))
    fits = F.col("_rank") + F.coalesce("_held", F.lit(0)) <= max_cache + 1
    kept = F.when(F.col("route") != "retry", F.col("route")).when(fits, "cached").otherwise("overflow")
    return routed.withColumn("route", kept).drop("_rank", "_held")


def write_routes(routed: DataFrame, path: str, mode: str = "append") -> None:
    """The three outputs as one table partitioned by route."""
    routed.write.mode(mode).partitionBy("route").parquet(path)


def replay_plan(
    dead_letter: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Cached batches with `replayed`: true before the first failure in order, per `keys`.

    A batch without an outcome counts as a failure: the walk stopped before it.
    """
    walked = dead_letter.join(outcomes, "batch_id", "left")
    failed = ~F.coalesce(F.col("code").isin(*DONE_CODES), F.lit(False))
    if keys:
        stop = walked.groupBy(*keys).agg(F.min(F.when(failed, F.col("seq"))).alias("_stop"))
        walked = walked.join(stop, list(keys), "left")
    else:
        stop = walked.agg(F.min(F.when(failed, F.col("seq"))).alias("_stop"))
        walked = walked.withColumn("_stop", stop.scalar())
    done = F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))
    return walked.withColumn("replayed", done).drop("_stop")
