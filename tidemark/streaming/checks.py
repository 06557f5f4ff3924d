"""Checks on a stream: extraction, derivation through saved state, and what is done with the samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.bucketed import BUCKETS
from tidemark.checks.registry import Check, events_of, open_for, run_opened, samples_of
from tidemark.operators.resume import SeriesState
from tidemark.shared import scratch
from tidemark.streaming import cycle

Sink = Callable[[DataFrame, int], None]


def checks_sink(checks: Iterable[Check], path: str, recipes: DataFrame | None = None, then: Sink | None = None,
                thresholds: DataFrame | None = None, ranges: int | None = None, buckets: int = BUCKETS, first: int = 0) -> Sink:
    """Sink that runs the checks over each micro-batch of raw scrapes.

    The payloads of the micro-batch are read and opened once, the samples that the checks find
    there are stored, and counters go on from the
    state that the micro-batch before left in `path/state`: one row per series, of which
    only touched buckets are replaced. Derived rows are written to `path/rows`, a
    folder per micro-batch; as read back from there, samples are handed to `then` (encoding, delivery),
    and with `thresholds` the health events of the checks are written to `path/events`. What
    could not be used goes to `path/rejects` in the same way.

    `first` is the number of the first micro-batch. Called by hand, the sink is a batch run that keeps
    its state (`checks_sink(checks, path)(raw, 0)`); a stream with `first=1` on the same path goes on from it.

    The order makes a repeated micro-batch harmless: samples first, then `then`, the state's
    version last. One that failed in between starts from the same state and writes the same
    rows over its own; `then` gets the same rows under the same number again.
    """
    wanted = list(checks)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, first + batch_id
        with scratch(spark):
            opened = open_for(batch, wanted)
            opened.rejects.write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
            states: dict[str, SeriesState] = {}

            def resume(name: str) -> SeriesState:
                states[name] = SeriesState(spark, f"{path}/state/{name}", number, buckets)
                return states[name]

            out = f"{path}/rows/batch={number}"
            derived = run_opened(opened, wanted, recipes, None, ranges, resume)
            derived.write.mode("overwrite").parquet(out)
            rows = spark.read.schema(derived.schema).parquet(out)
            if thresholds is not None:
                events_of(rows, wanted, thresholds).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
            if then:
                then(samples_of(rows), number)
            for state in states.values():
                state.commit()

    return run


def run_checks_on(stream: DataFrame, checks: Iterable[Check], path: str, name: str = "checks", recipes: DataFrame | None = None,
                  then: Sink | None = None, thresholds: DataFrame | None = None, period: str | None = cycle.CYCLE,
                  checkpoint: str | None = None, first: int = 0) -> StreamingQuery:
    """The collection cycle over a stream of raw scrapes; see `checks_sink` for what lands below `path`."""
    return cycle.start(stream, checks_sink(checks, path, recipes, then, thresholds, first=first), name, period, checkpoint)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """All samples so far."""
    return samples_of(spark.read.parquet(f"{path}/rows"))
