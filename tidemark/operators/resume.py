"""State of series that one run leaves and the next one starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.bucketed import BUCKETS, BucketTable

STATE_KEYS = ("_hash", "_series")


def _latest(known: DataFrame | None, fresh: DataFrame) -> DataFrame:
    rows = fresh if known is None else known.unionByName(fresh)
    return rows.groupBy(*STATE_KEYS).agg(F.max("_state").alias("_state"))


class SeriesState:
    """The latest accepted row of every series, saved per run below `path`.

    Hand one object to one derivation (`counter_rate(..., resume=state)` and so on) and call
    `commit` once its rows are written. Run number `version` starts from what the newest run
    before it left; a run that is repeated starts from the same state and replaces what it left.
    A derivation of several steps keeps a table per step. Only the buckets of
    series that a run saw are rewritten.

    A row that is older than its series' state gets NULL, or is left out where the derivation
    is a gate, and leaves the state alone.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, buckets: int = BUCKETS):
        self.spark, self.path, self.version, self.buckets = spark, path, version, buckets
        self._ends: list[DataFrame] = []

    def _table(self, step: int) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/step-{step}", STATE_KEYS, self.buckets)

    def step(self, ends: DataFrame) -> DataFrame | None:
        """Note what the next step of the derivation leaves; its states to start from, if any."""
        self._ends.append(ends)
        return self._table(len(self._ends) - 1).read(before=self.version)

    def left(self, step: int = 0) -> DataFrame | None:
        """What the newest run up to this one left for a step: one row per series."""
        return self._table(step).read(before=self.version + 1)

    def commit(self) -> None:
        for step, ends in enumerate(self._ends):
            self._table(step).fold(self.version, ends, _latest)
