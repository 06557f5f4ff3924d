"""Hosts that fall silent on a stream, and their return."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels to the executors with the query, no installation needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Module and levels of the alive events.
MODULE, OK, ERROR = "HeartBeat", 0, 16
EVENTS = "host string, module string, ts_s bigint, value int, status string, message string, reaction int"


class Silence(StatefulProcessor):
    """One host: its last time, whether it is known to be silent, and a timer that fires without input."""

    def __init__(self, limit_s: int):
        self.limit_s = limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts BIGINT, silent BOOLEAN")

    def _events(self, host: str | None, ts: np.ndarray, alarm: np.ndarray) -> pd.DataFrame:
        message = np.where(alarm, f"ERROR: no HeartBeats for {self.limit_s} seconds", "OK: HeartBeats are back")
        return pd.DataFrame({
            "host": pd.Series([host] * len(ts), dtype="object"), "module": MODULE, "ts_s": ts, "value": np.where(alarm, ERROR, OK).astype("int32"),
            "status": np.where(alarm, "ERROR", "OK"), "message": message, "reaction": np.zeros(len(ts), "int32"),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([part["tm_ts"].to_numpy(np.int64) for part in rows]))
        last, silent = self.seen.get() if self.seen.exists() else (int(times[0]), False)
        times = np.concatenate([[last], times[times > last]])
        gaps = np.flatnonzero(np.diff(times) > self.limit_s)
        # The first gap may have been told by the timer; its end is told in any case.
        told = bool(silent) and len(gaps) > 0 and gaps[0] == 0
        begins = gaps[1:] if told else gaps
        ts = np.concatenate([times[begins] + self.limit_s, times[gaps + 1]])
        alarm = np.concatenate([np.ones(len(begins), bool), np.zeros(len(gaps), bool)])
        newest = int(times[-1])
        if newest > last or not self.seen.exists():
            self.seen.update((newest, False))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((newest + self.limit_s) * 1000)
        order = np.lexsort((alarm, ts))
        yield self._events(key[0], ts[order], alarm[order])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.seen.get()
        if not silent:
            self.seen.update((last, True))
            yield self._events(key[0], np.array([last + self.limit_s]), np.array([True]))

    def close(self) -> None:
        pass


def silence_events(stream: DataFrame, limit_s: int, ts: str = "ts_s", delay: str = "0 seconds") -> DataFrame:
    """Health events of hosts without a row for more than `limit_s` seconds, and of their return.

    Within the rows of a host every gap is found when it ends; a host that stays away is told by a timer
    once the newest time of the stream (less `delay`) has passed its last time by the limit, with no row of
    its own needed. Spark drops rows later than the watermark. Rows without a host or time are left out.
    """
    rows = stream.filter(F.col("host").isNotNull() & F.col(ts).isNotNull())
    rows = rows.select("host", F.col(ts).cast("bigint").alias("tm_ts"), F.timestamp_seconds(F.col(ts)).alias("tm_time"))
    return rows.withWatermark("tm_time", delay).groupBy("host").transformWithStateInPandas(
        statefulProcessor=Silence(limit_s), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime",
    )
