"""Stateful derivations on a stream: the counterparts of the batch window operators.

State is one small row per series in the RocksDB store, side by side with those of its group; it lives on unless a
time to live is given.
Rows arrive unordered inside a micro-batch, are sorted by series and derived as arrays, many series in a
call (`GROUPS`), the state coming in as the row before a series' first. A row not later than the last accepted one of its series
gets NULL and leaves the state alone.

A micro-batch bounds what one series, and the group it is in, can hold in memory: set
`maxFilesPerTrigger` (or `maxBytesPerTrigger`) on the source. Checkpoints of the form with a group per series
cannot be gone on with: `stream_state` of that form, read before, is the `start` of a new stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ValueState

from tidemark.operators.windows import series_struct
from tidemark.schema import SERIES
from tidemark.shared import checkpoint_root

# The processor travels to the executors with the query, no installation needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = (
    "tm_key ARRAY<STRING>, ts ARRAY<BIGINT>, seq ARRAY<BIGINT>, longs ARRAY<ARRAY<BIGINT>>, doubles ARRAY<ARRAY<DOUBLE>>, written ARRAY<BIGINT>"
)
# The series of a stream are dealt into this many groups, and a group is derived in one call: the cost of a call is that
# of many series. It is fixed for the life of a checkpoint.
GROUPS = 1024
STARTED = ("rate", "delta", "prev", "ratio")
GATED = ("share", "changed_rate")
KINDS = ("rate", "delta", "prev", "ratio", "share", "changed_rate")


def _two(x: np.ndarray) -> np.ndarray:
    """Two places, as fixed-point formatting rounds: only values close to a tie are formatted."""
    with np.errstate(all="ignore"):
        y = x * 100
        out = np.floor(y + 0.5) / 100
        near = (np.abs(y - np.floor(y) - 0.5) <= 1e-3) | ((np.abs(y) >= 1e12) & np.isfinite(y))
    for k in np.flatnonzero(near):
        out[k] = float(f"{x[k]:.2f}")
    return out + 0.0


def _rates(d: np.ndarray, dt: np.ndarray, reset: float) -> np.ndarray:
    """Integer differences over seconds; exact where a double could not hold them."""
    x = d.astype(float) / dt
    for k in np.flatnonzero(np.abs(d.astype(float)) >= 2.0**53):
        x[k] = int(d[k]) / int(dt[k])
    return np.where(d < 0, reset, _two(x))


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b, in Python integers where 64 bits might not do."""
    if a.dtype == np.int64 and len(a) and max(np.abs(a.astype(float)).max(), np.abs(b.astype(float)).max()) >= 2.0**62:
        return a.astype(object) - b.astype(object)
    return a - b


class _Runs:
    """Rows of several series, those of a series side by side and in order: runs by the number `of` their series."""

    def __init__(self, of: np.ndarray):
        self.of = of
        self.first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
        self.ends = np.flatnonzero(np.concatenate([of[1:] != of[:-1], [True]])[: len(of)])

    def before(self, v: np.ndarray, held: _Held, start: np.ndarray, none: float | None = None) -> np.ndarray:
        """Each row's predecessor in `v`; that of a first row from `start`, its series' state, or `none` (or the row itself) without one."""
        out = np.concatenate([v[:1], v[:-1]])
        at = np.flatnonzero(self.first)
        of = self.of[at]
        out[at] = np.where(held.known[of], start[of], v[at] if none is None else none)
        return out


class _Held:
    """What one state variable holds for the series of its group, side by side, and where `names` are among them."""

    def __init__(self, state: ValueState, names: Sequence[str], width: int, whole: bool, now: int = 0, ttl_ms: int | None = None):
        self.state, self.names, self.whole, self.now = state, np.asarray(names, object), whole, now
        stored, ts, seq, longs, doubles, written = state.get() or ([], [], [], [], [], [])
        self.all = np.asarray(stored, object)
        self.all_ts, self.all_seq, self.written = (np.asarray(x, np.int64) for x in (ts, seq, written))
        self.all_values = np.asarray(longs if whole else doubles, np.int64 if whole else float).reshape(len(stored), width)
        if ttl_ms is not None:
            self._take(self.written + ttl_ms > now)
        at = pd.Index(self.all).get_indexer(self.names) if len(self.all) else np.full(len(self.names), -1)
        self.known = at >= 0
        self.ts, self.seq = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        self.ts[self.known], self.seq[self.known] = self.all_ts[at[self.known]], self.all_seq[at[self.known]]
        self.values = np.zeros((width, len(at)), self.all_values.dtype)
        self.values[:, self.known] = self.all_values[at[self.known]].T
        self.at = at

    def _take(self, which: np.ndarray) -> None:
        self.all, self.all_ts, self.all_seq = self.all[which], self.all_ts[which], self.all_seq[which]
        self.all_values, self.written = self.all_values[which], self.written[which]

    def save(self, of: np.ndarray, ts: np.ndarray, seq: np.ndarray, values: np.ndarray) -> None:
        """One row each becomes the state of the series numbered `of`; the others of the group stay as they are."""
        untouched = np.ones(len(self.all), bool)
        untouched[self.at[of][self.known[of]]] = False
        self._take(untouched)
        held = np.concatenate([self.all_values, values.T.astype(self.all_values.dtype)]).tolist()
        none = [[]] * len(held)
        self.state.update((
            [*self.all, *self.names[of]], np.concatenate([self.all_ts, ts]).tolist(), np.concatenate([self.all_seq, seq]).tolist(),
            held if self.whole else none, none if self.whole else held, [*self.written.tolist(), *[self.now] * len(of)],
        ))

    def save_last(self, runs: _Runs, ts: np.ndarray, seq: np.ndarray | None, values: Sequence[np.ndarray]) -> None:
        """The last row of every run becomes its series' state."""
        if len(runs.ends):
            last = np.stack([v[runs.ends] for v in values])
            self.save(runs.of[runs.ends], ts[runs.ends], np.zeros(len(runs.ends), np.int64) if seq is None else seq[runs.ends], last)


class Derivation(StatefulProcessor):
    """One kind of derivation over rows with `tm_key`, `tm_ok`, `tm_ts`, `tm_seq`, `tm_v0`, `tm_v1`, ...

    A call gets the rows of many series, those of one group, and derives them side by side; the states of
    a group are read and written as one value of arrays. A time to live counts for each series.
    """

    def __init__(self, kind: str, width: int, outs: Sequence[str], reset: float, ttl_ms: int | None):
        self.kind, self.width, self.outs = kind, width, list(outs)
        self.reset, self.ttl_ms = reset, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, self.ttl_ms)
        self.passed = handle.getValueState("passed", _STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # A large group comes in several frames.
        values = np.array(initialState["longs" if self._whole else "doubles"].tolist(), np.int64 if self._whole else float)
        held = self._held(self.last, initialState["tm_key"], timerValues)
        held.save(np.arange(len(initialState)), initialState["ts"].to_numpy(np.int64), initialState["seq"].to_numpy(np.int64), values.T)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        of, names = pd.factorize(pdf["tm_key"])
        order = np.lexsort((pdf["tm_seq"].to_numpy(np.int64), pdf["tm_ts"].to_numpy(np.int64), of))
        pdf, of = pdf.take(order).reset_index(drop=True), of[order]
        ts, seq, ok = pdf["tm_ts"].to_numpy(np.int64), pdf["tm_seq"].to_numpy(np.int64), pdf["tm_ok"].to_numpy(bool)
        values = [pdf[f"tm_v{i}"].to_numpy(np.int64 if self._whole else float) for i in range(self.width)]
        last = self._held(self.last, names, timerValues)
        passed = self._held(self.passed, names, timerValues) if self.kind in GATED else None
        at = self._accepted(ts, seq, of, np.flatnonzero(ok), last)
        runs, taken = _Runs(of[at]), [v[at] for v in values]
        found, keep = np.full((len(self.outs), len(pdf)), np.nan), np.full(len(pdf), self.kind not in GATED)
        if len(at):
            kept, results = getattr(self, "_" + self.kind)(ts[at], taken, runs, last, passed)
            found[:, at[kept]] = results
            keep[at] = kept
            last.save_last(runs, ts[at], seq[at], taken)
        out = pdf.drop(columns=["tm_ok", "tm_ts", "tm_seq", "tm_key", "tm_group", *[f"tm_v{i}" for i in range(self.width)]])
        for name, column in zip(self.outs, found, strict=True):
            out[name] = column
        yield out[keep]

    def _accepted(self, ts: np.ndarray, seq: np.ndarray, of: np.ndarray, at: np.ndarray, last: _Held) -> np.ndarray:
        """Of the usable rows, those later than the state and than the one before: a rate looks at the time alone."""
        ts, seq, of = ts[at], seq[at], of[at]

        def later(than_ts: np.ndarray, than_seq: np.ndarray) -> np.ndarray:
            return ts > than_ts if self.kind == "rate" else (ts > than_ts) | ((ts == than_ts) & (seq > than_seq))

        before = later(np.concatenate([ts[:1], ts[:-1]]), np.concatenate([seq[:1], seq[:-1]]))
        return at[(_Runs(of).first | before) & (~last.known[of] | later(last.ts[of], last.seq[of]))]

    def close(self) -> None:
        pass

    @property
    def _whole(self) -> bool:
        return self.kind in ("rate", "changed_rate")

    def _held(self, state: ValueState, names: Sequence[str], timerValues) -> _Held:
        now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        return _Held(state, names, self.width, self._whole, now, self.ttl_ms)

    # Each gets the accepted rows in runs and the state, and returns which of them give a result, and the results.

    def _rate(self, ts, v, runs, last, passed):
        dt = ts - runs.before(ts, last, last.ts)
        rates = np.stack([_rates(_minus(x, runs.before(x, last, held)), np.maximum(dt, 1), self.reset) for x, held in zip(v, last.values, strict=True)])
        rates[:, runs.first & ~last.known[runs.of]] = 0.0
        return np.ones(len(ts), bool), rates

    def _delta(self, ts, v, runs, last, passed):
        change = _two(v[0] - runs.before(v[0], last, last.values[0]))
        change[runs.first & ~last.known[runs.of]] = 0.0
        return np.ones(len(ts), bool), change[None]

    def _prev(self, ts, v, runs, last, passed):
        return np.ones(len(ts), bool), runs.before(v[0], last, last.values[0], 0.0)[None]

    def _ratio(self, ts, v, runs, last, passed):
        n, d = [runs.before(x, last, held, 0.0) for x, held in zip(v, last.values, strict=True)]
        grew = (v[0] > n) & (v[1] > d)
        with np.errstate(all="ignore"):
            ratio = _two((v[0] - n) / (v[1] - d))
        return np.ones(len(ts), bool), np.where(grew, ratio, 0.0)[None]

    def _share(self, ts, v, runs, last, passed):
        """Total first, then the parts, which remember the last emitted row."""
        moved = _two(v[0] - runs.before(v[0], last, last.values[0]))
        moved[runs.first & ~last.known[runs.of]] = 0.0
        emitted = ~np.isnan(moved) & (moved != 0)
        rows, kept = [x[emitted] for x in v], _Runs(runs.of[emitted])
        before = [kept.before(x, passed, held) for x, held in zip(rows, passed.values, strict=True)]
        with np.errstate(all="ignore"):
            shares = [_two(a - b) / moved[emitted] * 100 + 0.0 for a, b in zip(rows[1:], before[1:], strict=True)]
        passed.save_last(kept, ts[emitted], None, rows)
        return emitted, np.stack(shares) if shares else np.empty((0, int(emitted.sum())))

    def _changed_rate(self, ts, v, runs, last, passed):
        """Emit if any value grew since the last row; rate since the last emitted one."""
        before = [runs.before(x, last, held, 0) for x, held in zip(v, last.values, strict=True)]
        grew = np.any([a > b for a, b in zip(v, before, strict=True)], axis=0)
        at, of = ts[grew], runs.of[grew]
        # A second row of a second is emitted without a rate and not remembered.
        new = _Runs(of).first | (at > np.concatenate([at[:1], at[:-1]]))
        new &= ~passed.known[of] | (at > passed.ts[of])
        rows, at, kept = [x[grew][new] for x in v], at[new], _Runs(of[new])
        rates = np.full((len(v), len(of)), np.nan)
        if len(at):
            dt = at - kept.before(at, passed, passed.ts)
            fresh = [_rates(_minus(x, kept.before(x, passed, held)), np.maximum(dt, 1), self.reset) for x, held in zip(rows, passed.values, strict=True)]
            rates[:, new] = np.where(kept.first & ~passed.known[kept.of], 0.0, fresh)
            passed.save_last(kept, at, None, rows)
        return grew, rates


def _grouped(df: DataFrame) -> GroupedData:
    return df.withColumn("tm_group", F.pmod(F.hash("tm_key"), F.lit(GROUPS))).groupBy("tm_group")


def stateful(
    df: DataFrame,
    kind: str,
    values: dict[str, str] | Sequence[str],
    series: Sequence[str] = SERIES,
    ts: str = "ts_s",
    seq: str = "seq",
    reset_value: float = 1.0,
    ttl_ms: int | None = None,
    start: DataFrame | None = None,
) -> DataFrame:
    """A derivation over a stream, kept across micro-batches.

    `values`: for rate and changed_rate a map of BIGINT columns to output
    columns; for delta and prev one such pair; for ratio {num: out} plus den as
    [num, den, out]; for share [total, part, ...] giving `<part>_pct`.

    `start` is what a batch run of the same derivation left (`saved_state`): the stream goes on
    from there. Gates and shares, which keep two states, start anew.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if start is not None and kind not in STARTED:
        raise ValueError(f"{kind} keeps two states and cannot start from one")
    if isinstance(values, dict):
        cols, outs = list(values), list(values.values())
    elif kind == "ratio":
        cols, outs = list(values[:2]), [values[2]]
    else:
        cols, outs = list(values), [f"{v}_pct" for v in values[1:]]
    whole = kind in ("rate", "changed_rate")
    ok = F.col(ts).isNotNull() & F.col(seq).isNotNull()
    if kind != "prev":
        for c in cols:
            ok = ok & F.col(c).isNotNull()
    # Missing values are flagged, not passed as NULL, so that integers stay exact.
    held = [
        F.coalesce(F.col(c), F.lit(0)).cast("bigint") if whole
        else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c in cols
    ]
    # Integers travel as text: a NULL among them would turn the column into doubles.
    whole_types = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    carried = [
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, whole_types) else F.col(f.name)
        for f in df.schema
    ]
    keyed = df.select(
        *carried,
        ok.alias("tm_ok"),
        F.coalesce(F.col(ts), F.lit(0)).cast("bigint").alias("tm_ts"),
        F.coalesce(F.col(seq), F.lit(0)).cast("bigint").alias("tm_seq"),
        *[h.alias(f"tm_v{i}") for i, h in enumerate(held)],
        F.to_json(series_struct(df, series)).alias("tm_key"),
    )
    n = len(df.columns)
    schema = T.StructType([*keyed.schema.fields[:n], *[T.StructField(o, T.DoubleType()) for o in outs]])
    out = _grouped(keyed).transformWithStateInPandas(
        statefulProcessor=Derivation(kind, len(cols), outs, float(reset_value), ttl_ms),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime",
        initialState=None if start is None else _grouped(start),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema], *outs)


def saved_state(state: DataFrame, kind: str) -> DataFrame:
    """The rows a batch run left for its first step (`SeriesState`), as the `start` of a stream."""
    held = state.schema["_state"].dataType.names
    values = F.array(*[F.col(f"_state.{c}") for c in held if c not in ("ts", "rank")])
    whole = kind == "rate"
    # Of a second, a rate takes the first row: its rank counts down.
    seq = F.col("_state.rank.seq")
    return state.filter(F.col("_state.ts").isNotNull()).select(
        F.to_json("_series").alias("tm_key"), F.col("_state.ts").alias("ts"), (-seq if whole else seq).alias("seq"),
        (values.cast("array<bigint>") if whole else F.lit(None).cast("array<bigint>")).alias("longs"),
        (F.lit(None).cast("array<double>") if whole else values.cast("array<double>")).alias("doubles"),
    )


def stream_state(spark: SparkSession, name: str, checkpoint: str | None = None) -> DataFrame:
    """The state of a derivation that `cycle.start` ran, read back from its store: tm_key, ts, seq, longs, doubles.

    It has the form of `start`: another stream can go on from it.
    """
    path = f"{checkpoint_root(spark, checkpoint)}/cycle/{name}"
    rows = spark.read.format("statestore").option("path", path).option("stateVarName", "last").load()
    held = rows.select(F.explode(F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in ("tm_key", "ts", "seq", "longs", "doubles")])).alias("_s"))
    return held.select("_s.*")
