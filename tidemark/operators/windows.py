"""Stateful derivations over ordered series: rates, deltas, ratios, gates.

All of them need, for each row, the latest earlier accepted row of its series.
`previous` computes that without ever putting a whole series into one task, by one layout
for all inputs:

* the rows are range-partitioned by series, time, `seq` and a full order of rows, so a
  series of any size is cut wherever a partition ends, within one second and among copies too;
* the window runs per partition and series;
* one row per partition and series (its latest accepted row, aggregated before the shuffle)
  is carried to the partitions after it: at most as many per series as there are partitions.

The partitions are written to the shared folder, because both steps must see the same cuts.

A derivation may go on from an earlier run: its saved states (`SeriesState`) are carried in
like those of an earlier range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import fixed, post_rate, ratio
from tidemark.operators.aggregates import sum_over
from tidemark.operators.resume import SeriesState
from tidemark.schema import SERIES
from tidemark.shared import stored

_KEYS = ["_part", "_hash", "_series"]
RANGE_BYTES = 256 << 20
_UNKNOWN = 1 << 60  # Spark's size of what it knows nothing about


def _comparable(field: T.StructField) -> Column:
    """The column; maps become sorted entries."""
    col = F.col(field.name)
    return F.array_sort(F.map_entries(col)) if isinstance(field.dataType, T.MapType) else col


def series_struct(df: DataFrame, series: Sequence[str]) -> Column:
    """The series columns as one comparable value; maps become sorted entries."""
    return F.struct(*[_comparable(df.schema[name]).alias(name) for name in series])


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, the last digit of its order; maps deep inside other types are left out."""
    cols = [
        _comparable(f)
        for f in df.schema
        if "map<" not in (f.dataType.valueType if isinstance(f.dataType, T.MapType) else f.dataType).simpleString()
    ]
    return F.xxhash64(*cols)


def _read_bytes(df: DataFrame) -> int:
    """Size of the tables below the plan, as far as Spark knows it; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN)


def in_ranges(df: DataFrame, series: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """`df` stored in that many `ranges` of (series, `order`), with `_part`, `_hash`, `_series`, `_tie`.

    `_part` grows with the order inside a series. Rows equal in `order` are ordered by `_tie`,
    a hash of the row; exact copies, which nothing tells apart, are spread like other rows.
    `ranges` is by default the number of shuffle partitions, or more where the tables that are
    read need more to stay below `RANGE_BYTES` each. The input is read twice, once for the
    sampling of the ranges.
    """
    key = series_struct(df, series) if series else F.struct(F.lit(1).alias("all"))
    keyed = df.withColumns({"_series": key, "_tie": _row_hash(df)})
    keyed = keyed.withColumns({"_hash": F.xxhash64("_series"), "_row": F.monotonically_increasing_id()})
    n = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(_read_bytes(df) / RANGE_BYTES))
    ranged = keyed.repartitionByRange(n, "_hash", "_series", *order, "_tie", "_row")
    return stored(ranged.drop("_row").withColumn("_part", F.spark_partition_id()), "ranges")


def previous(
    df: DataFrame,
    payload: dict[str, Column],
    series: Sequence[str] = SERIES,
    accept: Column | None = None,
    ts: str = "ts_s",
    seq: str = "seq",
    first_of_second: bool | Column = False,
    out: str = "prev",
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Add `out`: ts and payload of the latest earlier accepted row, NULL if none.

    With `first_of_second` (which may vary by series), only the first accepted
    row of a second counts and the later ones see it as their predecessor (its
    ts equals their own). Rows are stored in ranges first (`in_ranges`), unless the frame
    comes from there. With `resume`, rows before the first one here are those of earlier runs;
    a row that comes too late sees the state, whose ts is above its own (`_late`).
    """
    if not set(_KEYS) <= set(df.columns):
        df = in_ranges(df, series, [ts, seq], ranges)
    first = first_of_second if isinstance(first_of_second, Column) else F.lit(first_of_second)
    rank = F.struct(
        F.when(first, -F.col(seq)).otherwise(F.col(seq)).alias("seq"),
        F.when(first, F.bitwise_not("_tie")).otherwise(F.col("_tie")).alias("tie"),
    )
    state = F.struct(
        F.col(ts).alias("ts"), rank.alias("rank"), *[c.alias(k) for k, c in payload.items()]
    )
    usable = F.col(ts).isNotNull() if accept is None else (accept & F.col(ts).isNotNull())
    state = F.when(usable, state)

    # The highest (ts, rank) seen so far is the latest accepted row, here or in an earlier range:
    # of a second cut in two, the first row may be there.
    within = (
        Window.partitionBy(*_KEYS)
        .orderBy(ts, seq, "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumn("_local", F.max(state).over(within))

    earlier = (
        Window.partitionBy("_hash", "_series")
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lasts = df.groupBy(*_KEYS).agg(F.max(state).alias("_last"))
    carry = F.max("_last").over(earlier)
    if resume:
        saved = resume.step(lasts.filter(F.col("_last").isNotNull()).groupBy("_hash", "_series").agg(F.max("_last").alias("_state")))
        if saved is not None:
            lasts = lasts.join(saved, ["_hash", "_series"], "left")
            carry = F.greatest(carry, F.col("_state"))
    carried = lasts.select(*_KEYS, carry.alias("_carry")).filter(F.col("_carry").isNotNull())
    return (
        local.join(carried, _KEYS, "left")
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_local", "_carry")
    )


def _late(ts: str, prev: str = "_prev") -> Column:
    """Whether a row is older than the state that an earlier run left."""
    return F.coalesce(F.col(f"{prev}.ts") > F.col(ts), F.lit(False))


def drop_ranges(df: DataFrame) -> DataFrame:
    return df.drop(*_KEYS, "_tie")


def _rate(d: Column, dt: Column, reset_value: float) -> Column:
    return F.when(d < 0, F.lit(float(reset_value))).otherwise(fixed(ratio(d, dt)))


def counter_rate(
    df: DataFrame,
    values: dict[str, str],
    series: Sequence[str] = SERIES,
    ts: str = "ts_s",
    seq: str = "seq",
    reset_value: float = 1.0,
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Per-second rate of counters; `values` maps BIGINT input column to output column.

    First accepted row 0.0; a negative rate becomes `reset_value`; a NULL input
    or a second row in the same second gives NULL and leaves the state alone.
    Several columns of one row are accepted together: all must be readable.
    """
    readable = F.lit(True)
    for v in values:
        readable = readable & F.col(v).isNotNull()
    prev = previous(
        df,
        {f"v{i}": F.col(v) for i, v in enumerate(values)},
        series,
        readable,
        ts,
        seq,
        first_of_second=True,
        out="_prev",
        ranges=ranges,
        resume=resume,
    )
    dt = F.col(ts) - F.col("_prev.ts")
    accepted = readable & F.col(ts).isNotNull()
    for i, (v, name) in enumerate(values.items()):
        d = F.try_subtract(F.col(v), F.col(f"_prev.v{i}"))
        rate = F.when(accepted & F.col("_prev").isNull(), F.lit(0.0)).when(
            accepted & (dt > 0), _rate(d, dt, reset_value)
        )
        prev = prev.withColumn(name, rate)
    return drop_ranges(prev).drop("_prev")


def delta(
    df: DataFrame,
    value: str,
    series: Sequence[str] = SERIES,
    ts: str = "ts_s",
    seq: str = "seq",
    out: str = "delta",
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Difference to the previous readable value, 2 places; first 0.0; may be negative."""
    v = F.col(value).cast("double")
    prev = previous(df, {"v": v}, series, v.isNotNull(), ts, seq, out="_prev", ranges=ranges, resume=resume)
    change = F.when(v.isNotNull() & F.col("_prev").isNull(), F.lit(0.0)).when(
        ~_late(ts), fixed(v - F.col("_prev.v"))
    )
    return drop_ranges(prev.withColumn(out, change)).drop("_prev")


def prev_value(
    df: DataFrame,
    value: str,
    series: Sequence[str] = SERIES,
    ts: str = "ts_s",
    seq: str = "seq",
    out: str = "prev_value",
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Value of the previous row, whatever it is; 0.0 for the first row."""
    v = F.col(value).cast("double")
    prev = previous(df, {"v": v}, series, None, ts, seq, out="_prev", ranges=ranges, resume=resume)
    last = F.when(F.col("_prev").isNull(), F.lit(0.0)).when(~_late(ts), F.col("_prev.v"))
    return drop_ranges(prev.withColumn(out, last)).drop("_prev")


def derive_styles(
    df: DataFrame,
    counter: str,
    value: str,
    series: Sequence[str] = SERIES,
    style: str = "style",
    ts: str = "ts_s",
    seq: str = "seq",
    reset_value: float = 1.0,
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Rates and deltas of a mixed table in one pass; `value` becomes the derived value.

    Rows of style `rate` are rated on `counter`, rows of style `delta` differenced
    on `value`. `rate_int` truncates the rate, `rate_tenth` divides it by ten.
    The style is part of the series.
    """
    is_rate = F.col(style).startswith("rate")
    c, v = F.col(counter), F.col(value).cast("double")
    ok = F.col(ts).isNotNull() & F.when(is_rate, c.isNotNull()).otherwise(v.isNotNull())
    prev = previous(
        df, {"c": c, "v": v}, [*series, style], ok, ts, seq, first_of_second=is_rate, out="_prev", ranges=ranges,
        resume=resume,
    )
    dt = F.col(ts) - F.col("_prev.ts")
    rate = F.when(dt > 0, _rate(F.try_subtract(c, F.col("_prev.c")), dt, reset_value))
    rate = (
        F.when(F.col(style) == "rate_int", post_rate(rate, "int").cast("double"))
        .when(F.col(style) == "rate_tenth", post_rate(rate, "tenth"))
        .otherwise(rate)
    )
    change = F.when(~_late(ts), fixed(v - F.col("_prev.v")))
    derived = F.when(
        ok,
        F.when(F.col("_prev").isNull(), F.lit(0.0)).when(is_rate, rate).otherwise(change),
    )
    return drop_ranges(prev.withColumn(value, derived)).drop("_prev")


def delta_ratio(
    df: DataFrame,
    num: str,
    den: str,
    series: Sequence[str],
    ts: str = "ts_s",
    seq: str = "seq",
    out: str = "delta_ratio",
    gated: bool = True,
    factor: Column | float = 1.0,
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Growth of `num` over growth of `den` since the previous row, 2 places.

    The row before the first counts as 0. Gated: 0.0 unless both grew.
    Ungated: scaled by `factor`, NULL when `den` did not move.
    """
    n, d = F.col(num).cast("double"), F.col(den).cast("double")
    prev = previous(df, {"n": n, "d": d}, series, None, ts, seq, out="_prev", ranges=ranges, resume=resume)
    first = F.col("_prev").isNull()
    dn = n - F.when(first, F.lit(0.0)).otherwise(F.col("_prev.n"))
    dd = d - F.when(first, F.lit(0.0)).otherwise(F.col("_prev.d"))
    if gated:
        value = F.when((dn > 0) & (dd > 0), fixed(ratio(dn, dd))).otherwise(F.lit(0.0))
    else:
        value = fixed(ratio(dn, dd) * factor)
    return drop_ranges(prev.withColumn(out, F.when(~_late(ts), value))).drop("_prev")


def delta_share(
    df: DataFrame,
    parts: Sequence[str],
    total_parts: Sequence[str],
    load_parts: Sequence[str],
    series: Sequence[str],
    ts: str = "ts_s",
    seq: str = "seq",
    suffix: str = "_pct",
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Share of each part's growth in the growth of the total, in percent.

    A row is emitted only if the total moved since the previous row. The parts
    remember the previous *emitted* row, so the first emitted one is all 0.0.
    Adds `<part>_pct` for each part and `load_pct` for the sum of `load_parts`.
    """

    def added(names: Sequence[str]) -> Column:
        col = F.col(names[0]).cast("double")
        for name in names[1:]:
            col = col + F.col(name).cast("double")
        return col

    rows = df.withColumn("_total", added(total_parts)).withColumn("load", added(load_parts))
    stage = previous(
        rows, {"v": F.col("_total")}, series, F.col("_total").isNotNull(), ts, seq,
        out="_prev", ranges=ranges, resume=resume,
    )
    moved = (
        stage.withColumn("_moved", fixed(F.col("_total") - F.col("_prev.v")))
        .filter((F.col("_moved") != 0) & ~_late(ts))
        .drop("_prev")
    )
    names = ["load", *parts]
    stage = previous(
        moved, {f"p{i}": F.col(p).cast("double") for i, p in enumerate(names)}, series, None,
        ts, seq, out="_prev", resume=resume,
    )
    for i, p in enumerate(names):
        grown = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(
            fixed(F.col(p).cast("double") - F.col(f"_prev.p{i}"))
        )
        stage = stage.withColumn(p + suffix, ratio(grown, F.col("_moved")) * 100 + F.lit(0.0))
    return drop_ranges(stage).drop("_prev", "_total", "_moved", "load")


def changed(
    df: DataFrame,
    cols: Sequence[str],
    series: Sequence[str],
    ts: str = "ts_s",
    seq: str = "seq",
    keep_ranges: bool = False,
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Rows in which any of `cols` grew since the previous row (0 before the first)."""
    stage = previous(
        df, {f"g{i}": F.col(c).cast("double") for i, c in enumerate(cols)}, series, None,
        ts, seq, out="_prev", ranges=ranges, resume=resume,
    )
    grew = F.lit(False)
    for i, c in enumerate(cols):
        before = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.col(f"_prev.g{i}"))
        grew = grew | F.coalesce(F.col(c).cast("double") > before, F.lit(False))
    stage = stage.filter(grew & ~_late(ts)).drop("_prev")
    return stage if keep_ranges else drop_ranges(stage)


def changed_rate(
    df: DataFrame,
    values: dict[str, str],
    series: Sequence[str],
    ts: str = "ts_s",
    seq: str = "seq",
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Change gate, then rates over the rows that passed, so a rate spans the idle gap."""
    gated = changed(df, list(values), series, ts, seq, keep_ranges=True, ranges=ranges, resume=resume)
    return counter_rate(gated, values, series, ts, seq, resume=resume)


def rate_of_sum(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    series: Sequence[str],
    ts: str = "ts_s",
    seq: str = "seq",
    out: str = "rate",
    ranges: int | None = None,
    resume: SeriesState | None = None,
) -> DataFrame:
    """Sum over the dropped labels per scrape, then the rate of the sum, truncated."""
    summed = sum_over(df, [*keys, ts], value, out="_sum", extra=[F.min(seq).alias(seq)])
    summed = summed.withColumn("_sum", F.col("_sum").cast("bigint"))
    rated = counter_rate(summed, {"_sum": "_rate"}, series, ts, seq, ranges=ranges, resume=resume)
    return (
        rated.withColumn(out, post_rate(F.col("_rate"), "int"))
        .withColumnRenamed("_sum", "total")
        .drop("_rate")
    )


def rank_in_order(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Row number per key along `order` (and a full order of rows), without sorting a key in one task.

    Rows are numbered inside the ranges of `in_ranges`; the row counts of the ranges
    before, at most one per range and key, are added.
    """
    rows = in_ranges(df, keys, [order], ranges)
    before = Window.partitionBy("_hash", "_series").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*_KEYS)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*_KEYS, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*_KEYS).orderBy(order, "_tie")
    numbered = (
        rows.withColumn("_local", F.row_number().over(inside))
        .join(offsets, _KEYS)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
    )
    return drop_ranges(numbered).drop("_local", "_offset")
