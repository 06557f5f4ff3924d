"""Label sums, counts, latest values, quantiles and cost. All pre-aggregate map-side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed, float_text, ratio

# The quantiles of a latency histogram.
QUANTILES = (0.50, 0.75, 0.85, 0.90, 0.95, 0.99)


def sum_over(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    keep_tags: Sequence[str] = (),
    out: str = "total",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Sum over all labels except the retained ones, which become columns."""
    kept = [F.try_element_at("tags", F.lit(t)).alias(t) for t in keep_tags]
    return df.groupBy(*keys, *kept).agg(F.sum(value).alias(out), *extra)


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_rows(
    df: DataFrame, keys: Sequence[str] = ("host", "scrape_id"), out: str = "n"
) -> DataFrame:
    """Rows (lines, sockets, open files) per scrape."""
    return count_by(df, keys, out)


def array_len(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Number of array elements; 0 for a missing array."""
    return df.withColumn(out, F.coalesce(F.size(F.col(col)), F.lit(0)).cast("bigint"))


def dedup_last(
    df: DataFrame,
    keys: Sequence[str] = ("host", "scrape_id", "name"),
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Last row per key along `order`; the other columns come from that row."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def latest_snapshot(
    df: DataFrame, host: str = "host", scrape: str = "scrape_id", ts: str = "ts_s"
) -> DataFrame:
    """All samples of each host's newest scrape (ties: the greatest scrape id)."""
    newest = df.groupBy(host).agg(F.max(F.struct(ts, scrape)).alias("_top"))
    newest = newest.select(F.col(host), F.col(f"_top.{scrape}").alias(scrape))
    return df.join(newest, [host, scrape], "left_semi")


def _bound(le: str) -> Column:
    return float_text(F.col(le))


def ordered_buckets(df: DataFrame, keys: Sequence[str], le: str = "le") -> DataFrame:
    """Add the numeric bound `bound` and its position among the bounds of its histogram."""
    order = Window.partitionBy(*keys).orderBy("bound")
    return df.withColumn("bound", _bound(le)).withColumn("position", F.row_number().over(order))


def histogram_quantile(
    df: DataFrame,
    keys: Sequence[str] = ("host", "scrape_id", "name"),
    qs: Sequence[float] = QUANTILES,
    le: str = "le",
    cumulative: str = "cumulative",
    merge: str = "last",
    clamp: bool = False,
) -> DataFrame:
    """Quantiles of cumulative buckets, linear inside a bucket; rows (keys, q, value).

    Buckets are first merged to one row per bound (`last` by `seq` if the frame
    has it, or `sum`), so the window runs over the bounds only. A zero total gives NULL; a quantile
    in the `+Inf` bucket is infinite unless clamped to the last finite bound.
    """
    rows = df.withColumn("bound", _bound(le)).filter(F.col("bound").isNotNull())
    count = F.col(cumulative).cast("double")
    if merge == "sum":
        merged = F.sum(count)
    elif "seq" in df.columns:
        merged = F.max_by(count, F.col("seq"))
    else:
        merged = F.max(count)
    rows = rows.groupBy(*keys, "bound").agg(merged.alias("_count"))

    order = Window.partitionBy(*keys).orderBy("bound")
    whole = Window.partitionBy(*keys)
    rows = (
        rows.withColumn("_prev_bound", F.lag("bound", 1, 0.0).over(order))
        .withColumn("_prev_count", F.lag("_count", 1, 0.0).over(order))
        .withColumn("_total", F.max_by("_count", "bound").over(whole))
    )
    picks = []
    for i, q in enumerate(qs):
        target = F.lit(float(q)) * F.col("_total")
        grown = F.col("_count") - F.col("_prev_count")
        inside = F.col("_prev_bound") + ratio(target - F.col("_prev_count"), grown) * (
            F.col("bound") - F.col("_prev_bound")
        )
        at = F.when(grown == 0, F.col("bound")).otherwise(inside)
        if clamp:
            at = F.when(F.col("bound") == float("inf"), F.col("_prev_bound")).otherwise(at)
        hit = (F.col("_total") != 0) & (F.col("_count") >= target)
        picks.append(F.min_by(at, F.when(hit, F.col("bound"))).alias(f"_q{i}"))
    wide = rows.groupBy(*keys).agg(*picks)
    pairs = F.array(
        *[
            F.struct(F.lit(float(q)).alias("q"), F.col(f"_q{i}").alias("value"))
            for i, q in enumerate(qs)
        ]
    )
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.q", "_p.value")


def usage_cost(
    df: DataFrame,
    period_s: float,
    unit_price: float,
    percent_fee: float = 0.0,
    fixed_fee: float = 0.0,
    ts: str = "ts_s",
) -> DataFrame:
    """Monthly cost per host: points of its newest run x runs per 30 days x unit price, plus fees."""
    runs = df.groupBy("host", "scrape_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(ts).alias("_ts")
    )
    per_host = runs.groupBy("host").agg(
        F.max_by("_n", F.struct("_ts", "scrape_id")).alias("points_per_run")
    )
    runs_month = 60.0 / period_s * 60 * 24 * 30
    base = F.col("points_per_run") * F.lit(runs_month) * F.lit(unit_price)
    cost = base + base * F.lit(percent_fee) / 100 + F.lit(fixed_fee)
    return per_host.withColumn("monthly_points", F.col("points_per_run") * F.lit(runs_month)).withColumn(
        "monthly_cost", fixed(cost)
    )


def gc_kind(
    df: DataFrame,
    rules: Sequence[tuple[str, Column]],
    keys: Sequence[str] = ("host", "scrape_id"),
    out: str = "gc_kind",
) -> DataFrame:
    """Label every row with the first rule that any row of its scrape meets; NULL if none.

    A scrape is one payload, so a window over its rows is small; the input is read once.
    Rows without a key belong to no scrape and get NULL.
    """
    scrape = Window.partitionBy(*keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    flags = {f"_f{i}": known & F.bool_or(F.coalesce(cond, F.lit(False))).over(scrape) for i, (_, cond) in enumerate(rules)}
    pick = reduce(
        lambda col, item: F.when(F.col(f"_f{item[0]}"), F.lit(item[1][0])).otherwise(col),
        reversed(list(enumerate(rules))),
        F.lit(None).cast("string"),
    )
    return df.withColumns(flags).withColumn(out, pick).drop(*flags)


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int
) -> DataFrame:
    """First k entities per key; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def run_timing(
    log: DataFrame,
    keys: Sequence[str] = ("check",),
    started: str = "started",
    ended: str = "ended",
) -> DataFrame:
    """Duration of runs: count, mean and maximum per check (or per cycle)."""
    spent = F.col(ended) - F.col(started)
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(spent).alias("avg_s"), F.max(spent).alias("max_s")
    )


def mean_latency(
    df: DataFrame,
    keys: Sequence[str],
    sum_name: str,
    count_name: str,
    name: str = "name",
    value: str = "value",
    out: str = "mean",
) -> DataFrame:
    """Sum metric / count metric per entity over all shards, 2 places."""
    total = F.sum(F.when(F.col(name) == sum_name, F.col(value)))
    count = F.sum(F.when(F.col(name) == count_name, F.col(value)))
    return (
        df.filter(F.col(name).isin(sum_name, count_name))
        .groupBy(*keys)
        .agg(total.alias("_sum"), count.alias("_count"))
        .filter(F.col("_sum").isNotNull() & F.col("_count").isNotNull())
        .withColumn(out, fixed(ratio(F.col("_sum"), F.col("_count"))))
        .drop("_sum", "_count")
    )

