"""Streams in several micro-batches against the batch windows and the loops."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

import loops
from test_windows import frame, found, series_rows
from tidemark.operators import windows as w
from tidemark.shared import checkpoint_root
from tidemark.streaming import cycle
from tidemark.streaming.derive import GROUPS, stateful, stream_state


def run_stream(spark, df, scratch, build, cuts):
    """Land `df` in time order as one file per cut and run the stream over them."""
    bounds = [-1, *cuts, 1 << 60]
    for a, b in zip(bounds, bounds[1:]):
        part = df.filter((F.coalesce(F.col("ts_s"), F.lit(0)) > a) & (F.coalesce(F.col("ts_s"), F.lit(0)) <= b))
        part.coalesce(1).write.mode("append").parquet(scratch + "/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in")
    query = cycle.start(build(stream), cycle.table_sink(scratch + "/out"), f"t-{uuid.uuid4().hex}", None, scratch + "/cp")
    assert query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(scratch + "/out")


def test_rate_stream_equals_batch(spark, scratch):
    rows = series_rows(11, n=300) + [("a", 1, 5000, None)]
    df = frame(spark, rows)
    cut = sorted(r[1] for r in rows)[len(rows) // 2]
    out = run_stream(spark, df, scratch, lambda s: stateful(s, "rate", {"v": "rate"}, ("s",)), [cut])
    assert found(out, "rate") == loops.rates(rows)
    assert dict(out.dtypes)["v"] == "bigint"


def test_gated_stream_equals_loop(spark, scratch):
    rows = series_rows(12, n=300, nulls=False)
    cut = sorted(r[1] for r in rows)[len(rows) // 2]
    out = run_stream(spark, frame(spark, rows), scratch, lambda s: stateful(s, "changed_rate", {"v": "rate"}, ("s",)), [cut])
    assert found(out, "rate") == loops.gated_rates(rows)


@pytest.mark.parametrize("kind", ["delta", "ratio", "share"])
def test_other_kinds_equal_batch(spark, scratch, kind):
    rows = series_rows(13, n=200, nulls=False)
    df = frame(spark, rows).withColumn("w", (F.col("seq") * 3 + F.col("v") % 7).cast("double")).withColumn("v", F.col("v").cast("double"))
    cut = sorted(r[1] for r in rows)[len(rows) // 2]
    if kind == "delta":
        out = run_stream(spark, df, scratch, lambda s: stateful(s, "delta", {"v": "x"}, ("s",)), [cut])
        want = w.delta(df, "v", ("s",), out="x")
    elif kind == "ratio":
        out = run_stream(spark, df, scratch, lambda s: stateful(s, "ratio", ["v", "w", "x"], ("s",)), [cut])
        want = w.delta_ratio(df, "v", "w", ("s",), out="x")
    else:
        df = df.withColumn("total", F.col("v") + F.col("w"))
        out = run_stream(spark, df, scratch, lambda s: stateful(s, "share", ["total", "v"], ("s",)), [cut]).withColumn("x", F.col("v_pct"))
        want = w.delta_share(df, ["v"], ["v", "w"], ["v"], ("s",)).withColumn("x", F.col("v_pct"))
    assert found(out, "x") == found(want, "x")


def test_late_row_leaves_state_alone(spark, scratch):
    first = spark.createDataFrame([("x", 100, 0, 10), ("x", 200, 1, 20)], "s STRING, ts_s BIGINT, seq BIGINT, v BIGINT")
    late = spark.createDataFrame([("x", 150, 2, 15), ("x", 300, 3, 70)], first.schema)
    first.coalesce(1).write.parquet(scratch + "/in")
    time.sleep(1.1)
    late.coalesce(1).write.mode("append").parquet(scratch + "/in")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in")
    q = cycle.start(stateful(stream, "rate", {"v": "rate"}, ("s",)), cycle.table_sink(scratch + "/out"), f"t-{uuid.uuid4().hex}", None, scratch + "/cp")
    assert q.awaitTermination(120)
    assert found(spark.read.parquet(scratch + "/out"), "rate") == {0: 0.0, 1: 0.1, 2: None, 3: 0.5}


def test_latest_survives_a_repeated_batch(spark, scratch):
    schema = "host STRING, scrape_id STRING, ts_s BIGINT, v INT"
    fold = cycle.latest_sink(scratch + "/latest")
    fold(spark.createDataFrame([("a", "1", 10, 1), ("a", "2", 20, 2), ("b", "1", 10, 3)], schema), 0)
    second = spark.createDataFrame([("a", "3", 15, 9), ("b", "2", 30, 4), ("b", "2", 30, 5)], schema)
    fold(second, 1)
    fold(second, 1)
    got = sorted(tuple(r) for r in cycle.read_latest(spark, scratch + "/latest").collect())
    assert got == [("a", "2", 20, 2), ("b", "2", 30, 4), ("b", "2", 30, 5)]


def test_many_series_share_a_call_and_a_state_row(spark, scratch):
    schema = "s STRING, ts_s BIGINT, seq BIGINT, v BIGINT"
    n, name = 2 * GROUPS, f"t-{uuid.uuid4().hex}"
    for ts, v in ((100, 10), (110, 30)):
        spark.range(n).selectExpr("concat('s', id) AS s", f"{ts}L AS ts_s", "id AS seq", f"{v}L + id AS v").write.mode("append").parquet(scratch + "/in")
        stream = spark.readStream.schema(schema).parquet(scratch + "/in")
        q = cycle.start(stateful(stream, "rate", {"v": "rate"}, ("s",)), cycle.table_sink(scratch + "/out"), name, None, scratch + "/cp")
        assert q.awaitTermination(120)
    out = spark.read.parquet(scratch + "/out").groupBy("ts_s", "rate").count().collect()
    assert sorted(tuple(r) for r in out) == [(100, 0.0, n), (110, 2.0, n)]
    held = spark.read.format("statestore").option("path", f"{checkpoint_root(spark, scratch + '/cp')}/cycle/{name}").option("stateVarName", "last").load()
    assert held.count() <= GROUPS
    state = stream_state(spark, name, scratch + "/cp")
    assert state.filter((F.col("ts") == 110) & (F.col("longs")[0] == 30 + F.col("seq"))).count() == n
