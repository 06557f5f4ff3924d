"""Stateful operators against plain loops, with ranges small enough to exercise
the carried state and cuts inside one second."""

import random

import pytest
from pyspark.sql import functions as F

import loops
from tidemark.operators import windows as w

SPLITS = [
    {},
    {"ranges": 1},
    {"ranges": 7},
    {"ranges": 150},
]


def series_rows(seed, n=600, step=3, nulls=True):
    rng = random.Random(seed)
    rows, ts = [], 0
    for seq in range(n):
        ts += rng.choice([0, 0, 1, step, step * 20])
        s = rng.choice(["a", "b", "c", None])
        v = rng.randrange(0, 5000) + seq * rng.choice([1, 40])
        if nulls and rng.random() < 0.15:
            v = None
        rows.append((s, ts, seq, v))
    return rows


def frame(spark, rows, value="BIGINT"):
    return spark.createDataFrame(rows, f"s STRING, ts_s BIGINT, seq BIGINT, v {value}").repartition(5)


def found(df, out):
    return {r["seq"]: r[out] for r in df.select("seq", out).collect()}


@pytest.mark.parametrize("split", SPLITS)
def test_rate_equals_loop(spark, split):
    rows = series_rows(1) + [("a", None, 9000, 5), ("a", None, 9001, 6)]
    got = found(w.counter_rate(frame(spark, rows), {"v": "rate"}, ("s",), **split), "rate")
    assert got == loops.rates(rows)


@pytest.mark.parametrize("split", SPLITS)
def test_delta_and_previous_equal_loop(spark, split):
    rows = series_rows(2)
    df = frame(spark, rows)
    assert found(w.delta(df, "v", ("s",), **split), "delta") == loops.deltas(rows)
    want = {k: None if v is None else float(v) for k, v in loops.previous(rows).items()}
    assert found(w.prev_value(df, "v", ("s",), **split), "prev_value") == want


@pytest.mark.parametrize("split", SPLITS)
def test_gated_rate_equals_loop(spark, split):
    rows = series_rows(3, nulls=False)
    got = found(w.changed_rate(frame(spark, rows), {"v": "rate"}, ("s",), **split), "rate")
    assert got == loops.gated_rates(rows)


@pytest.mark.parametrize("split", SPLITS)
def test_share_equals_loop(spark, split):
    rng = random.Random(4)
    rows = []
    for s, ts, seq, v in series_rows(4, nulls=False):
        rows.append((s, ts, seq, (float(rng.randrange(9)), float(rng.randrange(3)), float(rng.randrange(9)))))
    flat = [(s, ts, seq, *v) for s, ts, seq, v in rows]
    df = spark.createDataFrame(flat, "s STRING, ts_s BIGINT, seq BIGINT, user DOUBLE, sys DOUBLE, idle DOUBLE")
    out = w.delta_share(df, ["user"], ["user", "sys", "idle"], ["user", "sys"], ("s",), **split)
    assert found(out, "user_pct") == loops.shares(rows)


@pytest.mark.parametrize("split", SPLITS)
def test_mixed_styles_equal_loops(spark, split):
    one, two = series_rows(7), series_rows(8)
    df = frame(spark, one).withColumn("style", F.lit("rate")).withColumn("seq0", F.col("seq"))
    other = frame(spark, two).withColumn("style", F.lit("delta")).withColumn("seq0", F.col("seq") + 100_000)
    both = df.union(other).withColumn("x", F.col("v").cast("double"))
    got = found(w.derive_styles(both, "v", "x", ("s",), **split).withColumn("seq", F.col("seq0")), "x")
    want = {**loops.rates(one), **{k + 100_000: v for k, v in loops.deltas(two).items()}}
    assert got == want


CASES = {
    "first then growth": ([(0, 10), (20, 50)], [0.0, 2.0]),
    "counter reset": ([(0, 50), (20, 10)], [0.0, 1.0]),
    "same second": ([(0, 10), (0, 20), (20, 50)], [0.0, None, 2.0]),
    "unreadable": ([(0, 10), (20, None), (40, 50)], [0.0, None, 1.0]),
    "unreadable first": ([(0, None), (20, 10), (40, 50)], [None, 0.0, 2.0]),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_rate_cases(spark, case):
    points, want = CASES[case]
    rows = [("x", ts, i, v) for i, (ts, v) in enumerate(points)]
    got = found(w.counter_rate(frame(spark, rows), {"v": "rate"}, ("s",)), "rate")
    assert [got[i] for i in range(len(want))] == want


def test_integer_reading(spark):
    from tidemark.functions.numbers import as_int

    rows = [(0, "int", "10", 10.0), (20, "str", "50.9", None), (40, "float", "50.9", 50.9)]
    df = spark.createDataFrame(rows, "ts_s BIGINT, k STRING, raw STRING, value DOUBLE")
    df = df.withColumn("v", as_int(F.col("raw"), F.col("k"), F.col("value"))).withColumn("seq", F.col("ts_s")).withColumn("s", F.lit("x"))
    got = found(w.counter_rate(df, {"v": "rate"}, ("s",)), "rate")
    assert [got[0], got[20], got[40]] == [0.0, None, 1.0]


def test_idle_gap_with_gate(spark):
    rows = [("x", 0, 0, 10), ("x", 20, 1, 10), ("x", 40, 2, 50)]
    got = found(w.changed_rate(frame(spark, rows), {"v": "rate"}, ("s",)), "rate")
    assert got == {0: 0.0, 2: 1.0}


def test_fixed_rounds_like_formatting(spark):
    from tidemark.functions.numbers import fixed

    rng = random.Random(5)
    xs = [1 / 200, 1 / 8, 201 / 200, 205 / 200, -1 / 8, 123.125, 0.375, 2.675, -0.001, 1e15 + 0.3]
    xs += [rng.randrange(-10**6, 10**6) / rng.choice([8, 20, 21, 40, 200, 1000]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    for x, y in df.select("x", fixed(F.col("x"))).collect():
        assert y == float(f"{x:.2f}")
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "x DOUBLE")
    got = [r[0] for r in odd.select(fixed(F.col("x"))).collect()]
    assert got[0] == float("inf") and got[1] != got[1] and got[2] is None


def test_rank_in_order_is_a_row_number(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i * 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT").repartition(4)
    got = w.rank_in_order(df, ["k"], "seq", ranges=9).collect()
    for k in "ab":
        mine = sorted((r["seq"], r["rank"]) for r in got if r["k"] == k)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_hot_series_is_spread_over_ranges(spark):
    """All rows in one series and a few seconds, `seq` hashed, a third of them one row copied."""
    df = spark.range(30_000).select(
        F.lit("hot").alias("s"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 4).alias("ts_s"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 10**15).alias("seq"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("v"),
    )
    ranged = w.in_ranges(df, ["s"], ["ts_s", "seq"], 30)
    assert ranged.groupBy("_part").count().agg(F.max("count")).first()[0] <= 3_000
    rows = [(r["s"], r["ts_s"], i, r["v"]) for i, r in enumerate(df.orderBy("ts_s", "seq").collect())]
    want = loops.deltas(rows)
    got = w.delta(df, "v", ("s",), ranges=30)
    assert sorted(r["delta"] for r in got.collect()) == sorted(want.values())


def test_rows_of_one_second_and_seq_have_one_order(spark):
    rows = [("x", 0, 0, v) for v in range(40)] + [("x", 20, 1, 100)]
    runs = [
        sorted((r["v"], r["delta"]) for r in w.delta(frame(spark, rows).repartition(k), "v", ("s",), ranges=k).collect())
        for k in (1, 3, 11)
    ]
    assert runs[0] == runs[1] == runs[2]


def test_series_with_maps_and_nulls(spark):
    rows = [(None, {"a": None}, 0, 0, 1), ("", {"a": None}, 20, 1, 41), (None, {"a": None}, 20, 2, 21), (None, None, 20, 3, 9)]
    df = spark.createDataFrame(rows, "s STRING, tags MAP<STRING, STRING>, ts_s BIGINT, seq BIGINT, v BIGINT")
    assert found(w.counter_rate(df, {"v": "rate"}, ("s", "tags")), "rate") == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.0}


def test_empty_table(spark):
    assert w.counter_rate(frame(spark, []), {"v": "rate"}, ("s",)).count() == 0
