"""Encoders, delivery and health on hand-written rows."""

import glob

from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.operators.projections import with_identity
from tidemark.schema import IDENTITY, SAMPLES, THRESHOLDS
from tidemark.sinks import delivery, encoders

ROWS = [
    ("web.1", "c1", 0, "req total", 1700000000, 5.0, "5", "int", "counter", None, 0, {"path": 'a b,"x"'}),
    ("web.1", "c1", 1, "load", 1700000000, 0.5, "0.5", "float", None, None, 0, None),
    ("web.1", "c1", 2, "state", 1700000000, None, 'up "now"', "str", "odd", None, 0, {}),
]


def tagged(spark):
    df = spark.createDataFrame(ROWS, SAMPLES).withColumn("check_type", F.coalesce("check_type", F.lit("untyped")))
    return with_identity(df, spark.createDataFrame([("web.1", "prod", "front", None)], IDENTITY))


def lines(df):
    return sorted(r["line"] for r in df.collect())


def test_influx(spark):
    assert lines(encoders.to_influx(tagged(spark))) == [
        "load,host=web.1,cluster=prod,group=front,type=untyped value=0.5 1700000000000000000",
        'req\\ total,host=web.1,cluster=prod,group=front,type=counter,path=a\\ b\\,"x" value=5i 1700000000000000000',
        'state,host=web.1,cluster=prod,group=front,type=odd value="up \\"now\\"" 1700000000000000000',
    ]


def test_influx_keeps_lines_whole_and_numbers_plain(spark):
    odd = [
        ("h", "c", 0, "big", 1, 12345678.5, "12345678.5", "float", "gauge", None, 0, None),
        ("h", "c", 1, "tiny", 1, 0.00001, "1e-05", "float", "gauge", None, 0, None),
        ("h", "c", 2, "huge", 1, 1e25, "1e25", "float", "gauge", None, 0, None),
        ("h", "c", 3, "endless", 1, float("inf"), "inf", "float", "gauge", None, 0, None),
        ("h", "c", 4, "none", 1, float("nan"), "nan", "float", "gauge", None, 0, None),
        ("h", "c", 5, "text", 1, None, "a\nb\\", "str", "gauge", None, 0, {"path": "x\ny\\"}),
    ]
    df = spark.createDataFrame(odd, SAMPLES).withColumn("check_type", F.lit("gauge"))
    df = with_identity(df, spark.createDataFrame([("h", "prod", "front", None)], IDENTITY))
    tags = "host=h,cluster=prod,group=front,type=gauge"
    assert lines(encoders.to_influx(df)) == [
        f"big,{tags} value=12345678.5 1000000000",
        f"huge,{tags} value=10000000000000000000000000 1000000000",
        f"text,{tags},path=x\\ny\\\\ value=\"a\\nb\\\\\" 1000000000",
        f"tiny,{tags} value=0.00001 1000000000",
    ]


def test_json_points(spark):
    got = lines(encoders.to_kairos(tagged(spark)))
    assert '{"name":"load","timestamp":1700000000000,"value":0.5,"tags":{"cluster":"prod","group":"front","host":"web.1","type":"untyped"}}' in got
    assert any('"value":5,' in g and '"path":"a b,\\"x\\""' in g for g in got)
    assert any('"metric":"state"' in g and '"value":"up \\"now\\""' in g for g in lines(encoders.to_opentsdb(tagged(spark))))


def test_graphite(spark):
    assert "prod.front.web_1.untyped.load 0.5 1700000000" in lines(encoders.to_graphite(tagged(spark)))


def test_prometheus_page(spark, scratch):
    encoded = encoders.to_prometheus(tagged(spark))
    encoders.write_prometheus(encoded, scratch + "/page", partitions=3)
    page = [l.rstrip("\n") for f in sorted(glob.glob(scratch + "/page/part-*")) for l in open(f)]
    assert page == [
        "# HELP req total " + encoders.HELP_TEXT, "# TYPE req total counter",
        'req total{cluster="prod",group="front",host="web.1",path="a b,\\"x\\""} 5.0',
        "# HELP load " + encoders.HELP_TEXT, "# TYPE load untyped",
        'load{cluster="prod",group="front",host="web.1"} 0.5',
    ]


def test_routes_and_replay(spark, scratch):
    batches = spark.createDataFrame([(str(i), i, "b") for i in range(8)], "batch_id STRING, seq BIGINT, body STRING")
    codes = [("0", 200), ("1", 503), ("2", 402), ("3", None), ("4", 500), ("5", 308), ("6", 500)]
    outcomes = spark.createDataFrame(codes, "batch_id STRING, code INT")
    routed = delivery.route_outcomes(batches, outcomes, max_cache=2)
    assert {r["batch_id"]: r["route"] for r in routed.collect()} == {
        "0": "done", "1": "cached", "2": "refused", "3": "cached", "4": "cached", "5": "done", "6": "overflow", "7": "overflow",
    }
    hosted = batches.withColumn("host", F.when(F.col("seq") < 4, "a").otherwise("b"))
    held = spark.createDataFrame([("a", 2)], "host STRING, cached BIGINT")
    got = delivery.route_outcomes(hosted, outcomes, max_cache=2, keys=["host"], cached_before=held)
    assert {r["batch_id"]: r["route"] for r in got.collect() if r["route"] in ("cached", "overflow")} == {
        "1": "cached", "3": "overflow", "4": "cached", "6": "cached", "7": "cached",
    }
    delivery.write_routes(routed, scratch + "/routes")
    assert spark.read.parquet(scratch + "/routes").count() == 8
    plan = delivery.replay_plan(batches, spark.createDataFrame([("0", 200), ("1", 204), ("2", 500), ("3", 200)], "batch_id STRING, code INT"))
    assert {r["batch_id"] for r in plan.filter("replayed").collect()} == {"0", "1"}


def test_threshold_bands_and_message(spark):
    df = spark.createDataFrame(
        [("h", "m", 1, v) for v in (79.999, 80.0, 90.0, None)] + [("h", "other", 1, 99.0)], "host STRING, name STRING, ts_s BIGINT, value DOUBLE"
    )
    dim = spark.createDataFrame([("m", 80.0, 90.0, True, True), ("other", 1.0, 2.0, True, False)], THRESHOLDS)
    got = sorted((r["value"], r["status"], r["message"]) for r in health.threshold_health(df, dim).collect())
    assert got == [
        (0, "OK", "OK: m is at 80.00 percent"), (8, "WARNING", "WARNING: m is at 80.00 percent"), (16, "ERROR", "ERROR: m is at 90.00 percent"),
    ]


def test_counter_bands_are_disjoint(spark):
    df = spark.createDataFrame([("h", 1, "d", v) for v in (0, 1, 2, 4, 5, 9)], "host STRING, ts_s BIGINT, dev STRING, value BIGINT")
    got = sorted(r["value"] for r in health.counter_health(df, F.lit("btrfs"), "dev").collect())
    assert got == [8, 8, 16, 16]
