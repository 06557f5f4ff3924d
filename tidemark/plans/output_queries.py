"""Registered queries: health events, encoded points, delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.operators.projections import with_identity
from tidemark.plans.tables import cents, epoch_seconds, event_samples, table
from tidemark.schema import IDENTITY, THRESHOLDS
from tidemark.sinks import delivery, encoders

HOUR = 3600


def _hourly_error_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of error events per hour, fleet wide."""
    ev = event_samples(spark, sf_dir)
    hour = (F.floor(F.col("ts_s") / HOUR) * HOUR).alias("ts_s")
    errors = F.sum(F.when(F.col("name") == "error", 1).otherwise(0))
    return ev.groupBy(hour).agg((errors * 100 / F.count(F.lit(1))).alias("value")).select(
        F.lit("fleet").alias("host"), F.lit("error_share").alias("name"), "ts_s", "value"
    )


def threshold_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([("error_share", 20.0, 40.0, True, True)], THRESHOLDS)
    return health.threshold_health(_hourly_error_share(spark, sf_dir), dim)


def threshold_health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form without OK events."""
    dim = spark.createDataFrame([("error_share", 20.0, 40.0, False, True)], THRESHOLDS)
    return health.threshold_health(_hourly_error_share(spark, sf_dir), dim, label="has")


def state_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as cluster state."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "P", "HEALTH_WARN").otherwise("red")
    df = o.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("host"), epoch_seconds(o, "o_orderdate").alias("ts_s"), state.alias("state"),
    )
    return health.state_health(df, F.lit("cluster"))


def _plugin_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(3)
    return o.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("host"),
        epoch_seconds(o, "o_orderdate").alias("ts_s"),
        F.col("o_orderpriority").alias("plugin"),
        code.alias("exit_code"),
        F.concat(F.lit("disk: 5%, free;"), F.col("o_orderkey").cast("string"), F.lit("\n")).alias("output"),
    )


def exit_code_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.exit_code_health(_plugin_results(spark, sf_dir))


def exit_code_health_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.exit_code_health(_plugin_results(spark, sf_dir), web=True)


def counter_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines per order and supplier as error counters of devices."""
    li = table(spark, sf_dir, "lineitem")
    errors = li.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("value"))
    df = errors.select(
        F.lit("fleet").alias("host"), F.lit(0).cast("bigint").alias("ts_s"),
        F.concat(F.lit("dev"), F.col("l_orderkey")).alias("device"), "value",
    )
    return health.counter_health(df, F.lit("volumes"), "device")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alive event per host and day, with the largest value as response time."""
    df = event_samples(spark, sf_dir).withColumn("scrape_id", F.floor(F.col("ts_s") / 86_400))
    return health.heartbeats(df.withColumn("response_s", F.col("value")))


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence per host, measured at a fixed time after the data."""
    return health.last_seen(event_samples(spark, sf_dir), F.lit(1_710_000_000))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with identity: hosts are the nations of the supplier dimension plus one default."""
    ev = event_samples(spark, sf_dir).withColumn("host", F.concat(F.lit("web."), F.col("name")))
    identity = spark.createDataFrame(
        [(f"web.{n}", "prod", "front end", "am") for n in ("click", "view", "error", "signup", "purchase")],
        IDENTITY,
    )
    return with_identity(ev, identity)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as integer cents, the others as floats."""
    df = _tagged(spark, sf_dir)
    whole = F.col("name") == "error"
    return df.withColumn("value_raw", F.when(whole, cents("value").cast("string")).otherwise(F.col("value_raw"))).withColumn(
        "value_kind", F.when(whole, "int").otherwise("float")
    )


def kairos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.to_kairos(_typed(spark, sf_dir))


def opentsdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.to_opentsdb(_typed(spark, sf_dir))


def influx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.to_influx(_typed(spark, sf_dir))


def graphite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.to_graphite(_typed(spark, sf_dir))


def prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.to_prometheus(_tagged(spark, sf_dir))


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as batches of the sending customer; the priority is the response."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    code = (
        F.when(p == "1-URGENT", 200).when(p == "2-HIGH", 415).when(p == "3-MEDIUM", 503).when(p == "4-NOT SPECIFIED", 308)
    )
    batches = o.select(
        F.col("o_orderkey").cast("string").alias("batch_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("host"),
    )
    return batches, o.select(F.col("o_orderkey").cast("string").alias("batch_id"), code.alias("code"))


def route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache of a thousand batches for the fleet."""
    batches, outcomes = _batches(spark, sf_dir)
    return delivery.route_outcomes(batches, outcomes, max_cache=1000).select("batch_id", "code", "route")


def route_outcomes_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of two batches for every host."""
    batches, outcomes = _batches(spark, sf_dir)
    out = delivery.route_outcomes(batches, outcomes, max_cache=2, keys=["host"])
    return out.select("host", "batch_id", "code", "route")


def replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, outcomes = _batches(spark, sf_dir)
    return delivery.replay_plan(batches, outcomes, ["host"]).select("host", "batch_id", "replayed")


def replay_plan_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, outcomes = _batches(spark, sf_dir)
    return delivery.replay_plan(batches, outcomes).select("batch_id", "replayed")


QUERIES = {
    "threshold_health": threshold_health,
    "threshold_health_alerts": threshold_health_alerts,
    "state_health": state_health,
    "exit_code_health": exit_code_health,
    "exit_code_health_web": exit_code_health_web,
    "counter_health": counter_health,
    "heartbeats": heartbeats,
    "last_seen": last_seen,
    "kairos": kairos,
    "opentsdb": opentsdb,
    "influx": influx,
    "graphite": graphite,
    "prometheus": prometheus,
    "route_outcomes": route_outcomes,
    "route_outcomes_per_host": route_outcomes_per_host,
    "replay_plan": replay_plan,
    "replay_plan_fleet": replay_plan_fleet,
}

_SHARE = """
WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS ts_s,
                  CAST(count(*) FILTER (WHERE event_type = 'error') * 100 AS DOUBLE) / count(*) AS v
           FROM events GROUP BY 1),
l AS (SELECT *, CASE WHEN v >= 40 THEN 16 WHEN v >= 20 THEN 8 ELSE 0 END AS value,
             CASE WHEN v >= 40 THEN 'ERROR' WHEN v >= 20 THEN 'WARNING' ELSE 'OK' END AS status FROM h)
SELECT 'fleet' AS host, 'error_share' AS module, ts_s, value, status,
       status || ': error_share {verb} ' || format('{{:.2f}}', v) || ' percent' AS message, 0 AS reaction FROM l
"""

_EV = """
e AS (SELECT 'web.' || event_type AS host, event_type AS name, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
             CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
             CASE WHEN event_type = 'error' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
                  ELSE CAST(value AS VARCHAR) END AS num,
             CAST(value AS VARCHAR) AS plain, event_type = 'error' AS whole
      FROM events)
"""

_JSON_TAGS = """'"tags":{"cluster":"prod","group":"front end","host":"' || host || '","k":"' || k
       || '","location":"am","type":"gauge"}}'"""

_CODES = """
b AS (SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, o_orderkey AS seq, o_custkey AS host,
             CASE o_orderpriority WHEN '1-URGENT' THEN 200 WHEN '2-HIGH' THEN 415 WHEN '3-MEDIUM' THEN 503
                  WHEN '4-NOT SPECIFIED' THEN 308 END AS code FROM orders),
r AS (SELECT *, code IN (200, 308) AS done, coalesce(code NOT IN (200, 308, 415), true) AS retry FROM b)
"""


def _routes(partition: str, cap: int, cols: str) -> str:
    return "WITH " + _CODES + f"""
SELECT {cols}, code, CASE WHEN done THEN 'done' WHEN NOT retry THEN 'refused'
       WHEN row_number() OVER (PARTITION BY retry{partition} ORDER BY seq) <= {cap} + 1 THEN 'cached'
       ELSE 'overflow' END AS route FROM r
"""


ORACLE = {
    "threshold_health": _SHARE.format(verb="is at"),
    "threshold_health_alerts": _SHARE.format(verb="has") + " WHERE value > 0",
    "state_health": """
SELECT 'c' || o_custkey AS host, 'cluster' AS module, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts_s,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 9 ELSE 16 END AS value,
       CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'WARNING' ELSE 'ERROR' END AS status,
       CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'P' THEN 'HEALTH_WARN' ELSE 'red' END AS message, 0 AS reaction
FROM orders
""",
    "exit_code_health": """
SELECT 'c' || o_custkey AS host, o_orderpriority AS module, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts_s,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 8 ELSE 16 END AS value,
       CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'WARNING' ELSE 'ERROR' END AS status,
       'disk  5 Percent  free|' || o_orderkey AS message, 0 AS reaction FROM orders
""",
    "exit_code_health_web": """
SELECT 'c' || o_custkey AS host, o_orderpriority AS module, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts_s,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 8 ELSE 16 END AS value,
       CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'WARNING' ELSE 'CRITICAL' END AS status,
       'disk: 5%, free;' || o_orderkey AS message, 0 AS reaction FROM orders
""",
    "counter_health": """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT 'fleet' AS host, 'volumes' AS module, CAST(0 AS BIGINT) AS ts_s, CASE WHEN n >= 5 THEN 16 ELSE 8 END AS value,
       CASE WHEN n >= 5 THEN 'ERROR' ELSE 'WARNING' END AS status,
       CASE WHEN n >= 5 THEN 'Critical : corrupted with ' ELSE 'Warning : may be corrupted with ' END
         || n || ' IO Errors on dev' || l_orderkey AS message, 0 AS reaction
FROM c WHERE n >= 2
""",
    "heartbeats": """
SELECT 'h' || user_id AS host, 'HeartBeat' AS module, CAST(floor(max(epoch(ts))) AS BIGINT) AS ts_s, 0 AS value, 'OK' AS status,
       '{DURATION} without HearBeats from host' AS message, 0 AS reaction, max(value) AS response_s
FROM events GROUP BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT)
""",
    "last_seen": """
SELECT 'h' || user_id AS host, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_seen,
       1710000000 - CAST(floor(max(epoch(ts))) AS BIGINT) AS silent_s FROM events GROUP BY 1
""",
    "kairos": "WITH " + _EV + """
SELECT '{"name":"' || name || '","timestamp":' || ts_s || '000,"value":' || num || ',' || """ + _JSON_TAGS + " AS line FROM e",
    "opentsdb": "WITH " + _EV + """
SELECT '{"metric":"' || name || '","timestamp":' || ts_s || ',"value":' || num || ',' || """ + _JSON_TAGS + " AS line FROM e",
    "influx": "WITH " + _EV + r"""
SELECT name || ',host=' || host || ',cluster=prod,group=front\ end,location=am,type=gauge,k=' || k || ' value=' || num
       || CASE WHEN whole THEN 'i' ELSE '' END || ' ' || ts_s || '000000000' AS line FROM e
""",
    "graphite": "WITH " + _EV + """
SELECT 'prod.front_end.' || replace(host, '.', '_') || '.am.gauge.' || k || '.' || name || ' ' || num || ' ' || ts_s AS line FROM e
""",
    "prometheus": "WITH " + _EV + """
SELECT 'gauge' AS type, name, 2 AS part, name || '{cluster="prod",group="front end",host="' || host || '",k="' || k
       || '",location="am"} ' || plain AS line FROM e
UNION ALL SELECT DISTINCT 'gauge', name, 0, '# HELP ' || name || ' Metrics provided by the fleet telemetry engine.' FROM e
UNION ALL SELECT DISTINCT 'gauge', name, 1, '# TYPE ' || name || ' gauge' FROM e
""",
    "route_outcomes": _routes("", 1000, "batch_id"),
    "route_outcomes_per_host": _routes(", host", 2, "host, batch_id"),
    "replay_plan": "WITH " + _CODES + """
SELECT host, batch_id, seq < coalesce(min(seq) FILTER (WHERE NOT coalesce(done, false)) OVER (PARTITION BY host), seq + 1)
       AS replayed FROM r
""",
    "replay_plan_fleet": "WITH " + _CODES + """
SELECT batch_id, seq < coalesce(min(seq) FILTER (WHERE NOT coalesce(done, false)) OVER (), seq + 1) AS replayed FROM r
""",
}
