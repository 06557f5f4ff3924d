"""Registered queries: checks and delivery on streams, and derivations that go on between runs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import checks
from tidemark.checks.custom import table_extract
from tidemark.operators import windows as w
from tidemark.operators.resume import SeriesState
from tidemark.plans.check_queries import ORACLE as CHECK_ORACLE
from tidemark.plans.check_queries import SLICES, event_scrapes, landed_in_slices, scratch_path
from tidemark.plans.tables import cents, epoch_seconds, event_counters, table
from tidemark.plans.window_queries import RATE_SQL
from tidemark.shared import stored
from tidemark.streaming import cycle
from tidemark.streaming.checks import read_samples, run_checks_on
from tidemark.streaming.derive import saved_state, stateful
from tidemark.streaming.forward import forward_sink
from tidemark.streaming.silence import silence_events

DAY = 86_400


def stream_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of service through their checks on a stream: the rows of the batch run."""
    known = checks.registered()
    path = scratch_path(spark, "stream-checks")
    label = path.rsplit("/", 1)[1]

    def run(stream: DataFrame) -> None:
        query = run_checks_on(stream, [known["redis"], known["haproxy"]], path, label, period=None)
        query.awaitTermination()

    landed_in_slices(event_scrapes(spark, sf_dir), path, run)
    out = read_samples(spark, path)
    return out.select(
        "host", "scrape_id", "name", F.try_element_at("tags", F.lit("appname")).alias("appname"), "ts_s", "value", "check_type",
        "chart_type",
    )


def _dated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an encoded batch of its customer, numbered by day and key."""
    o = table(spark, sf_dir, "orders")
    ts = epoch_seconds(o, "o_orderdate")
    return o.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("host"),
        F.col("o_orderkey").cast("string").alias("batch_id"),
        (F.floor(ts / DAY) * 10_000_000 + F.col("o_orderkey")).alias("seq"),
        ts.alias("ts_s"),
        F.col("o_orderstatus").alias("body"),
    )


def stream_store_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery over three micro-batches, the second of which meets an outage.

    Status P is refused; O is turned away when first sent and accepted later; F is accepted. Every
    customer's backlog holds three batches.
    """
    path = scratch_path(spark, "forward")
    label = path.rsplit("/", 1)[1]

    def deliver(batches: DataFrame, batch_id: int) -> DataFrame:
        again = F.col("cycle") < batch_id
        code = F.when(F.col("body") == "P", 415).when((F.col("body") == "F") | again, 200).otherwise(503)
        return batches.select("batch_id", F.when(F.lit(batch_id) != 1, code).alias("code"))

    sink = forward_sink(deliver, path, max_cache=2)

    def run(stream: DataFrame) -> None:
        def numbered(batch: DataFrame, batch_id: int) -> None:
            sink(batch.withColumn("cycle", F.lit(batch_id)), batch_id)

        cycle.start(stream, numbered, label, None).awaitTermination()

    landed_in_slices(_dated_batches(spark, sf_dir), path, run)
    out = spark.read.parquet(f"{path}/routes")
    return out.select("host", "batch_id", "route", F.col("batch").cast("int").alias("cycle"))


def resumed_counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter rates of two halves, the second of which starts from what the first left."""
    rows = stored(event_counters(spark, sf_dir), "counters")
    first, last = rows.agg(F.min("ts_s"), F.max("ts_s")).first()
    half = ((first or 0) + (last or 0)) // 2
    path = scratch_path(spark, "series")
    parts = []
    for run, part in enumerate((rows.filter(F.col("ts_s") <= half), rows.filter(F.col("ts_s") > half))):
        state = SeriesState(spark, path, run)
        parts.append(w.counter_rate(part, {"total": "rate"}, ("host", "name"), resume=state))
        state.commit()
    out = parts[0].unionByName(parts[1])
    return out.select("host", "name", "ts_s", "seq", "total", "rate")


def stream_resumed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter rates of a stream that starts from the state of a batch run over the first half."""
    rows = stored(event_counters(spark, sf_dir), "counters")
    first, last = rows.agg(F.min("ts_s"), F.max("ts_s")).first()
    early = F.col("ts_s") <= ((first or 0) + (last or 0)) // 2
    path = scratch_path(spark, "stream-resumed")
    label = path.rsplit("/", 1)[1]
    state = SeriesState(spark, f"{path}/state", 0)
    batch = w.counter_rate(rows.filter(early), {"total": "rate"}, ("host", "name"), resume=state)
    state.commit()
    start = saved_state(state.left(), "rate")

    def run(stream: DataFrame) -> None:
        derived = stateful(stream, "rate", {"total": "rate"}, ("host", "name"), start=start)
        cycle.start(derived, cycle.table_sink(f"{path}/out"), label, None).awaitTermination()

    landed_in_slices(rows.filter(~early), path, run)
    names = ["host", "name", "ts_s", "seq", "total", "rate"]
    return batch.select(*names).unionByName(spark.read.parquet(f"{path}/out").select(*names))


SILENT_S = 2 * DAY


def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms for hosts without a scrape for two days, and their end; every tenth host stops in the second slice."""
    path = scratch_path(spark, "silence")
    label = path.rsplit("/", 1)[1]
    ev = table(spark, sf_dir, "events")
    rows = stored(ev.select(F.concat(F.lit("h"), F.col("user_id")).alias("host"), F.col("user_id"), epoch_seconds(ev, "ts").alias("ts_s")), "alive")
    first, last = rows.agg(F.min("ts_s"), F.max("ts_s")).first()
    half = ((first or 0) + (last or 0)) // 2
    rows = rows.filter((F.col("user_id") % 10 != 0) | (F.col("ts_s") <= half) | (F.col("ts_s") == last)).drop("user_id")

    def run(stream: DataFrame) -> None:
        cycle.start(silence_events(stream, SILENT_S), cycle.table_sink(f"{path}/out"), label, None).awaitTermination()

    landed_in_slices(rows, path, run)
    return spark.read.parquet(f"{path}/out").select("host", "module", "ts_s", "value", "status", "message", "reaction")


def _values(payloads: pa.Array) -> pa.Table:
    """`name:value` items between semicolons."""
    items = pc.split_pattern(payloads, ";")
    pairs, row = pc.split_pattern(pc.list_flatten(items), ":", max_splits=1), pc.list_parent_indices(items)
    whole = pc.equal(pc.list_value_length(pairs), 2)
    pairs, row = pairs.filter(whole), row.filter(whole)
    return pa.table({"row": row, "name": pc.list_element(pairs, 0), "value_raw": pc.list_element(pairs, 1)})


def custom_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own payload form through a vectorised table function, with recipes like any other check."""
    ev = table(spark, sf_dir, "events")
    payload = F.concat_ws(";", F.concat(F.lit("size:"), cents("value").cast("string")), F.concat(F.lit("kind_"), "event_type", F.lit(":1")), F.lit("junk"),
                          F.concat(F.lit("odd:"), "props"))
    raw = ev.select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"), F.lit("mine").alias("source"), F.col("event_id").cast("string").alias("scrape_id"),
        epoch_seconds(ev, "ts").alias("ts_s"), F.lit("own").alias("format"), F.when(F.col("event_id") % 9 != 0, payload).alias("payload"),
    )
    recipes = [checks.Recipe("size", "my_size"), checks.Recipe("odd", "my_odd"), *[checks.Recipe(f"kind_{k}", f"my_{k}") for k in ("click", "view", "error")]]
    mine = checks.Check("mine", table_extract(_values), recipes, "custom")
    out = checks.run_checks(raw, [mine])
    return out.select("host", "scrape_id", "name", "seq", "value", "value_raw", "check_type")


QUERIES = {
    "stream_run_checks": stream_run_checks,
    "stream_store_forward": stream_store_forward,
    "resumed_counter_rate": resumed_counter_rate,
    "stream_resumed_rate": stream_resumed_rate,
    "stream_silence": stream_silence,
    "custom_payload": custom_payload,
}

_SLICED = f"""
t AS (SELECT *, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts_s FROM orders),
m AS (SELECT min(ts_s) AS first_s, (max(ts_s) - min(ts_s)) // {SLICES} + 1 AS step FROM t),
b AS (SELECT 'c' || o_custkey AS host, CAST(o_orderkey AS VARCHAR) AS batch_id, o_orderstatus AS s,
             ts_s // {DAY} * 10000000 + o_orderkey AS seq, least((ts_s - first_s) // step, {SLICES - 1}) AS slice
      FROM t, m)
"""

ORACLE = {
    "stream_run_checks": CHECK_ORACLE["run_checks"],
    "stream_store_forward": "WITH " + _SLICED + """,
n0 AS (SELECT *, row_number() OVER (PARTITION BY host, s ORDER BY seq) AS r FROM b WHERE slice = 0),
r0 AS (SELECT host, batch_id, s, seq, 0 AS cycle,
              CASE WHEN s = 'F' THEN 'done' WHEN s = 'P' THEN 'refused' WHEN r <= 3 THEN 'cached' ELSE 'overflow' END AS route FROM n0),
h0 AS (SELECT host, count(*) AS held FROM r0 WHERE route = 'cached' GROUP BY host),
n1 AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS r FROM b WHERE slice = 1),
r1 AS (SELECT host, batch_id, s, seq, 1 AS cycle, CASE WHEN r + coalesce(held, 0) <= 3 THEN 'cached' ELSE 'overflow' END AS route
       FROM n1 LEFT JOIN h0 USING (host)),
k1 AS (SELECT * FROM r0 WHERE route = 'cached' UNION ALL SELECT * FROM r1 WHERE route = 'cached'),
p2 AS (SELECT *, seq < coalesce(min(seq) FILTER (WHERE s = 'P') OVER (PARTITION BY host), seq + 1) AS through FROM k1),
h2 AS (SELECT host, count(*) AS held FROM p2 WHERE NOT through GROUP BY host),
n2 AS (SELECT *, row_number() OVER (PARTITION BY host, s ORDER BY seq) AS r FROM b WHERE slice = 2),
r2 AS (SELECT host, batch_id, s, seq, 2 AS cycle,
              CASE WHEN s = 'F' THEN 'done' WHEN s = 'P' THEN 'refused' WHEN r + coalesce(held, 0) <= 3 THEN 'cached' ELSE 'overflow' END AS route
       FROM n2 LEFT JOIN h2 USING (host)),
o AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2
      UNION ALL SELECT host, batch_id, s, seq, 2, 'replayed' FROM p2 WHERE through)
SELECT host, batch_id, route, CAST(cycle AS INTEGER) AS cycle FROM o
""",
    "resumed_counter_rate": RATE_SQL.format(tick=1),
    "stream_resumed_rate": RATE_SQL.format(tick=1),
    # A gap is told at its end, or by the watermark: the newest time before the last slice.
    "stream_silence": f"""
WITH a AS (SELECT 'h' || user_id AS host, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM events),
m AS (SELECT min(ts_s) AS lo, max(ts_s) AS hi FROM a),
r AS (SELECT DISTINCT host, ts_s FROM a, m WHERE user_id % 10 <> 0 OR ts_s <= (lo + hi) // 2 OR ts_s = hi),
c AS (SELECT min(ts_s) AS lo, (max(ts_s) - min(ts_s)) // {SLICES} + 1 AS step FROM r),
k AS (SELECT max(ts_s) AS passed FROM r, c WHERE (ts_s - c.lo) // step < {SLICES - 1}),
g AS (SELECT host, ts_s, lead(ts_s) OVER (PARTITION BY host ORDER BY ts_s) AS nxt FROM r),
e AS (SELECT host, ts_s + {SILENT_S} AS ts_s, true AS alarm FROM g, k WHERE nxt - ts_s > {SILENT_S} OR (nxt IS NULL AND ts_s + {SILENT_S} <= passed)
      UNION ALL SELECT host, nxt, false FROM g WHERE nxt - ts_s > {SILENT_S})
SELECT host, 'HeartBeat' AS module, ts_s, CASE WHEN alarm THEN 16 ELSE 0 END AS value, CASE WHEN alarm THEN 'ERROR' ELSE 'OK' END AS status,
       CASE WHEN alarm THEN 'ERROR: no HeartBeats for {SILENT_S} seconds' ELSE 'OK: HeartBeats are back' END AS message, 0 AS reaction FROM e
""",
    "custom_payload": """
WITH e AS (SELECT 'h' || user_id AS host, CAST(event_id AS VARCHAR) AS scrape_id, event_type, props,
                  CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_id % 9 <> 0)
SELECT host, scrape_id, 'my_size' AS name, CAST(0 AS BIGINT) AS seq, CAST(c AS DOUBLE) AS value, CAST(c AS VARCHAR) AS value_raw, 'custom' AS check_type FROM e
UNION ALL SELECT host, scrape_id, 'my_' || event_type, 1, 1.0, '1', 'custom' FROM e WHERE event_type IN ('click', 'view', 'error')
UNION ALL SELECT host, scrape_id, 'my_odd', 2, NULL, props, 'custom' FROM e
""",
}
