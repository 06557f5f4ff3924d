"""Registered queries: raw scrapes rendered from the tables, through checks, recipes and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import checks
from tidemark.functions.numbers import fixed
from tidemark.plans.tables import cents, epoch_seconds, event_counters, event_samples, table
from tidemark.plans.window_queries import ORACLE as WINDOW_ORACLE
from tidemark.plans.window_queries import RATE_SQL, customer_days, user_parts
from tidemark.schema import THRESHOLDS
from tidemark.shared import checkpoint_root
from tidemark.sources.scrapes import read_scrapes, write_scrapes
from tidemark.streaming import cycle
from tidemark.streaming.derive import stateful


def event_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a key/value page of its user, and as a proxy statistics page."""
    ev = table(spark, sf_dir, "events")
    grown = (F.col("event_id") * 1000 + cents("value")).cast("string")
    kv = F.concat(F.lit("# Stats\r\nused_memory:"), cents("value").cast("string"), F.lit("\r\nkeyspace_hits:"), grown,
                  F.lit("\r\nunlisted:1"))
    csv = F.concat(F.lit("# pxname,svname,rate,other\n"), F.col("event_type"), F.lit(",BACKEND,"),
                   cents("value").cast("string"), F.lit(",1\n"), F.col("event_type"), F.lit(",FRONTEND,5,1"))
    pages = F.array(
        F.struct(F.lit("redis").alias("source"), kv.alias("payload")),
        F.struct(F.lit("haproxy").alias("source"), csv.alias("payload")),
    )
    rows = ev.select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"),
        F.col("event_id").cast("string").alias("scrape_id"),
        epoch_seconds(ev, "ts").alias("ts_s"),
        F.lit("text").alias("format"),
        F.explode(pages).alias("_p"),
    )
    return rows.select("host", "_p.source", "scrape_id", "ts_s", "format", "_p.payload")


def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of service through their checks: gauges, rates, tags."""
    known = checks.registered()
    out = checks.run_checks(
        event_scrapes(spark, sf_dir), [known["redis"], known["haproxy"]], samples_path=scratch_path(spark, "samples")
    )
    return out.select(
        "host", "scrape_id", "name", F.try_element_at("tags", F.lit("appname")).alias("appname"), "ts_s", "value", "check_type",
        "chart_type",
    )


def _odd_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a payload, most of which cannot be used as a whole or in part."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 7
    number = cents("value").cast("string")
    payload = (
        F.when(kind == 0, F.concat(F.lit('{"MAIN.threads":{"value":'), number, F.lit("}}")))
        .when(kind == 1, F.concat(F.lit('{"MAIN.threads":{"value":'), number))
        .when(kind == 2, F.concat(F.lit("busy "), number))
        .when(kind == 4, " \n")
        .when(kind == 5, F.concat(F.lit('{"MAIN.threads":{"value":'), number, F.lit('},"MAIN.threads":1}')))
        .when(kind == 6, F.concat(F.lit("# TYPE up gauge\ncoredns_up "), number, F.lit('\ncoredns_hits{zone="a" 5\ncoredns_idle\n9lives 1')))
    )
    return ev.select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"),
        F.when(kind == 6, "coredns").otherwise("varnish").alias("source"),
        F.col("event_id").cast("string").alias("scrape_id"),
        epoch_seconds(ev, "ts").alias("ts_s"),
        F.lit("text").alias("format"),
        payload.alias("payload"),
    )


def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two checks could not use of their payloads, with reason and position, beside the samples."""
    known = checks.registered()
    path = scratch_path(spark, "rejects")
    used = [known["varnish"], known["coredns"]]
    out = checks.run_checks(_odd_scrapes(spark, sf_dir), used, rejects_path=path)
    rejects = spark.read.parquet(path).select("host", "source", "scrape_id", "reason", "position", "head")
    samples = out.select(
        "host", "source", "scrape_id", F.lit("used").alias("reason"), F.lit(None).cast("bigint").alias("position"), F.concat_ws(" ", "name", "value_raw").alias("head")
    )
    return rejects.unionByName(samples)


def _system_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as pages of memory, load, mounts, file system errors and cluster state of its customer."""
    o = table(spark, sf_dir, "orders")
    share = (F.col("o_orderkey") % 101).cast("string")
    memory = F.concat(F.lit("MemTotal: 200 kB\nMemAvailable: "), (F.lit(2) * (F.lit(100) - F.col("o_orderkey") % 101)).cast("string"), F.lit(" kB"))
    load = F.concat((F.col("o_orderkey") % 50 / 10).cast("string"), F.lit(" 0.1 0.1\ncpu 1\ncpu0 1\ncpu1 1\ncpu2 1\ncpu3 1"))
    mounts = F.concat(F.lit("/ "), share, F.lit(" 5 100\n/var/log 1 1 0"))
    errors = F.concat(F.lit("[/dev/sda].io_errs "), (F.col("o_custkey") % 7).cast("string"))
    state = F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "O", "yellow").otherwise("red")
    health = F.concat(
        F.lit('{"cluster_name":"c1","status":"'), state, F.lit('","active_shards":'), share,
        F.lit(',"relocating_shards":0,"initializing_shards":1,"unassigned_shards":2}'),
    )
    pages = F.array(*[
        F.struct(F.lit(name).alias("source"), text.alias("payload"))
        for name, text in (("memory", memory), ("load_average", load), ("mounts", mounts), ("btrfs", errors), ("elasticsearch_health", health))
    ])
    rows = o.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("host"), F.col("o_orderkey").cast("string").alias("scrape_id"),
        epoch_seconds(o, "o_orderdate").alias("ts_s"), F.lit("text").alias("format"), F.explode(pages).alias("_p"),
    )
    return rows.select("host", "_p.source", "scrape_id", "ts_s", "format", "_p.payload")


def check_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health events of system checks, out of the same run as their samples, and how many samples there are."""
    known = checks.registered()
    used = [known[n] for n in ("memory", "load_average", "mounts", "btrfs", "btrfs_errors", "elasticsearch_health")]
    limits = spark.createDataFrame(
        [("mem_used_percent", 80.0, 90.0, False, True), ("sys_load_percent", 60.0, 110.0, False, True), ("drive_percent_used", 70.0, 95.0, False, True)],
        THRESHOLDS,
    )
    samples, events = checks.run_with_events(_system_scrapes(spark, sf_dir), used, limits)
    counted = samples.groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("value")).select(
        F.lit(None).cast("string").alias("host"), F.col("name").alias("module"), F.lit(None).cast("bigint").alias("ts_s"), "value",
        F.lit("samples").alias("status"), F.lit(None).cast("string").alias("message"), F.lit(0).alias("reaction"),
    )
    return events.unionByName(counted)


def enabled_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages with one recipe switched off in the table."""
    known = checks.registered()
    used = [known["redis"], known["haproxy"]]
    recipes = checks.recipe_table(spark, used).withColumn("enabled", F.col("metric") != "redis_keyspace_hits")
    out = checks.run_checks(event_scrapes(spark, sf_dir), used, recipes)
    return out.select("host", "scrape_id", "name", "value")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def landed_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes landed by source and day, then read back for one source from a day on."""
    path = scratch_path(spark, "scrapes")
    write_scrapes(event_scrapes(spark, sf_dir), path)
    rows = read_scrapes(spark, path, ["redis"], since=1_705_000_000)
    return rows.select("host", "source", "scrape_id", "ts_s")


SLICES = 3


def landed_in_slices(batch: DataFrame, path: str, run: Callable[[DataFrame], None]) -> None:
    """Land `batch` in time slices and run the stream after each, so that its state is read back.

    Every slice is a run of its own with the same checkpoint: what came before it is known
    to the stream by its state alone.
    """
    spark = batch.sparkSession
    first, last = batch.agg(F.min("ts_s"), F.max("ts_s")).first()
    step = ((last or 0) - (first or 0)) // SLICES + 1
    at = F.least(F.floor((F.col("ts_s") - F.lit(first or 0)) / step), F.lit(SLICES - 1))
    for i in range(SLICES):
        batch.filter(at == i).write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(batch.schema).parquet(f"{path}/in"))


def _streamed(spark: SparkSession, batch: DataFrame, kind: str, values, series: tuple[str, ...], name: str) -> DataFrame:
    path = scratch_path(spark, name)
    label = path.rsplit("/", 1)[1]

    def run(stream: DataFrame) -> None:
        derived = stateful(stream, kind, values, series)
        cycle.start(derived, cycle.table_sink(f"{path}/out"), label, None).awaitTermination()

    landed_in_slices(batch, path, run)
    return spark.read.parquet(f"{path}/out")


def stream_counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter rates by keyed streaming state; the same result as the batch windows."""
    batch = event_counters(spark, sf_dir).select("host", "name", "ts_s", "seq", "total")
    out = _streamed(spark, batch, "rate", {"total": "rate"}, ("host", "name"), "stream-rate")
    return out.select("host", "name", "ts_s", "seq", "total", "rate")


def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the previous readable value, over micro-batches."""
    batch = event_samples(spark, sf_dir).select("host", "name", "ts_s", "seq", "value")
    out = _streamed(spark, batch, "delta", {"value": "delta"}, ("host", "name"), "stream-delta")
    return out.select("host", "name", "ts_s", "seq", "delta")


def stream_prev_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous value, over micro-batches."""
    batch = event_samples(spark, sf_dir).select("host", "name", "ts_s", "seq", "value")
    out = _streamed(spark, batch, "prev", {"value": "prev_value"}, ("host", "name"), "stream-prev")
    return out.select("host", "name", "ts_s", "seq", "prev_value")


def stream_delta_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated growth ratios, over micro-batches."""
    batch = customer_days(spark, sf_dir)
    out = _streamed(spark, batch, "ratio", ["spent", "seq", "delta_ratio"], ("host",), "stream-ratio")
    return out.select("host", "ts_s", "delta_ratio")


def stream_delta_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the growth of a total, over micro-batches."""
    load = F.col("click") + F.col("view") + F.col("error")
    batch = user_parts(spark, sf_dir).withColumns({"load": load, "total": load + F.col("signup")})
    parts = ["load", "click", "view", "error", "signup", "purchase"]
    out = _streamed(spark, batch, "share", ["total", *parts], ("host",), "stream-share")
    return out.select("host", "ts_s", *[fixed(F.col(f"{p}_pct")).alias(f"{p}_pct") for p in parts])


def stream_changed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change gate and rates over the rows that passed, over micro-batches."""
    rates = {"click": "click_rate", "view": "view_rate"}
    out = _streamed(spark, user_parts(spark, sf_dir), "changed_rate", rates, ("host",), "stream-changed")
    return out.select("host", "ts_s", "click_rate", "view_rate")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest scrape of every host, maintained by a stream over micro-batches."""
    path = scratch_path(spark, "stream-latest")
    label = path.rsplit("/", 1)[1]

    def run(stream: DataFrame) -> None:
        cycle.maintain_latest(stream, f"{path}/latest", label, None).awaitTermination()

    landed_in_slices(event_scrapes(spark, sf_dir).select("host", "source", "scrape_id", "ts_s"), path, run)
    return cycle.read_latest(spark, f"{path}/latest")


QUERIES = {
    "run_checks": run_checks,
    "enabled_recipes": enabled_recipes,
    "rejected_payloads": rejected_payloads,
    "check_events": check_events,
    "landed_scrapes": landed_scrapes,
    "stream_counter_rate": stream_counter_rate,
    "stream_delta": stream_delta,
    "stream_prev_value": stream_prev_value,
    "stream_delta_ratio": stream_delta_ratio,
    "stream_delta_share": stream_delta_share,
    "stream_changed_rate": stream_changed_rate,
    "stream_latest": stream_latest,
}

_BASE = """
e AS (SELECT 'h' || user_id AS host, CAST(event_id AS VARCHAR) AS scrape_id, event_type,
             CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events),
a AS (SELECT *, event_id * 1000 + c AS v FROM e
      QUALIFY row_number() OVER (PARTITION BY host, ts_s ORDER BY event_id) = 1),
d AS (SELECT event_id, v - lag(v) OVER w AS dv, ts_s - lag(ts_s) OVER w AS dt FROM a
      WINDOW w AS (PARTITION BY host ORDER BY ts_s)),
r AS (SELECT event_id, CASE WHEN dv IS NULL THEN 0.0 WHEN dv < 0 THEN 1.0
                            ELSE CAST(format('{:.2f}', CAST(dv AS DOUBLE) / dt) AS DOUBLE) END AS rate FROM d),
o AS (SELECT host, scrape_id, 'redis_used_memory' AS name, NULL AS appname, ts_s, CAST(c AS DOUBLE) AS value,
             'redis' AS check_type, NULL AS chart_type FROM e
      UNION ALL SELECT host, scrape_id, 'haproxy_rate', event_type, ts_s, c, 'haproxy', NULL FROM e
      UNION ALL SELECT host, scrape_id, 'redis_keyspace_hits', NULL, ts_s, rate, 'redis', 'Rate'
                FROM e LEFT JOIN r USING (event_id))
"""

ORACLE = {
    "run_checks": "WITH " + _BASE + "SELECT * FROM o",
    "enabled_recipes": "WITH " + _BASE + "SELECT host, scrape_id, name, value FROM o WHERE name <> 'redis_keyspace_hits'",
    "rejected_payloads": """
WITH e AS (SELECT 'h' || user_id AS host, CASE WHEN event_id % 7 = 6 THEN 'coredns' ELSE 'varnish' END AS source,
                  CAST(event_id AS VARCHAR) AS scrape_id, event_id % 7 AS kind, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS n FROM events),
k(kind, reason, position, head) AS (VALUES
  (0, 'used', NULL, 'varnish_threads #'), (1, 'cut off', -1, '{"MAIN.threads":{"value":#'), (2, 'not JSON', 0, 'busy #'), (3, 'missing', NULL, NULL),
  (4, 'empty', NULL, ' ' || chr(10)), (5, 'malformed JSON', NULL, '{"MAIN.threads":{"value":#},"MAIN.threads":1}'),
  (6, 'used', NULL, 'coredns_up #'), (6, 'labels not closed', 2, 'coredns_hits{zone="a" 5'), (6, 'no value', 3, 'coredns_idle'), (6, 'bad name', 4, '9lives 1'))
SELECT host, source, scrape_id, reason, CAST(CASE WHEN position = -1 THEN length(replace(head, '#', n)) ELSE position END AS BIGINT) AS position,
       replace(head, '#', n) AS head
FROM e JOIN k USING (kind)
""",
    "check_events": """
WITH o AS (SELECT 'c' || o_custkey AS host, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts_s, o_orderkey % 101 AS share,
                  (o_orderkey % 50) / 10.0 * 100 / 4 AS load, o_custkey % 7 AS errs, o_orderstatus AS s FROM orders),
b AS (SELECT host, ts_s, 'Memory-Usage' AS module, CAST(share AS DOUBLE) AS v, 80.0 AS warn, 90.0 AS crit, 'Systems memory usage is ' AS text, ' percent' AS after, false AS ok FROM o
      UNION ALL SELECT host, ts_s, 'Load-Average', CAST(load AS DOUBLE), 60.0, 110.0, 'System Load average is at ', ' percent of available  resources', true FROM o
      UNION ALL SELECT host, ts_s, 'Disk-Usage-rootfs', CAST(share AS DOUBLE), 70.0, 95.0, 'Storage usage of rootfs is at ', ' percent of available  space', false FROM o),
l AS (SELECT *, CASE WHEN v >= crit THEN 16 WHEN v >= warn THEN 8 ELSE 0 END AS value,
             CASE WHEN v >= crit THEN 'ERROR' WHEN v >= warn THEN 'WARNING' ELSE 'OK' END AS status FROM b),
e AS (SELECT host, module, ts_s, value, status, status || ': ' || text || format('{:.2f}', v) || after AS message FROM l WHERE value > 0 OR ok
      UNION ALL SELECT host, 'BTRFS ', ts_s, CASE WHEN errs >= 5 THEN 16 ELSE 8 END, CASE WHEN errs >= 5 THEN 'ERROR' ELSE 'WARNING' END,
             CASE WHEN errs >= 5 THEN 'Critical : corrupted with ' ELSE 'Warning : may be corrupted with ' END || errs || ' IO Errors on btrfs_dev_sda_io_errs' FROM o WHERE errs >= 2
      UNION ALL SELECT host, 'ElasticSearch-Health', ts_s, CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 9 ELSE 16 END, CASE s WHEN 'F' THEN 'OK' WHEN 'O' THEN 'WARNING' ELSE 'ERROR' END,
             'Cluster: c1, Status: ' || CASE s WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'red' END || ', Shards Active: ' || share
             || ', Relocating: 0, Initializing: 1' FROM o),
m(name) AS (VALUES ('mem_total'), ('mem_available'), ('mem_used_percent'), ('sys_load_1'), ('sys_load_5'), ('sys_load_15'), ('drive_bytes_used'),
            ('drive_bytes_used'), ('drive_bytes_available'), ('drive_bytes_available'), ('btrfs_dev_sda_io_errs'), ('elasticsearch_active_shards'),
            ('elasticsearch_relocating_shards'), ('elasticsearch_initializing_shards'), ('elasticsearch_unassigned_shards'))
SELECT host, module, ts_s, CAST(value AS INTEGER) AS value, status, message, 0 AS reaction FROM e
UNION ALL SELECT NULL, name, NULL, CAST(count(*) AS INTEGER), 'samples', NULL, 0 FROM o, m GROUP BY name
UNION ALL SELECT NULL, 'drive_percent_used', NULL, CAST(count(*) FILTER (WHERE share > 0) AS INTEGER), 'samples', NULL, 0 FROM o HAVING count(*) FILTER (WHERE share > 0) > 0
""",
    "landed_scrapes": """
SELECT 'h' || user_id AS host, 'redis' AS source, CAST(event_id AS VARCHAR) AS scrape_id,
       CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM events WHERE floor(epoch(ts)) >= 1705000000
""",
    "stream_counter_rate": RATE_SQL.format(tick=1),
    # The batch queries' SQL: a stream over slices has to give the same rows.
    **{f"stream_{k}": WINDOW_ORACLE[k] for k in ("delta", "prev_value", "delta_ratio", "delta_share", "changed_rate")},
    "stream_latest": """
WITH n AS (SELECT 'h' || user_id AS host, CAST(event_id AS VARCHAR) AS scrape_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s
           FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, CAST(event_id AS VARCHAR) DESC) = 1)
SELECT host, source, scrape_id, ts_s FROM n, (VALUES ('redis'), ('haproxy')) s(source)
""",
}
