"""Registered queries: sums, counts, latest values, quantiles, cost, joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, sets
from tidemark.plans.tables import cents, epoch_seconds, event_samples, table

DAY = 86_400

STATUS_LABELS = [
    ("O", "established"), ("P", "syn_recv"), ("N", "syn_recv"), ("F", "close"), ("X", "closing"),
]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def sum_over_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sums per metric and hour, all labels dropped."""
    df = event_samples(spark, sf_dir).select(
        "name", (F.floor(F.col("ts_s") / 3600) * 3600).alias("ts_s"), "tags", cents("value").alias("value")
    )
    return agg.sum_over(df, ["name", "ts_s"])


def sum_over_keep_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sums with label k retained."""
    df = event_samples(spark, sf_dir).select("name", "tags", cents("value").alias("value"))
    return agg.sum_over(df, ["name"], keep_tags=["k"])


def count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.count_by(_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status codes per customer, every label present, two codes sharing one."""
    dim = spark.createDataFrame(STATUS_LABELS, "code STRING, label STRING")
    df = _orders(spark, sf_dir).select(
        F.col("o_custkey").alias("host"), F.col("o_orderstatus").alias("code")
    )
    return joins.label_counts(df, dim, keys=("host",))


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.count_rows(event_samples(spark, sf_dir), ["host"])


def array_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line count of every page's markup, as the length of an array."""
    df = table(spark, sf_dir, "pages").withColumn("parts", F.split("html", "<"))
    return agg.array_len(df, "parts").select("page_id", "n")


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value per host, day and metric."""
    df = event_samples(spark, sf_dir).select(
        "host", F.floor(F.col("ts_s") / DAY).alias("scrape_id"), "name", "seq", "value"
    )
    return agg.dedup_last(df)


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the last active day of every host."""
    df = event_samples(spark, sf_dir).withColumn("scrape_id", F.floor(F.col("ts_s") / DAY))
    return agg.latest_snapshot(df).select("host", "scrape_id", "ts_s", "seq", "name", "value")


def _quantity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative quantity buckets per flag pair, as exposition-style rows."""
    bounds = [1, 5, 10, 20, 40]
    counts = _lineitem(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(
        *[F.sum(F.when(F.col("l_quantity") <= b, 1).otherwise(0)).alias(str(b)) for b in bounds],
        F.count(F.lit(1)).alias("+Inf"),
    )
    return counts.unpivot(
        ["l_returnflag", "l_linestatus"], [*map(str, bounds), "+Inf"], "le", "cumulative"
    )


def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.histogram_quantile(
        _quantity_buckets(spark, sf_dir), ("l_returnflag", "l_linestatus")
    )
    return out.withColumn("value", fixed(F.col("value"), 4))


def ordered_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric, not textual, order of bucket bounds."""
    out = agg.ordered_buckets(_quantity_buckets(spark, sf_dir), ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "le", "position", "cumulative")


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cost per host from the points of its newest day."""
    df = event_samples(spark, sf_dir).withColumn("scrape_id", F.floor(F.col("ts_s") / DAY))
    return agg.usage_cost(df, period_s=20, unit_price=0.0001, percent_fee=5, fixed_fee=2)


def gc_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order label from its lines: any return flag R, else any A, else none."""
    li = _lineitem(spark, sf_dir)
    rules = [("cms", F.col("l_returnflag") == "R"), ("g1", F.col("l_returnflag") == "A")]
    out = agg.gc_kind(li.select("l_orderkey", "l_linenumber", "l_returnflag"), rules, ["l_orderkey"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "gc_kind")


def first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two orders of every customer."""
    return agg.first_k(
        _orders(spark, sf_dir).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2
    )


def run_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log read off events: value is the duration in cents, type is the check."""
    ev = event_samples(spark, sf_dir).select(
        F.col("name").alias("check"), F.lit(0).cast("bigint").alias("started"), cents("value").alias("ended")
    )
    out = agg.run_timing(ev)
    return out.select("check", "runs", fixed(F.col("avg_s"), 4).alias("avg_s"), "max_s")


def _part_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count metrics per supplier and line number (the shard)."""
    li = _lineitem(spark, sf_dir)
    wide = li.groupBy("l_suppkey", "l_linenumber").agg(
        F.sum(cents("l_extendedprice")).alias("latency_sum"), F.count(F.lit(1)).alias("latency_count")
    )
    return wide.unpivot(
        ["l_suppkey", "l_linenumber"], ["latency_sum", "latency_count"], "name", "value"
    )


def mean_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mean_latency(
        _part_latencies(spark, sf_dir), ["l_suppkey"], "latency_sum", "latency_count"
    )


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count side by side per supplier and line number."""
    return joins.pair(
        _part_latencies(spark, sf_dir), "latency_sum", "latency_count", ["l_suppkey", "l_linenumber"]
    )


def resolve_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as device readings, nations as the object names of the device."""
    nation = table(spark, sf_dir, "nation")
    names = nation.select(
        F.concat(F.lit("dev"), F.col("n_regionkey")).alias("device"),
        F.concat(F.lit(".1.3.6."), F.col("n_nationkey")).alias("oid"),
        F.col("n_name").alias("name"),
    )
    readings = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("dev"), F.col("s_nationkey") % 5).alias("device"),
        F.concat(F.lit("1.3.6."), F.col("s_nationkey")).alias("oid"),
        F.col("s_suppkey"),
        F.col("s_acctbal").alias("value"),
    )
    return joins.resolve_oid(readings, names).select("s_suppkey", "device", "name", "value")


def attach_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (parents) with their orders (children)."""
    parent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    child = _orders(spark, sf_dir).select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    return joins.attach_children(parent, child, "id")


def with_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part size as the sector size of the device a line item belongs to."""
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    li = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = joins.with_attribute(li, dim, ["l_partkey"])
    return out.withColumn("bytes", (F.col("l_quantity") * F.col("p_size")).cast("bigint"))


THRESHOLD_ROWS = [("error", 50.0, 150.0, True, True), ("click", 10.0, 100.0, True, False),
                  ("view", 80.0, 90.0, False, True)]


def with_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(
        THRESHOLD_ROWS, "metric STRING, warn DOUBLE, crit DOUBLE, emit_ok BOOLEAN, enabled BOOLEAN"
    )
    df = event_samples(spark, sf_dir).select("seq", "name", "value")
    return joins.with_thresholds(df, dim).select("seq", "name", "value", "warn", "crit")


def union_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of events and of orders as one table."""
    ev = event_samples(spark, sf_dir).select("host", "name", "ts_s", "value", "check_type")
    o = _orders(spark, sf_dir)
    orders = o.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("host"),
        F.lit("order_price").alias("name"),
        epoch_seconds(o, "o_orderdate").alias("ts_s"),
        F.col("o_totalprice").alias("value"),
    )
    return sets.union_samples(ev, orders)


def union_sources_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two like sources united before counting by state."""
    o = _orders(spark, sf_dir).select(F.col("o_orderstatus").alias("state"))
    li = _lineitem(spark, sf_dir).select(F.col("l_linestatus").alias("state"))
    return agg.count_by(sets.union_sources(o, li), ["state"])


QUERIES = {
    "sum_over_labels": sum_over_labels,
    "sum_over_keep_label": sum_over_keep_label,
    "count_by_category": count_by_category,
    "label_counts": label_counts,
    "count_rows": count_rows,
    "array_len": array_len,
    "dedup_last": dedup_last,
    "latest_snapshot": latest_snapshot,
    "histogram_quantile": histogram_quantile,
    "ordered_buckets": ordered_buckets,
    "usage_cost": usage_cost,
    "gc_kind": gc_kind,
    "first_k": first_k,
    "run_timing": run_timing,
    "mean_latency": mean_latency,
    "pair": pair,
    "resolve_oid": resolve_oid,
    "attach_children": attach_children,
    "with_attribute": with_attribute,
    "with_thresholds": with_thresholds,
    "union_samples": union_samples,
    "union_sources_count": union_sources_count,
}

_BUCKETS = """
b(le, bound) AS (VALUES ('1', 1.0::DOUBLE), ('5', 5.0), ('10', 10.0), ('20', 20.0), ('40', 40.0),
                        ('+Inf', 'infinity'::DOUBLE)),
h AS (SELECT l_returnflag, l_linestatus, le, bound,
             CAST(count(*) FILTER (WHERE l_quantity <= bound) AS DOUBLE) AS cnt
      FROM lineitem, b GROUP BY ALL)
"""

ORACLE = {
    "sum_over_labels": """
SELECT event_type AS name, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS ts_s,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2
""",
    "sum_over_keep_label": """
SELECT event_type AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2
""",
    "count_by_category": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
""",
    "label_counts": """
WITH d(code, label) AS (VALUES ('O', 'established'), ('P', 'syn_recv'), ('N', 'syn_recv'),
                               ('F', 'close'), ('X', 'closing')),
c AS (SELECT o_custkey AS host, label, count(*) AS n FROM orders JOIN d ON o_orderstatus = code GROUP BY 1, 2),
h AS (SELECT DISTINCT o_custkey AS host FROM orders), l AS (SELECT DISTINCT label FROM d)
SELECT h.host, l.label, coalesce(c.n, 0) AS n FROM h CROSS JOIN l LEFT JOIN c USING (host, label)
""",
    "count_rows": "SELECT 'h' || user_id AS host, count(*) AS n FROM events GROUP BY 1",
    "array_len": "SELECT page_id, CAST(len(string_split(html, '<')) AS BIGINT) AS n FROM pages",
    "dedup_last": """
SELECT 'h' || user_id AS host, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS scrape_id, event_type AS name,
       max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3
""",
    "latest_snapshot": """
WITH s AS (SELECT 'h' || user_id AS host, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS scrape_id,
                  CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_id AS seq, event_type AS name, value FROM events)
SELECT * FROM s QUALIFY scrape_id = max(scrape_id) OVER (PARTITION BY host)
""",
    "histogram_quantile": "WITH " + _BUCKETS + """,
p AS (SELECT *, lag(bound, 1, 0.0) OVER w AS pb, lag(cnt, 1, 0.0) OVER w AS pc,
             max(cnt) OVER (PARTITION BY l_returnflag, l_linestatus) AS total
      FROM h WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY bound)),
q(q) AS (VALUES (0.50::DOUBLE), (0.75), (0.85), (0.90), (0.95), (0.99)),
f AS (SELECT l_returnflag, l_linestatus, q,
             CASE WHEN cnt - pc = 0 THEN bound ELSE pb + ((q * total - pc) / (cnt - pc)) * (bound - pb) END AS value
      FROM p, q WHERE cnt >= q * total
      QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, q ORDER BY bound) = 1)
SELECT l_returnflag, l_linestatus, q,
       CASE WHEN isinf(value) THEN value ELSE CAST(format('{:.4f}', value) AS DOUBLE) END AS value FROM f
""",
    "ordered_buckets": "WITH " + _BUCKETS + """
SELECT l_returnflag, l_linestatus, le,
       CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY bound) AS INT) AS position,
       CAST(cnt AS BIGINT) AS cumulative FROM h
""",
    "usage_cost": """
WITH r AS (SELECT 'h' || user_id AS host, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d, count(*) AS n
           FROM events GROUP BY 1, 2),
l AS (SELECT host, arg_max(n, d) AS points_per_run FROM r GROUP BY 1),
m AS (SELECT *, points_per_run * (60.0::DOUBLE / 20 * 60 * 24 * 30) AS monthly_points FROM l)
SELECT host, points_per_run, monthly_points,
       CAST(format('{:.2f}', monthly_points * 0.0001::DOUBLE + monthly_points * 0.0001::DOUBLE * 5 / 100 + 2) AS DOUBLE)
         AS monthly_cost FROM m
""",
    "gc_kind": """
WITH k AS (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'cms'
                                   WHEN bool_or(l_returnflag = 'A') THEN 'g1' END AS gc_kind
           FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, gc_kind FROM lineitem JOIN k USING (l_orderkey)
""",
    "first_k": """
SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2
""",
    "run_timing": """
SELECT event_type AS "check", count(*) AS runs,
       CAST(format('{:.4f}', CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_s,
       max(CAST(round(value * 100) AS BIGINT)) AS max_s FROM events GROUP BY 1
""",
    "mean_latency": """
SELECT l_suppkey, CAST(format('{:.2f}', CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
                                        / count(*)) AS DOUBLE) AS mean FROM lineitem GROUP BY 1
""",
    "pair": """
SELECT l_suppkey, l_linenumber, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS latency_sum,
       count(*) AS latency_count FROM lineitem GROUP BY 1, 2
""",
    "resolve_oid": """
SELECT s_suppkey, 'dev' || n_regionkey AS device, n_name AS name, s_acctbal AS value
FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_nationkey % 5 = n_regionkey
""",
    "attach_children": """
SELECT c_custkey AS id, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
""",
    "with_attribute": """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_size, CAST(l_quantity * p_size AS BIGINT) AS bytes
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""",
    "with_thresholds": """
WITH t(metric, warn, crit) AS (VALUES ('error', 50.0::DOUBLE, 150.0::DOUBLE), ('view', 80.0, 90.0))
SELECT event_id AS seq, event_type AS name, value, warn, crit FROM events LEFT JOIN t ON metric = event_type
""",
    "union_samples": """
SELECT 'h' || user_id AS host, event_type AS name, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, value,
       'gauge' AS check_type FROM events
UNION ALL
SELECT 'c' || o_custkey, 'order_price', CAST(floor(epoch(o_orderdate)) AS BIGINT), o_totalprice, NULL FROM orders
""",
    "union_sources_count": """
SELECT state, count(*) AS n FROM (SELECT o_orderstatus AS state FROM orders
                                  UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY 1
""",
}
