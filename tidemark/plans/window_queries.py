"""Registered queries: rates, deltas, ratios, shares and gates over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed
from tidemark.operators import windows as w
from tidemark.plans.tables import cents, epoch_seconds, event_counters, event_samples, table

SERIES = ("host", "name")
DAY = 86_400

COUNTERS_SQL = """
s AS (
  SELECT 'h' || user_id AS host, event_type AS name,
         CAST(floor(epoch(ts) / {tick}) AS BIGINT) * {tick} AS ts_s, event_id AS seq,
         CASE WHEN CAST(json_extract(props, '$.k') AS INT) = 7 THEN NULL
              WHEN CAST(json_extract(props, '$.k') AS INT) < 5 THEN CAST(round(value * 100) AS BIGINT)
              ELSE event_id * 1000 + CAST(round(value * 100) AS BIGINT) END AS v
  FROM events)
"""

RATE_SQL = (
    "WITH "
    + COUNTERS_SQL
    + """,
a AS (SELECT * FROM s WHERE v IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY host, name, ts_s ORDER BY seq) = 1),
d AS (SELECT seq, v - lag(v) OVER p AS dv, ts_s - lag(ts_s) OVER p AS dt FROM a
      WINDOW p AS (PARTITION BY host, name ORDER BY ts_s)),
r AS (SELECT seq, CASE WHEN dv IS NULL THEN 0.0 WHEN dv < 0 THEN 1.0
                       ELSE CAST(format('{{:.2f}}', CAST(dv AS DOUBLE) / dt) AS DOUBLE) END AS rate FROM d)
SELECT s.host, s.name, s.ts_s, s.seq, s.v AS total, r.rate FROM s LEFT JOIN r USING (seq)
"""
)


def _rate(spark: SparkSession, sf_dir: str, tick: int) -> DataFrame:
    rated = w.counter_rate(event_counters(spark, sf_dir, tick), {"total": "rate"}, SERIES)
    return rated.select("host", "name", "ts_s", "seq", "total", "rate")


def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with resets and unreadable values."""
    return _rate(spark, sf_dir, 1)


def counter_rate_same_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time coarsened to days, so that rows share a tick and only the first counts."""
    return _rate(spark, sf_dir, DAY)


def counter_rate_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series identity that includes the tag map."""
    df = event_samples(spark, sf_dir).withColumn("total", cents("value") + F.col("seq") * 1000)
    df = df.withColumn("host", F.lit("fleet"))
    rated = w.counter_rate(df, {"total": "rate"}, ("host", "name", "tags"))
    return rated.select("name", F.col("tags")["k"].alias("k"), "ts_s", "seq", "total", "rate")


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = w.delta(event_samples(spark, sf_dir), "value", SERIES)
    return out.select("host", "name", "ts_s", "seq", "delta")


def prev_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = w.prev_value(event_samples(spark, sf_dir), "value", SERIES)
    return out.select("host", "name", "ts_s", "seq", "prev_value")


def customer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer and day: spent cents and count, as wide gauges."""
    orders = table(spark, sf_dir, "orders")
    day = (F.floor(epoch_seconds(orders, "o_orderdate") / DAY) * DAY).alias("ts_s")
    return orders.groupBy(F.col("o_custkey").alias("host"), day).agg(
        F.sum(cents("o_totalprice")).alias("spent"),
        F.count(F.lit(1)).alias("orders"),
        F.min("o_orderkey").alias("seq"),
    )


CUSTOMER_DAYS_SQL = """
c AS (SELECT o_custkey AS host, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 86400 AS ts_s,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent,
             count(*) AS orders, min(o_orderkey) AS seq
      FROM orders GROUP BY 1, 2)
"""


def delta_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = w.delta_ratio(customer_days(spark, sf_dir), "spent", "seq", ("host",))
    return out.select("host", "ts_s", "delta_ratio")


def delta_ratio_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container CPU form: growth ratio scaled by the number of CPUs and 100."""
    out = w.delta_ratio(
        customer_days(spark, sf_dir), "spent", "ts_s", ("host",), gated=False,
        factor=F.col("orders") * 100.0,
    )
    return out.select("host", "ts_s", "delta_ratio")


def user_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts per user and day, one column per type: the shape of CPU times."""
    ev = table(spark, sf_dir, "events")
    types = ("click", "view", "error", "signup", "purchase")
    day = (F.floor(epoch_seconds(ev, "ts") / DAY) * DAY).alias("ts_s")
    return ev.groupBy(F.col("user_id").alias("host"), day).agg(
        *[F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).alias(t) for t in types],
        F.min("event_id").alias("seq"),
    )


def delta_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = w.delta_share(
        user_parts(spark, sf_dir),
        parts=("click", "view", "error", "signup", "purchase"),
        total_parts=("click", "view", "error", "signup"),
        load_parts=("click", "view", "error"),
        series=("host",),
    )
    shares = ["load_pct", "click_pct", "view_pct", "error_pct", "signup_pct", "purchase_pct"]
    return out.select("host", "ts_s", *[fixed(F.col(c)).alias(c) for c in shares])


def changed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters gated together, rated over the rows that passed."""
    wide = user_parts(spark, sf_dir)
    out = w.changed_rate(wide, {"click": "click_rate", "view": "view_rate"}, ("host",))
    return out.select("host", "ts_s", "click_rate", "view_rate")


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-value gate: rows whose value grew."""
    out = w.changed(event_samples(spark, sf_dir), ["value"], SERIES)
    return out.select("host", "name", "ts_s", "seq", "value")


def rate_of_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_samples(spark, sf_dir).select(
        "name", (F.floor(F.col("ts_s") / 3600) * 3600).alias("ts_s"), "seq",
        (cents("value") * 1000).alias("value"),
    )
    return w.rate_of_sum(df, "value", ["name"], ("name",)).select("name", "ts_s", "total", "rate")


def post_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates truncated, divided by ten, and with negatives dropped."""
    rated = w.counter_rate(
        event_counters(spark, sf_dir), {"total": "rate"}, SERIES, reset_value=-1.0
    )
    return rated.select(
        "seq",
        w.post_rate(F.col("rate"), "int").alias("rate_int"),
        w.post_rate(F.col("rate"), "tenth").alias("rate_tenth"),
        w.post_rate(F.col("rate"), "non_negative").alias("rate_kept"),
    ).filter(F.col("rate_kept").isNotNull())


QUERIES = {
    "counter_rate": counter_rate,
    "counter_rate_same_second": counter_rate_same_second,
    "counter_rate_labelled": counter_rate_labelled,
    "delta": delta,
    "prev_value": prev_value,
    "delta_ratio": delta_ratio,
    "delta_ratio_ungated": delta_ratio_ungated,
    "delta_share": delta_share,
    "changed_rows": changed_rows,
    "changed_rate": changed_rate,
    "rate_of_sum": rate_of_sum,
    "post_rates": post_rates,
}

_SAMPLES = """
s AS (SELECT 'h' || user_id AS host, event_type AS name, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
             event_id AS seq, value FROM events)
"""

_PARTS = """
u AS (SELECT user_id AS host, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS ts_s,
             count(*) FILTER (WHERE event_type = 'click') AS click,
             count(*) FILTER (WHERE event_type = 'view') AS view_n,
             count(*) FILTER (WHERE event_type = 'error') AS error_n,
             count(*) FILTER (WHERE event_type = 'signup') AS signup,
             count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
             min(event_id) AS seq
      FROM events GROUP BY 1, 2)
"""


def _share(part: str, out: str) -> str:
    grown = f"coalesce(({part}) - lag({part}) OVER p, 0)"
    return f"CAST(format('{{:.2f}}', CAST({grown} AS DOUBLE) / dt * 100) AS DOUBLE) + 0.0 AS {out}"


ORACLE = {
    "counter_rate": RATE_SQL.format(tick=1),
    "counter_rate_same_second": RATE_SQL.format(tick=DAY),
    "counter_rate_labelled": """
WITH s AS (SELECT event_type AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
                  CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_id AS seq,
                  CAST(round(value * 100) AS BIGINT) + event_id * 1000 AS total FROM events),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name, k, ts_s ORDER BY seq) = 1),
d AS (SELECT seq, total - lag(total) OVER p AS dv, ts_s - lag(ts_s) OVER p AS dt FROM a
      WINDOW p AS (PARTITION BY name, k ORDER BY ts_s))
SELECT s.name, s.k, s.ts_s, s.seq, s.total,
       CASE WHEN d.seq IS NULL THEN NULL WHEN dv IS NULL THEN 0.0 WHEN dv < 0 THEN 1.0
            ELSE CAST(format('{:.2f}', CAST(dv AS DOUBLE) / dt) AS DOUBLE) END AS rate
FROM s LEFT JOIN d USING (seq)
""",
    "delta": "WITH " + _SAMPLES + """
SELECT host, name, ts_s, seq,
       coalesce(CAST(format('{:.2f}', value - lag(value) OVER p) AS DOUBLE) + 0.0, 0.0) AS delta
FROM s WINDOW p AS (PARTITION BY host, name ORDER BY ts_s, seq)
""",
    "prev_value": "WITH " + _SAMPLES + """
SELECT host, name, ts_s, seq, lag(value, 1, 0.0) OVER p AS prev_value
FROM s WINDOW p AS (PARTITION BY host, name ORDER BY ts_s, seq)
""",
    "delta_ratio": "WITH " + CUSTOMER_DAYS_SQL + """,
d AS (SELECT host, ts_s, spent - lag(spent, 1, 0) OVER p AS dn, seq - lag(seq, 1, 0) OVER p AS dd
      FROM c WINDOW p AS (PARTITION BY host ORDER BY ts_s))
SELECT host, ts_s, CASE WHEN dn > 0 AND dd > 0
       THEN CAST(format('{:.2f}', CAST(dn AS DOUBLE) / dd) AS DOUBLE) ELSE 0.0 END AS delta_ratio
FROM d
""",
    "delta_ratio_ungated": "WITH " + CUSTOMER_DAYS_SQL + """,
d AS (SELECT host, ts_s, orders, spent - lag(spent, 1, 0) OVER p AS dn, ts_s - lag(ts_s, 1, 0) OVER p AS dd
      FROM c WINDOW p AS (PARTITION BY host ORDER BY ts_s))
SELECT host, ts_s,
       CAST(format('{:.2f}', CAST(dn AS DOUBLE) / dd * (orders * 100.0::DOUBLE)) AS DOUBLE) + 0.0 AS delta_ratio
FROM d
""",
    "delta_share": "WITH " + _PARTS + """,
t AS (SELECT *, click + view_n + error_n + signup - lag(click + view_n + error_n + signup) OVER p AS dt
      FROM u WINDOW p AS (PARTITION BY host ORDER BY ts_s)),
g AS (SELECT * FROM t WHERE dt <> 0)
SELECT host, ts_s, """ + ", ".join([
        _share("click + view_n + error_n", "load_pct"),
        _share("click", "click_pct"),
        _share("view_n", "view_pct"),
        _share("error_n", "error_pct"),
        _share("signup", "signup_pct"),
        _share("purchase", "purchase_pct"),
    ]) + """
FROM g WINDOW p AS (PARTITION BY host ORDER BY ts_s)
""",
    "changed_rows": "WITH " + _SAMPLES + """
SELECT host, name, ts_s, seq, value FROM s
QUALIFY value > lag(value, 1, 0.0) OVER (PARTITION BY host, name ORDER BY ts_s, seq)
""",
    "changed_rate": "WITH " + _PARTS + """,
g AS (SELECT * FROM u WINDOW p AS (PARTITION BY host ORDER BY ts_s)
      QUALIFY click > lag(click, 1, 0) OVER p OR view_n > lag(view_n, 1, 0) OVER p),
d AS (SELECT host, ts_s, click - lag(click) OVER p AS dc, view_n - lag(view_n) OVER p AS dv,
             ts_s - lag(ts_s) OVER p AS dt FROM g WINDOW p AS (PARTITION BY host ORDER BY ts_s))
SELECT host, ts_s,
       CASE WHEN dt IS NULL THEN 0.0 WHEN dc < 0 THEN 1.0
            ELSE CAST(format('{:.2f}', CAST(dc AS DOUBLE) / dt) AS DOUBLE) END AS click_rate,
       CASE WHEN dt IS NULL THEN 0.0 WHEN dv < 0 THEN 1.0
            ELSE CAST(format('{:.2f}', CAST(dv AS DOUBLE) / dt) AS DOUBLE) END AS view_rate
FROM d
""",
    "rate_of_sum": """
WITH s AS (SELECT event_type AS name, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS ts_s,
                  CAST(sum(CAST(round(value * 100) AS BIGINT) * 1000) AS BIGINT) AS total
           FROM events GROUP BY 1, 2),
d AS (SELECT *, total - lag(total) OVER p AS dv, ts_s - lag(ts_s) OVER p AS dt
      FROM s WINDOW p AS (PARTITION BY name ORDER BY ts_s))
SELECT name, ts_s, total, CAST(trunc(CASE WHEN dv IS NULL THEN 0.0 WHEN dv < 0 THEN 1.0
       ELSE CAST(format('{:.2f}', CAST(dv AS DOUBLE) / dt) AS DOUBLE) END) AS BIGINT) AS rate
FROM d
""",
    "post_rates": "WITH r AS (" + RATE_SQL.format(tick=1).replace("dv < 0 THEN 1.0", "dv < 0 THEN -1.0") + """)
SELECT seq, CAST(trunc(rate) AS BIGINT) AS rate_int,
       CAST(format('{:.2f}', rate / 10) AS DOUBLE) AS rate_tenth, rate AS rate_kept
FROM r WHERE rate >= 0
""",
}
