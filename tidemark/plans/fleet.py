"""The minimum end-to-end job: counter rates, summed per metric and hour, classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed
from tidemark.operators.aggregates import sum_over
from tidemark.operators.health import threshold_health
from tidemark.operators.windows import counter_rate
from tidemark.plans.tables import event_counters
from tidemark.schema import THRESHOLDS

# Thresholds for the fleet-wide daily rate of each event type.
THRESHOLD_ROWS = [
    ("click", 20.0, 60.0, True, True),
    ("view", 20.0, 60.0, True, True),
    ("purchase", 20.0, 60.0, False, True),
    ("error", 5.0, 30.0, True, True),
]


def fleet_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate per series, mean rate per metric and day over the fleet, health events."""
    rated = counter_rate(event_counters(spark, sf_dir), {"total": "rate"}, ("host", "name"))
    hundredths = F.round(F.col("rate") * 100).cast("bigint")
    daily = sum_over(
        rated.filter(F.col("rate").isNotNull()).select(
            "name", (F.floor(F.col("ts_s") / 86400) * 86400).alias("ts_s"), hundredths.alias("value")
        ),
        ("name", "ts_s"),
        extra=[F.count(F.lit(1)).alias("n")],
    )
    daily = daily.select(
        F.lit("fleet").alias("host"), "name", "ts_s",
        fixed(F.col("total") / (F.col("n") * 100)).alias("value"),
    )
    thresholds = spark.createDataFrame(THRESHOLD_ROWS, THRESHOLDS)
    return threshold_health(daily, thresholds)


FLEET_HEALTH_SQL = """
WITH s AS (
  SELECT user_id, event_type AS name, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_id AS seq,
         CASE WHEN CAST(json_extract(props, '$.k') AS INT) = 7 THEN NULL
              WHEN CAST(json_extract(props, '$.k') AS INT) < 5 THEN CAST(round(value * 100) AS BIGINT)
              ELSE event_id * 1000 + CAST(round(value * 100) AS BIGINT) END AS v
  FROM events),
a AS (SELECT * FROM s WHERE v IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY user_id, name, ts_s ORDER BY seq) = 1),
d AS (SELECT name, ts_s, v - lag(v) OVER w AS dv, ts_s - lag(ts_s) OVER w AS dt FROM a
      WINDOW w AS (PARTITION BY user_id, name ORDER BY ts_s)),
r AS (SELECT name, CAST(floor(ts_s / 86400) AS BIGINT) * 86400 AS ts_s,
             CASE WHEN dv IS NULL THEN 0.0 WHEN dv < 0 THEN 1.0
                  ELSE CAST(format('{:.2f}', CAST(dv AS DOUBLE) / dt) AS DOUBLE) END AS rate FROM d),
m AS (SELECT name, ts_s,
             CAST(format('{:.2f}', CAST(sum(CAST(round(rate * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100)) AS DOUBLE) AS value
      FROM r GROUP BY 1, 2),
t(name, warn, crit, emit_ok) AS (VALUES ('click', 20.0, 60.0, true), ('view', 20.0, 60.0, true),
      ('purchase', 20.0, 60.0, false), ('error', 5.0, 30.0, true)),
l AS (SELECT m.*, emit_ok, CASE WHEN m.value >= crit THEN 16 WHEN m.value >= warn THEN 8 ELSE 0 END AS level
      FROM m JOIN t USING (name))
SELECT 'fleet' AS host, name AS module, ts_s, level AS value,
       CASE level WHEN 0 THEN 'OK' WHEN 8 THEN 'WARNING' ELSE 'ERROR' END AS status,
       CASE level WHEN 0 THEN 'OK' WHEN 8 THEN 'WARNING' ELSE 'ERROR' END || ': ' || name || ' is at '
         || format('{:.2f}', value) || ' percent' AS message,
       0 AS reaction
FROM l WHERE level <> 0 OR emit_ok
"""

QUERIES = {"fleet_health": fleet_health}
ORACLE = {"fleet_health": FLEET_HEALTH_SQL}
