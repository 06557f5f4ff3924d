"""Status tables and named scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.projections import typed_value
from tidemark.operators.sets import union_samples

# Status variables that are gauges, and the metric of named queries.
STATUS_GAUGES = ("Max_used_connections", "Slow_queries", "Open_files", "Threads_connected")
QUERY_METRIC = "mysql_custom_querry"


def extract_status_rows(
    df: DataFrame, prefix: str = "mysql_", gauges: tuple[str, ...] = STATUS_GAUGES
) -> DataFrame:
    """(variable, value) rows as samples; `style` tells gauges from counters to rate."""
    style = F.when(F.col("variable").isin(*gauges), "gauge").otherwise("rate")
    rest = [c for c in df.columns if c not in ("variable", "value")]
    out = df.select(
        *rest,
        F.concat(F.lit(prefix), F.lower("variable")).alias("name"),
        style.alias("style"),
        F.col("value").cast("string").alias("value_raw"),
    )
    return typed_value(out)


def run_named_queries(
    spark: SparkSession, queries: dict[str, str], metric: str = QUERY_METRIC
) -> DataFrame:
    """Scalar queries over registered views: first column as value, query name as tag.

    The result is kept as text in `value_raw`, so long integers keep all digits and a text
    result gives a text sample (`value` NULL, `value_kind` str).
    """
    parts = []
    for name, text in queries.items():
        rows = spark.sql(text)
        parts.append(
            rows.select(
                F.lit(metric).alias("name"),
                F.create_map(F.lit("prettyname"), F.lit(name)).alias("tags"),
                F.col(rows.columns[0]).cast("string").alias("value_raw"),
            )
        )
    return typed_value(union_samples(*parts))
