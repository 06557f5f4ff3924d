"""Equi-joins with dimensions, sibling metrics and child documents.

No join carries a hint: Spark broadcasts a side below its own size threshold, and
otherwise the join shuffles and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def label_counts(
    df: DataFrame,
    dim: DataFrame,
    code: str = "code",
    label: str = "label",
    keys: Sequence[str] = ("host", "scrape_id"),
    out: str = "n",
) -> DataFrame:
    """Rows per (keys, label) with every label present, 0 where none occurs.

    Codes that share a label add up. Every (keys, label) is one output row, and starts
    from a 0 row; counting is one pre-aggregated shuffle for any number of labels.
    """
    labels = dim.select(label).where(F.col(label).isNotNull()).distinct()
    zero = df.select(*keys).distinct().crossJoin(labels).withColumn(out, F.lit(0).cast("bigint"))
    labelled = df.join(dim.select(code, label), code).where(F.col(label).isNotNull())
    ones = labelled.select(*keys, label, F.lit(1).cast("bigint").alias(out))
    return zero.union(ones).groupBy(*keys, label).agg(F.sum(out).alias(out))


def resolve_oid(df: DataFrame, oid_names: DataFrame, oid: str = "oid") -> DataFrame:
    """Object id to metric name per device; ids written with or without a leading dot match."""
    bare = F.regexp_replace(F.col(oid), r"^\.", "")
    dim = oid_names.select(
        "device", F.regexp_replace(F.col("oid"), r"^\.", "").alias("_oid"), "name"
    )
    rows = df.drop("name").withColumn("_oid", bare)
    return rows.join(dim, ["device", "_oid"]).drop("_oid")


def pair(
    df: DataFrame,
    left_metric: str,
    right_metric: str,
    keys: Sequence[str],
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Two metrics of one entity side by side; entities lacking one are dropped."""
    left = F.max(F.when(F.col(name) == left_metric, F.col(value)))
    right = F.max(F.when(F.col(name) == right_metric, F.col(value)))
    return (
        df.filter(F.col(name).isin(left_metric, right_metric))
        .groupBy(*keys)
        .agg(left.alias(left_metric), right.alias(right_metric))
        .filter(F.col(left_metric).isNotNull() & F.col(right_metric).isNotNull())
    )


def attach_children(parent: DataFrame, child: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Parent documents with their child documents."""
    return parent.join(child, [key] if isinstance(key, str) else list(key))


def with_attribute(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entity attributes (sector size, CPU count) added to samples."""
    return df.join(dim, list(keys), "left")


def with_thresholds(df: DataFrame, thresholds: DataFrame, name: str = "name") -> DataFrame:
    """Threshold columns added by metric; disabled thresholds do not count."""
    dim = thresholds.filter(F.coalesce(F.col("enabled"), F.lit(True))).select(
        F.col("metric").alias(name), "warn", "crit", "emit_ok"
    )
    return df.join(dim, name, "left")
