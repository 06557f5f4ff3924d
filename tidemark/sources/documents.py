"""Nested JSON documents and arrays of named stats."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.base import PAYLOAD, document, finish_json, scrape_columns

_MAP = "map<string,variant>"


@dataclass(frozen=True)
class Path:
    """One value of a document: JSON path, metric name, style (gauge or rate)."""

    path: str
    name: str
    style: str = "gauge"


def extract_paths(
    df: DataFrame,
    spec: Sequence[Path],
    each: str | None = None,
    tag: str = "entity",
    tag_path: str | None = None,
    first: int | None = None,
) -> DataFrame:
    """Listed values of a document, one row each; missing ones are left out.

    With `each`, the paths apply to every child of that object or array, and
    the child's key (or the value at `tag_path`) becomes a tag. `first` keeps
    the leading children only. `style` is added as a column.
    """
    keep = scrape_columns(df)
    doc = document(df)
    if each is None:
        rows = df.select(*keep, doc.alias("_doc"), F.lit(0).alias("_pos"), F.lit(None).cast("string").alias("_key"))
    else:
        as_map = F.map_entries(F.try_variant_get(doc, each, _MAP))
        as_list = F.transform(
            F.try_variant_get(doc, each, "array<variant>"),
            lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")),
        )
        children = F.coalesce(as_map, as_list)
        if first is not None:
            children = F.slice(children, 1, first)
        rows = df.select(*keep, F.posexplode(children).alias("_pos", "_child")).select(
            *keep, F.col("_child.value").alias("_doc"), "_pos", F.col("_child.key").alias("_key")
        )
        if tag_path is not None:
            rows = rows.withColumn("_key", F.try_variant_get("_doc", tag_path, "string"))
    found = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("name"),
                F.lit(p.style).alias("style"),
                F.try_variant_get("_doc", p.path, "variant").alias("value"),
            )
            for p in spec
        ]
    )
    tags = F.when(F.col("_key").isNotNull(), F.create_map(F.lit(tag), F.col("_key")))
    rows = rows.select(*keep, "_pos", tags.alias("tags"), F.posexplode(found).alias("_i", "_f")).select(
        *keep,
        (F.col("_pos") * F.lit(len(spec)) + F.col("_i")).cast("bigint").alias("seq"),
        F.col("_f.name").alias("name"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
        F.col("_f.style").alias("style"),
        F.col("_f.value").alias("_value"),
    )
    rows = rows.filter(F.col("_value").isNotNull() & ~F.is_variant_null("_value"))
    return finish_json(rows, [*keep, "style"])


# The sections of a telemetry document of named stats.
SECTIONS = ("Gauges", "Counters", "Samples")
_STAT = "Name STRING, Value DOUBLE, Rate DOUBLE, `Count` BIGINT, Labels MAP<STRING, STRING>"


def extract_named_arrays(df: DataFrame, rate_or_count: str = "Rate") -> DataFrame:
    """Named stats: gauges by value, counters by rate, samples by `Rate` or `Count`.

    `section` is kept as a column, stat labels become tags. Names come as they are;
    `plain_stat_name` makes them metric names.
    """
    if rate_or_count not in ("Rate", "Count"):
        raise ValueError("rate_or_count must be Rate or Count")
    keep = scrape_columns(df)
    schema = "STRUCT<" + ", ".join(f"{s}: ARRAY<STRUCT<{_STAT}>>" for s in SECTIONS) + ">"
    doc = F.from_json(F.col(PAYLOAD), schema)

    def section(name: str) -> Column:
        stats = F.coalesce(doc[name], F.array().cast(f"ARRAY<STRUCT<{_STAT}>>"))
        return F.transform(stats, lambda stat: F.struct(F.lit(name).alias("section"), stat.alias("stat")))

    parts = [section(name) for name in SECTIONS]
    picked = {"Gauges": "Value", "Counters": "Rate", "Samples": rate_or_count}
    rows = df.select(*keep, F.posexplode(F.concat(*parts)).alias("_pos", "_e"))
    value = F.lit(None).cast("double")
    for section, name in picked.items():
        value = F.when(F.col("_e.section") == section, F.col(f"_e.stat.{name}").cast("double")).otherwise(value)
    return rows.select(
        *keep,
        F.col("_pos").cast("bigint").alias("seq"),
        F.col("_e.section").alias("section"),
        F.col("_e.stat.Name").alias("name"),
        F.coalesce("_e.stat.Labels", F.create_map().cast("map<string,string>")).alias("tags"),
        value.cast("string").alias("value_raw"),
        value.alias("value"),
        F.lit("float").alias("value_kind"),
    ).filter(F.col("name").isNotNull())


def plain_stat_name(col: Column) -> Column:
    """`a.b-c` becomes `a_b_c`, lower case."""
    return F.lower(F.translate(col, ".-", "__"))
