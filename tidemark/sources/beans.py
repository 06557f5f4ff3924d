"""Management beans: arrays `{"beans": [...]}` and maps `{"value": {bean: {...}}}`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import gc_name
from tidemark.operators.filters import allow
from tidemark.sources.base import document, finish_json, json_kind, scrape_columns

_MAP = "map<string,variant>"

# The attributes of a collector bean, and what one that never ran reports.
COLLECTOR_KEYS = ("CollectionCount", "CollectionTime", "LastGcInfo")
NO_COLLECTION = '{"CollectionCount":0,"CollectionTime":0,"LastGcInfo":{"duration":0}}'


def _flat(value: Column) -> Column:
    """A JSON object as its entries, anything else as one entry without a sub-key."""
    inner = F.map_entries(F.try_variant_get(value, "$", _MAP))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("key"), value.alias("value")))
    return F.coalesce(inner, alone)


def _attributes(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Bean attributes, one level of nesting flattened: attr, sub, _value."""
    keep = [*keep, "bean", "gctype", "seq"]
    return (
        df.select(*keep, F.explode(F.col("attrs")).alias("attr", "_outer"))
        .select(*keep, "attr", F.explode(_flat(F.col("_outer"))).alias("_e"))
        .select(*keep, "attr", F.col("_e.key").alias("sub"), F.col("_e.value").alias("_value"))
    )


def _samples(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Attribute rows to samples: name `attr` or `attr.sub`, tags `bean` and `gctype`."""
    rows = rows.filter(json_kind(F.col("_value")).isNotNull())
    name = F.when(F.col("sub").isNull(), F.col("attr")).otherwise(F.concat_ws(".", "attr", "sub"))
    known = F.create_map(F.lit("bean"), F.col("bean"), F.lit("gctype"), F.col("gctype"))
    tags = F.map_filter(known, lambda _, v: v.isNotNull())
    return finish_json(rows.withColumn("name", name).withColumn("tags", tags), keep)


def extract_bean_array(
    df: DataFrame, keys: DataFrame | Sequence[str] | None = None, name_key: str = "name"
) -> DataFrame:
    """Wanted attributes wherever they occur in an array of beans.

    Nested memory and collector structs give `Attribute.field`; `keys` filters
    on the attribute. Beans of collectors that have run carry the tag `gctype`.
    """
    keep = scrape_columns(df)
    beans = F.try_variant_get(document(df), "$.beans", "array<variant>")
    rows = df.select(*keep, F.posexplode(beans).alias("_pos", "_bean")).select(
        *keep,
        F.col("_pos").cast("bigint").alias("seq"),
        F.try_variant_get("_bean", f"$.{name_key}", "string").alias("bean"),
        F.when(
            F.try_variant_get("_bean", "$.LastGcInfo.duration", "bigint").isNotNull(),
            gc_name(F.try_variant_get("_bean", "$.Name", "string")),
        ).alias("gctype"),
        F.try_variant_get("_bean", "$", _MAP).alias("attrs"),
    )
    attrs = _attributes(rows, keep)
    if keys is not None:
        attrs = allow(attrs, keys, "attr")
    return _samples(attrs, keep)


def bean_property(bean: Column, key: str) -> Column:
    """A property out of a bean name such as `domain:type=X,name=Y`; NULL if absent."""
    found = F.regexp_extract(bean, f"[:,]{key}=([^,]*)", 1)
    return F.nullif(found, F.lit(""))


def extract_bean_map(
    df: DataFrame,
    keys: DataFrame | Sequence[str] | None = None,
    properties: Sequence[str] = (),
) -> DataFrame:
    """Attributes of a map of beans; listed key properties become tags.

    A `value` that is itself one bean (its entries are attributes) works too.
    Collector beans carry the tag `gctype` and have 0 for what they lack.
    """
    keep = scrape_columns(df)
    whole = F.try_variant_get(document(df), "$.value", _MAP)
    rows = df.select(*keep, F.posexplode(whole).alias("_pos", "bean", "_bean"))
    attrs = F.try_variant_get("_bean", "$", _MAP)
    is_bean = F.col("bean").contains(":") & attrs.isNotNull()
    collector = F.when(
        F.map_contains_key(attrs, "Name") & F.exists(F.map_keys(attrs), lambda k: k.isin(*COLLECTOR_KEYS)),
        gc_name(F.try_variant_get("_bean", "$.Name", "string")),
    )
    none = F.try_variant_get(F.try_parse_json(F.lit(NO_COLLECTION)), "$", _MAP)
    known = F.map_filter(attrs, lambda _, v: ~F.is_variant_null(v))
    attrs = F.when(collector.isNotNull(), F.map_concat(none, known)).otherwise(attrs)
    rows = rows.select(
        *keep,
        F.col("_pos").cast("bigint").alias("seq"),
        F.when(is_bean, F.col("bean")).alias("bean"),
        F.when(is_bean, collector).alias("gctype"),
        F.when(is_bean, attrs).otherwise(F.create_map("bean", "_bean")).alias("attrs"),
    )
    found = _attributes(rows, keep)
    if keys is not None:
        found = allow(found, keys, "attr")
    out = _samples(found, keep)
    if properties:
        pairs = F.create_map(
            *[x for p in properties for x in (F.lit(p), bean_property(F.col("tags")["bean"], p))]
        )
        extra = F.map_filter(pairs, lambda _, v: v.isNotNull())
        out = out.withColumn("tags", F.map_concat("tags", extra))
    return out


def collector_stats(df: DataFrame) -> DataFrame:
    """Garbage collector beans of a bean map: `last`, `count` and `time` per collector.

    A missing count or time and a missing last collection give 0.
    """
    keep = scrape_columns(df)
    beans = F.try_variant_get(document(df), "$.value", _MAP)
    rows = df.select(*keep, F.posexplode(beans).alias("_pos", "bean", "_bean"))

    def number(path: str) -> Column:
        return F.coalesce(F.try_variant_get("_bean", path, "bigint"), F.lit(0))

    stats = F.create_map(
        F.lit("last"), number("$.LastGcInfo.duration"),
        F.lit("count"), number("$.CollectionCount"),
        F.lit("time"), number("$.CollectionTime"),
    )
    return (
        rows.withColumn("collector", F.try_variant_get("_bean", "$.Name", "string"))
        .filter(F.col("collector").isNotNull())
        .select(*keep, F.col("_pos").cast("bigint").alias("seq"), "collector",
                F.explode(stats).alias("name", "value"))
    )
