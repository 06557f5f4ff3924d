"""Envelope, tags, typing, unpivot and routing of samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import float_text, int_text, percent_of

UNTYPED = "untyped"
IDENTITY_TAGS = ("cluster", "group", "location")


def normalise(df: DataFrame, default_host: Column | str) -> DataFrame:
    """Missing host becomes the collecting host, missing type becomes `untyped`."""
    host = F.lit(default_host) if isinstance(default_host, str) else default_host
    df = df.withColumn("host", F.coalesce(F.col("host"), host))
    kind = F.col("check_type") if "check_type" in df.columns else F.lit(None).cast("string")
    return df.withColumn("check_type", F.coalesce(kind, F.lit(UNTYPED)))


def with_identity(df: DataFrame, identity: DataFrame) -> DataFrame:
    """Add `all_tags`: host, type, cluster, group, location, overridden by the sample's own tags."""
    dim = identity.select("host", *[F.col(t).alias(f"_{t}") for t in IDENTITY_TAGS])
    joined = df.join(dim, "host", "left")
    fixed_tags = F.create_map(
        F.lit("host"), F.col("host"), F.lit("type"), F.col("check_type"),
        *[x for t in IDENTITY_TAGS for x in (F.lit(t), F.col(f"_{t}"))],
    )
    fixed_tags = F.map_filter(fixed_tags, lambda _, v: v.isNotNull())
    own = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    return joined.withColumn("all_tags", F.map_concat(fixed_tags, own)).drop(
        *[f"_{t}" for t in IDENTITY_TAGS]
    )


def melt(
    df: DataFrame,
    ids: Sequence[str],
    value_cols: Sequence[str],
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Wide stats to one row per metric."""
    return df.unpivot(list(ids), list(value_cols), name, value)


def rename(df: DataFrame, rules: Sequence[Callable[[Column], Column]], col: str = "name") -> DataFrame:
    """Apply naming functions to a column, in order."""
    renamed = F.col(col)
    for rule in rules:
        renamed = rule(renamed)
    return df.withColumn(col, renamed)


def typed_value(df: DataFrame, raw: str = "value_raw") -> DataFrame:
    """Add `value` and `value_kind`: integer text, else float text, else kept as text."""
    text = F.col(raw)
    df = df.withColumn("_int", int_text(text))
    number = F.coalesce(F.col("_int").cast("double"), float_text(text))
    df = df.withColumn("value", number)
    kind = (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.col("_int").isNotNull(), F.lit("int"))
        .when(F.col("value").isNotNull(), F.lit("float"))
        .otherwise(F.lit("str"))
    )
    return df.withColumn("value_kind", kind).drop("_int")


def default_missing(df: DataFrame, spec: dict[str, object]) -> DataFrame:
    """Missing fields take a default; a column that is absent altogether is added."""
    for name, default in spec.items():
        col = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        df = df.withColumn(name, col)
    return df


def keep_tags(df: DataFrame, names: Sequence[str], col: str = "tags") -> DataFrame:
    return df.withColumn(col, F.map_filter(F.col(col), lambda k, _: k.isin(*names)))


def route(df: DataFrame, rules: Sequence[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """First rule whose condition holds sets the listed columns; other rows stay."""
    targets = list(dict.fromkeys(t for _, sets in rules for t in sets))
    updated = {}
    for target in targets:
        col = None
        for cond, sets in rules:
            value = sets.get(target, F.col(target) if target in df.columns else F.lit(None))
            col = F.when(cond, value) if col is None else col.when(cond, value)
        keep = F.col(target) if target in df.columns else F.lit(None)
        updated[target] = col.otherwise(keep)
    return df.withColumns(updated)


def scale(df: DataFrame, factor: Column | float, col: str = "value") -> DataFrame:
    """Unit scaling by a constant or by another column."""
    by = factor if isinstance(factor, Column) else F.lit(factor)
    return df.withColumn(col, F.col(col) * by)


def percent(df: DataFrame, num: str, den: str, out: str = "percent") -> DataFrame:
    """num * 100 / den; NULL when either is 0."""
    return df.withColumn(out, percent_of(F.col(num), F.col(den)))


def extract_all_indexed(
    df: DataFrame, pattern: str, col: str = "payload", group: int = 1
) -> DataFrame:
    """Every match of a pattern as its own row, numbered from 0."""
    found = F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group))
    return df.select("*", F.posexplode(found).alias("idx", "value_raw"))
