"""Exposition text: `name{label="value"} number`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.base import EXTRACTED, finish, lines, no_tags, scrape_columns

# The name and label grammar of the format.
NAME = r"^[a-zA-Z_:][a-zA-Z0-9_:]*$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
PLAIN_LABELS = r'^(?:[a-zA-Z_][a-zA-Z0-9_]*="[^",\\]*"(?:,(?=[a-zA-Z_])|$))+$'


def _unescape(v: Column) -> Column:
    """Escaped line breaks, quotes and backslashes of the rare values that have any."""
    plain = v
    for old, new in (("\\\\", "\0"), ("\\n", "\n"), ('\\"', '"'), ("\0", "\\")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.when(v.contains("\\"), plain).otherwise(v)


def labels(text: Column) -> Column:
    """Label pairs as a map; a repeated label keeps its last value.

    Pairs without commas, quotes or escapes in their values are simply split.
    """
    split = F.str_to_map(F.replace(text, F.lit('"'), F.lit("")), F.lit(","), F.lit("="))
    return F.when(text.rlike(PLAIN_LABELS), split).otherwise(_quoted_labels(text))


def _quoted_labels(text: Column) -> Column:
    keys = F.regexp_extract_all(text, F.lit(LABEL), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(LABEL), F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, _unescape))


def extract_exposition(df: DataFrame) -> DataFrame:
    """Labelled and bare metric lines; comments and malformed lines are left out.

    A line is cut at its first `{` and last `}` with plain string functions;
    patterns only read the label pairs.
    """
    if EXTRACTED in df.columns:
        return df.drop(EXTRACTED)
    keep = scrape_columns(df)
    rows = _cut(df, keep, lambda labelled, line: ~labelled | line.contains("}"))
    return _samples(rows.filter((F.col("_rest") != "") & F.col("name").rlike(NAME)), keep)


def page_lines(df: DataFrame) -> DataFrame:
    """As `extract_exposition` in one pass with the malformed lines, which have a `_reason`.

    A rejected line has its number as `seq` and its text as `value_raw`. Samples taken from here
    (`usable_lines`) are passed on by `extract_exposition` as they are.
    """
    keep = scrape_columns(df)
    line = F.col("line")
    rows = _cut(df, [*keep, "line"], lambda labelled, line: F.lit(True))
    reason = (
        F.when(line.contains("{") & ~line.contains("}"), "labels not closed")
        .when(F.col("_rest") == "", "no value")
        .when(~F.col("name").rlike(NAME), "bad name")
    )
    rows = rows.withColumn("_reason", reason)
    bad = F.col("_reason").isNotNull()
    rows = rows.withColumn("_rest", F.when(~bad, F.col("_rest"))).withColumn("_labels", F.when(bad, "").otherwise(F.col("_labels")))
    out = _samples(rows, [*keep, "_reason", "line"])
    return out.withColumn("value_raw", F.coalesce("value_raw", "line")).drop("line")


def usable_lines(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("_reason").isNull()).drop("_reason").withColumn(EXTRACTED, F.lit(True))


def _cut(df: DataFrame, keep: list[str], wanted: Callable[[Column, Column], Column]) -> DataFrame:
    """Name, label text and rest of every wanted line that is no comment."""
    rows = lines(df).filter(~F.ltrim("line").startswith("#"))
    line = F.col("line")
    labelled = line.contains("{")
    head = F.substring_index(line, "{", 1)
    tail = F.substring_index(line, "}", -1)
    spaced = F.ltrim(F.replace(line, F.lit("\t"), F.lit(" ")))
    inner = F.substring(
        line, F.length(head) + 2, F.length(line) - F.length(head) - F.length(tail) - 2
    )
    bare_name = F.substring_index(spaced, " ", 1)
    return rows.filter(wanted(labelled, line)).select(
        *keep,
        "seq",
        F.when(labelled, F.trim(head)).otherwise(bare_name).alias("name"),
        F.when(labelled, inner).otherwise("").alias("_labels"),
        F.when(labelled, F.trim(F.replace(tail, F.lit("\t"), F.lit(" "))))
        .otherwise(F.trim(F.substring(spaced, F.length(bare_name) + 1, F.length(line))))
        .alias("_rest"),
    )


def _samples(rows: DataFrame, keep: list[str]) -> DataFrame:
    rows = rows.select(
        *keep,
        "seq",
        "name",
        F.when(F.col("_labels") == "", no_tags()).otherwise(labels(F.col("_labels"))).alias("tags"),
        F.substring_index("_rest", " ", 1).alias("value_raw"),
    )
    return finish(rows, keep)


def buckets(samples: DataFrame, suffix: str = "_bucket") -> DataFrame:
    """Histogram bucket rows (name without the suffix, `le`, `cumulative`) of extracted samples."""
    cut = F.expr(f"left(name, length(name) - {len(suffix)})")
    return (
        samples.filter(F.col("name").endswith(suffix) & F.map_contains_key("tags", "le"))
        .withColumn("le", F.col("tags")["le"])
        .withColumn("tags", F.map_filter("tags", lambda k, _: k != "le"))
        .withColumn("name", cut)
        .withColumnRenamed("value", "cumulative")
        .drop("value_raw", "value_kind")
    )
