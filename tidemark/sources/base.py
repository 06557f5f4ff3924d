"""Shared pieces of the extraction jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import float_text
from tidemark.operators.projections import typed_value

PAYLOAD = "payload"
DOCUMENT = "_doc"  # the payload as a parsed document, once it has been opened
EXTRACTED = "_extracted"  # marks samples that a page has been turned into already
SAMPLE_COLUMNS = ("seq", "name", "tags", "value_raw", "value", "value_kind")
NO_TAGS = "map<string,string>"


def scrape_columns(df: DataFrame) -> list[str]:
    """Columns that say where a payload or a sample of it comes from."""
    return [c for c in df.columns if c not in (PAYLOAD, DOCUMENT, EXTRACTED, *SAMPLE_COLUMNS)]


def document(df: DataFrame) -> Column:
    """The payload as a document, parsed here unless it has been (`sources.opened`)."""
    return F.col(DOCUMENT) if DOCUMENT in df.columns else F.try_parse_json(PAYLOAD)


def no_tags() -> Column:
    return F.create_map().cast(NO_TAGS)


def split_lines(payload: Column | str) -> Column:
    """Lines of a payload. Plain replacement and a one-character separator: no
    pattern is compiled per row."""
    col = F.col(payload) if isinstance(payload, str) else payload
    return F.split(F.replace(col, F.lit("\r\n"), F.lit("\n")), "\n")


def lines(df: DataFrame) -> DataFrame:
    """One row per non-blank line: scrape columns, `seq` (line number from 0), `line`.

    `line` is the bare output of the expansion, so filters on it stay cheap
    when Spark pushes them down.
    """
    out = df.select(*scrape_columns(df), F.posexplode(split_lines(PAYLOAD)).alias("seq", "line"))
    return out.filter(F.trim("line") != "").withColumn("seq", F.col("seq").cast("bigint"))


def fields(line: Column, sep: str = r"\s+") -> Column:
    return F.split(F.trim(line), sep)


def field(line: Column, i: int, sep: str = r"\s+") -> Column:
    """Field `i` (from 0) of a line, NULL when it has fewer."""
    return F.get(fields(line, sep), F.lit(i))


def finish(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Order the columns and type the raw value."""
    tags = F.col("tags") if "tags" in df.columns else no_tags()
    out = df.withColumn("tags", tags).select(*keep, "seq", "name", "tags", "value_raw")
    return typed_value(out)


def json_kind(value: Column) -> Column:
    """Kind of a JSON value by its type, not by the look of its text."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "BIGINT", "int")
        .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "float")
        .when(t == "VOID", F.lit(None).cast("string"))
        .otherwise("str")
    )


def finish_json(df: DataFrame, keep: Sequence[str], value: str = "_value") -> DataFrame:
    """As `finish`, from a VARIANT value."""
    raw = F.try_variant_get(F.col(value), "$", "string")
    tags = F.col("tags") if "tags" in df.columns else no_tags()
    return df.select(
        *keep,
        "seq",
        "name",
        tags.alias("tags"),
        raw.alias("value_raw"),
        float_text(raw).alias("value"),
        json_kind(F.col(value)).alias("value_kind"),
    )


def bad_json(df: DataFrame) -> DataFrame:
    """Payloads that are not usable JSON (malformed, or an object repeats a key)."""
    return df.filter(F.col(PAYLOAD).isNotNull() & F.try_parse_json(PAYLOAD).isNull())
