"""Line-oriented payloads: key/value, positional, CSV, plug-in output."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.base import (
    PAYLOAD,
    field,
    fields,
    finish,
    lines,
    scrape_columns,
    split_lines,
)

_CELL = r',("(?:[^"]|"")*"|[^,]*)'


def _key_and_value(line: Column, sep: str, first_token: bool) -> tuple[Column, Column]:
    parts = F.split(line, sep, 2)
    value = F.trim(F.get(parts, F.lit(1)))
    if first_token:
        value = F.get(F.split(value, r"\s+"), F.lit(0))
    return F.trim(F.get(parts, F.lit(0))), value


def extract_kv_lines(
    df: DataFrame, sep: str = ":", prefix: str = "", first_token: bool = False, last_wins: bool = False
) -> DataFrame:
    """`key<sep>value` lines; `sep` is a pattern. Lines without it are left out.

    A leading `prefix` is dropped; `first_token` ignores a unit after the value.
    `last_wins` keeps the last of a repeated key, inside the payload and so
    without a shuffle.
    """
    keep = scrape_columns(df)

    def bare(line: Column) -> Column:
        return F.substring(line, len(prefix) + 1, 1 << 30) if prefix else line

    if last_wins:
        def entry(line: Column, i: Column) -> Column:
            name, value = _key_and_value(bare(line), sep, first_token)
            return F.struct(name.alias("key"), F.struct(i.alias("seq"), value.alias("raw")).alias("value"))

        found = split_lines(PAYLOAD)
        if prefix:
            found = F.filter(found, lambda line: line.startswith(prefix))
        found = F.filter(
            F.transform(found, entry), lambda e: e["value"]["raw"].isNotNull() & (e["key"] != "")
        )
        # Repeated keys: the session's map policy keeps the last.
        rows = df.select(*keep, F.explode(F.map_from_entries(found)).alias("name", "_v")).select(
            *keep, F.col("_v.seq").cast("bigint").alias("seq"), "name", F.col("_v.raw").alias("value_raw")
        )
        return finish(rows, keep)

    rows = lines(df)
    if prefix:
        rows = rows.filter(F.col("line").startswith(prefix))
    name, value = _key_and_value(bare(F.col("line")), sep, first_token)
    rows = rows.select(*keep, "seq", name.alias("name"), value.alias("value_raw"))
    return finish(rows.filter(F.col("value_raw").isNotNull() & (F.col("name") != "")), keep)


@dataclass(frozen=True)
class Cell:
    """One value of a status page: metric name, line and field (from 0), field separator."""

    name: str
    line: int
    field: int
    sep: str = r"\s+"


def extract_positional(df: DataFrame, spec: Sequence[Cell]) -> DataFrame:
    """Values at fixed places of a payload; missing places are left out."""
    keep = scrape_columns(df)
    rows = df.withColumn("_lines", split_lines(PAYLOAD))
    found = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("name"),
                F.trim(field(F.get("_lines", F.lit(c.line)), c.field, c.sep)).alias("value_raw"),
            )
            for c in spec
        ]
    )
    rows = rows.select(*keep, F.posexplode(found).alias("_pos", "_f")).select(
        *keep, F.col("_pos").cast("bigint").alias("seq"), "_f.name", "_f.value_raw"
    )
    return finish(rows.filter(F.coalesce(F.col("value_raw"), F.lit("")) != ""), keep)


def extract_columns(
    df: DataFrame, columns: dict[str, int], sep: str = r"\s+", skip: int = 0, where: Column | None = None
) -> DataFrame:
    """Every line as a row of fixed columns; the first `skip` lines are headers.

    `where` filters on `line` before the split.
    """
    rows = lines(df).filter(F.col("seq") >= skip)
    if where is not None:
        rows = rows.filter(where)
    rows = rows.withColumn("_f", fields(F.col("line"), sep))
    return rows.select(
        *scrape_columns(df), "seq", *[F.get("_f", F.lit(i)).alias(n) for n, i in columns.items()]
    )


def _cells(line: Column) -> Column:
    """Comma-separated cells; quoted ones may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    quoted = F.transform(
        raw,
        lambda c: F.when(
            c.startswith('"'), F.replace(F.regexp_extract(c, r'(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def extract_csv(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """CSV payload with a header line: one row per non-blank cell.

    `ids` columns repeat on every row of their line; the other cells become
    (name, value_raw). A comment sign before the header is ignored.
    """
    keep = scrape_columns(df)
    split = split_lines(PAYLOAD)
    header = _cells(F.regexp_replace(F.get(split, F.lit(0)), r"^#\s*", ""))
    rows = df.select(*keep, header.alias("_header"), F.posexplode(split).alias("_row", "line"))
    rows = rows.filter((F.col("_row") > 0) & (F.trim("line") != ""))
    rows = rows.select(
        *keep, F.col("_row").cast("bigint").alias("row"), "_header", _cells(F.col("line")).alias("_cells")
    )
    rows = rows.select(
        *keep,
        "row",
        *[F.get("_cells", F.array_position("_header", i).cast("int") - 1).alias(i) for i in ids],
        # Short lines pair up with the leading names, extra cells have no name.
        F.posexplode(F.arrays_zip(F.col("_header").alias("name"), F.col("_cells").alias("value"))).alias("_pos", "_p"),
    )
    rows = rows.select(
        *keep, "row", *ids, F.col("_pos").cast("bigint").alias("seq"),
        F.col("_p.name").alias("name"), F.col("_p.value").alias("value_raw"),
    )
    # A missing or empty name, or a blank cell, is no sample.
    rows = rows.filter((F.col("name") != "") & (F.trim("value_raw") != ""))
    if ids:
        rows = rows.filter(~F.col("name").isin(*ids))
    return finish(rows, [*keep, "row", *ids])


def extract_script_lines(df: DataFrame) -> DataFrame:
    """Plug-in output `name value type style`; `stack` is a gauge, `rate` goes to the rate operator."""
    keep = scrape_columns(df)
    f = F.split(F.trim("line"), " ")
    style = F.get(f, F.lit(3))
    rows = lines(df).select(
        *keep,
        "seq",
        F.get(f, F.lit(0)).alias("name"),
        F.get(f, F.lit(1)).alias("value_raw"),
        F.get(f, F.lit(2)).alias("type"),
        F.when(style == "stack", "gauge").when(style == "rate", "rate").alias("style"),
    )
    return finish(rows.filter(F.col("style").isNotNull()), [*keep, "type", "style"])
