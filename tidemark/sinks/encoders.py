"""Samples to encoded points. Each encoder is a projection; nothing is posted.

Input: samples with `all_tags` from `with_identity` (host, type, cluster, group,
location and the sample's own tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import int_text

# The identity tags in line order, the metric types of exposition text.
LINE_TAGS = ("host", "cluster", "group", "location", "type")
PATH_TAGS = ("cluster", "group", "host", "location", "type")
EXPOSITION_TYPES = ("gauge", "counter", "histogram", "summary")
HELP_TEXT = "Metrics provided by the fleet telemetry engine."


def plain_number(x: Column) -> Column:
    """A double as text without an exponent, down to 18 decimal places and below 1e37."""
    text = x.cast("string")
    small = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    large = text.try_cast("decimal(38,0)").cast("string")
    moved = F.when(F.abs(x) >= 1e19, large).when(F.abs(x) >= 1e-18, small)
    return F.when(text.contains("E"), F.coalesce(moved, text)).otherwise(text)


def number_text(df: DataFrame) -> Column:
    """Value as text: integers without a fraction, unparsable text as it came."""
    whole = int_text(F.col("value_raw")).cast("string")
    number = plain_number(F.col("value"))
    return (
        F.when(F.col("value_kind") == "int", F.coalesce(whole, number))
        .when(F.col("value").isNotNull(), number)
        .otherwise(F.col("value_raw"))
    )


def _json_value() -> Column:
    """Value as JSON: integer, number or text."""
    return (
        F.when(F.col("value_kind") == "int", int_text(F.col("value_raw")).cast("variant"))
        .when(F.col("value").isNotNull(), F.col("value").cast("variant"))
        .otherwise(F.col("value_raw").cast("variant"))
    )


def _tag(name: str) -> Column:
    return F.try_element_at("all_tags", F.lit(name))


def _own_tags() -> Column:
    """The sample's extra tags: everything beyond the identity tags, by key."""
    extra = F.map_filter("all_tags", lambda k, _: ~k.isin(*LINE_TAGS))
    return F.array_sort(F.map_entries(extra))


def _sorted_tags() -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries("all_tags")))


def to_kairos(df: DataFrame) -> DataFrame:
    """KairosDB points: milliseconds, one JSON object per row."""
    point = F.struct(
        F.col("name"), (F.col("ts_s") * 1000).alias("timestamp"), _json_value().alias("value"),
        _sorted_tags().alias("tags"),
    )
    return df.select(F.to_json(point).alias("line"))


def to_opentsdb(df: DataFrame) -> DataFrame:
    """OpenTSDB points: seconds, one JSON object per row."""
    point = F.struct(
        F.col("name").alias("metric"), F.col("ts_s").alias("timestamp"), _json_value().alias("value"),
        _sorted_tags().alias("tags"),
    )
    return df.select(F.to_json(point).alias("line"))


def _one_line(text: Column) -> Column:
    """Backslashes doubled and line breaks written out, so that a point stays one line."""
    for sign, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def _line_escape(text: Column, signs: str = ",= ") -> Column:
    text = _one_line(text)
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return text


def to_influx(df: DataFrame) -> DataFrame:
    """Influx lines: escaped tags, `i` after integers, text quoted, sample time in nanoseconds.

    Infinite and undefined values give no line, as the protocol has no form for them.
    """
    fixed_tags = [
        F.when(_tag(t).isNotNull(), F.concat(F.lit(f"{t}="), _line_escape(_tag(t)))) for t in LINE_TAGS
    ]
    own = F.transform(
        _own_tags(),
        lambda e: F.concat(_line_escape(e["key"]), F.lit("="), _line_escape(e["value"])),
    )
    own = F.array_join(F.filter(own, lambda t: ~t.endswith("=")), ",")
    series = F.concat_ws(
        ",", _line_escape(F.col("name"), ", "), *fixed_tags, F.when(own != "", own)
    )
    text = number_text(df)
    quoted = F.concat(F.lit('"'), F.replace(_one_line(text), F.lit('"'), F.lit('\\"')), F.lit('"'))
    value = (
        F.when(F.col("value_kind") == "int", F.concat(text, F.lit("i")))
        .when(F.col("value").isNotNull(), text)
        .otherwise(quoted)
    )
    nanos = (F.col("ts_s") * 1_000_000_000).cast("string")
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    return df.filter(text.isNotNull() & ~F.coalesce(odd, F.lit(False))).select(
        F.concat(series, F.lit(" value="), value, F.lit(" "), nanos).alias("line")
    )


def to_graphite(df: DataFrame) -> DataFrame:
    """Graphite plaintext: `cluster.group.host.location.type[.tag values].name value ts`."""
    parts = [
        F.replace(_tag(t), F.lit("."), F.lit("_")) if t == "host" else _tag(t) for t in PATH_TAGS
    ]
    own = F.array_join(F.transform(_own_tags(), lambda e: e["value"]), ".")
    path = F.concat_ws(".", *parts, F.when(own != "", own), F.col("name"))
    path = F.regexp_replace(path, r"\s", "_")
    text = number_text(df)
    return df.filter(text.isNotNull()).select(
        F.concat_ws(" ", path, text, F.col("ts_s").cast("string")).alias("line")
    )


def to_prometheus(df: DataFrame) -> DataFrame:
    """Exposition lines: (type, name, part, line); part 0 HELP, 1 TYPE, 2 samples.

    Ordered by those columns the lines form a valid page: each metric once,
    headers first. No metric is collected into one row.
    """
    kind = F.when(F.col("check_type").isin(*EXPOSITION_TYPES), F.col("check_type")).otherwise("untyped")
    labels = F.transform(
        F.array_sort(F.map_entries(F.map_filter("all_tags", lambda k, _: k != "type"))),
        lambda e: F.concat(e["key"], F.lit('="'), _label_escape(e["value"]), F.lit('"')),
    )
    sample = F.concat(
        F.col("name"), F.lit("{"), F.array_join(labels, ","), F.lit("} "), F.col("value").cast("string")
    )
    samples = df.filter(F.col("value").isNotNull()).select(
        kind.alias("type"), "name", F.lit(2).alias("part"), sample.alias("line")
    )
    heads = samples.groupBy("type", "name").agg(F.lit(0).alias("_")).select(
        "type",
        "name",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), "name", F.lit(f" {HELP_TEXT}")).alias("line")),
                F.struct(F.lit(1).alias("part"), F.concat_ws(" ", F.lit("# TYPE"), "name", "type").alias("line")),
            )
        ).alias("_h"),
    ).select("type", "name", "_h.part", "_h.line")
    return heads.unionByName(samples)


def _label_escape(v: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return v


def write_lines(encoded: DataFrame, path: str, mode: str = "append") -> None:
    """Encoded points as text files."""
    encoded.select("line").write.mode(mode).text(path)


def write_prometheus(encoded: DataFrame, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Exposition pages as text files whose order is the page order; a hot metric spans files."""
    order = ["type", "name", "part", "line"]
    ranged = encoded.repartitionByRange(partitions, *order) if partitions else encoded.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("line").write.mode(mode).text(path)
