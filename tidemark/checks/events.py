"""Health events of checks, from the same derived rows as their samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed_text
from tidemark.operators.health import COUNTER_CRIT, COUNTER_WARN, OK, band, state_level, status_of

EVENT = "event"  # style of rows that feed events only and are no samples
MESSAGE = "message"  # tag of a state row: the text of its event
ENTITY = "{entity}"


@dataclass(frozen=True)
class Health:
    """What becomes of one name as an event.

    `band`: thresholds of the metric, message `STATUS: text value after`. `state`: a state name in
    the raw value, message in the row's tag. `counter`: fixed thresholds for errors. `tag` is the
    tag with the entity that `{entity}` in module and text stands for.
    """

    metric: str
    module: str
    kind: str = "band"
    text: str = ""
    after: str = " percent"
    tag: str | None = None
    emit_ok: bool = False
    reaction: int = 0


def check_events(rows: DataFrame, rules: Sequence[Health], thresholds: DataFrame) -> DataFrame:
    """Events of all rules in one pass over derived rows.

    Rows without a rule, and bands without an enabled threshold, give none; an OK band gives one only
    where the rule or its threshold row says so.
    """
    columns = ("module", "kind", "text", "after", "tag", "emit_ok", "reaction")
    known = F.create_map(*[
        x for r in rules
        for x in (F.lit(r.metric), F.struct(*[F.lit(getattr(r, c)).cast("string" if c == "tag" else type_).alias(c)
                                             for c, type_ in zip(columns, ("string",) * 5 + ("boolean", "int"))]))
    ])
    limits = thresholds.filter("enabled").select(F.col("metric").alias("_metric"), "warn", "crit", F.col("emit_ok").alias("_show"))
    found = rows.filter(F.col("name").isin(*[r.metric for r in rules])).withColumn("_rule", known[F.col("name")])
    # By shuffle, all rows of one name would meet in one task.
    found = found.join(F.broadcast(limits), F.col("name") == F.col("_metric"), "left")
    kind, value = F.col("_rule.kind"), F.col("value")
    level = (
        F.when(kind == "band", band(value, F.col("warn"), F.col("crit")))
        .when(kind == "state", state_level(F.col("value_raw")))
        .when(kind == "counter", band(value, F.lit(COUNTER_WARN), F.lit(COUNTER_CRIT)))
    )
    found = found.withColumn("_level", level).filter(F.col("_level").isNotNull())
    show = (kind == "state") | F.col("_rule.emit_ok") | F.coalesce("_show", F.lit(False))
    found = found.filter((F.col("_level") != OK) | show)
    entity = F.coalesce(F.try_element_at("tags", F.col("_rule.tag")), F.lit(""))

    def named(text: str) -> Column:
        return F.replace(F.col(f"_rule.{text}"), F.lit(ENTITY), entity)

    status = status_of(F.col("_level"))
    counted = F.concat(F.when(F.col("_level") == 16, "Critical : corrupted with ").otherwise("Warning : may be corrupted with "),
                       F.col("value_raw"), F.lit(" IO Errors on "), F.coalesce(F.nullif(entity, F.lit("")), F.col("name")))
    message = (
        F.when(kind == "state", F.coalesce(F.try_element_at("tags", F.lit(MESSAGE)), F.col("value_raw")))
        .when(kind == "counter", counted)
        .otherwise(F.concat(status, F.lit(": "), named("text"), F.lit(" "), fixed_text(value), F.col("_rule.after")))
    )
    return found.select(
        "host", named("module").alias("module"), "ts_s", F.col("_level").alias("value"), status.alias("status"),
        message.alias("message"), F.col("_rule.reaction").alias("reaction"),
    )
