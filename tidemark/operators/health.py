"""Health events from thresholds, states, exit codes and heartbeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed_text
from tidemark.functions.text import clean_message
from tidemark.operators.joins import with_thresholds

# Health levels, state names and message forms.
OK, WARN, STATE_WARN, ERROR = 0, 8, 9, 16
OK_STATES = ("green", "HEALTH_OK")
WARN_STATES = ("yellow", "HEALTH_WARN")
WEB_STATUS = {0: "OK", 1: "WARNING"}
WEB_STATUS_OTHER = "CRITICAL"
COUNTER_WARN, COUNTER_CRIT = 2, 5
HEARTBEAT_MODULE = "HeartBeat"
HEARTBEAT_MESSAGE = "{DURATION} without HearBeats from host"

EVENT_COLUMNS = ("host", "module", "ts_s", "value", "status", "message", "reaction")


def status_of(level: Column) -> Column:
    return (
        F.when(level == OK, "OK").when(level.isin(WARN, STATE_WARN), "WARNING").otherwise("ERROR")
    )


def band(value: Column, warn: Column, crit: Column) -> Column:
    """0 below warn, 8 from warn, 16 from crit; NULL without thresholds."""
    known = value.isNotNull() & warn.isNotNull() & crit.isNotNull()
    return F.when(
        known, F.when(value >= crit, ERROR).when(value >= warn, WARN).otherwise(OK)
    ).cast("int")


def threshold_health(
    df: DataFrame,
    thresholds: DataFrame,
    label: str = "is at",
    emit_ok: bool | None = None,
    name: str = "name",
    value: str = "value",
    reaction: int = 0,
) -> DataFrame:
    """Threshold bands per metric as health events.

    OK events appear where the threshold row says `emit_ok` (or always/never
    with the argument).
    """
    joined = with_thresholds(df, thresholds, name)
    level = band(F.col(value), F.col("warn"), F.col("crit"))
    joined = joined.withColumn("_level", level).filter(F.col("_level").isNotNull())
    show_ok = F.coalesce(F.col("emit_ok"), F.lit(False)) if emit_ok is None else F.lit(emit_ok)
    status = status_of(F.col("_level"))
    text = fixed_text(F.col(value))
    message = F.concat(status, F.lit(": "), F.col(name), F.lit(f" {label} "), text, F.lit(" percent"))
    return joined.filter((F.col("_level") != OK) | show_ok).select(
        "host",
        F.col(name).alias("module"),
        "ts_s",
        F.col("_level").alias("value"),
        status.alias("status"),
        message.alias("message"),
        F.lit(reaction).alias("reaction"),
    )


def state_level(state: Column) -> Column:
    return (
        F.when(state.isin(*OK_STATES), OK)
        .when(state.isin(*WARN_STATES), STATE_WARN)
        .otherwise(ERROR)
        .cast("int")
    )


def state_health(
    df: DataFrame, module: Column, state: str = "state", message: Column | None = None, reaction: int = 0
) -> DataFrame:
    """State names as health events: 0 OK, 9 WARNING, 16 ERROR."""
    level = state_level(F.col(state))
    return df.select(
        "host",
        module.alias("module"),
        "ts_s",
        level.alias("value"),
        status_of(level).alias("status"),
        (F.col(state) if message is None else message).alias("message"),
        F.lit(reaction).alias("reaction"),
    )


def exit_code_health(
    results: DataFrame, web: bool = False, code: str = "exit_code", output: str = "output"
) -> DataFrame:
    """Plug-in results as health events.

    Agent form: 0/8/16 with OK/WARNING/ERROR and a cleaned message. Web form:
    OK/WARNING/CRITICAL with only line breaks removed.
    """
    c = F.col(code)
    level = F.when(c == 0, OK).when(c == 1, WARN).otherwise(ERROR).cast("int")
    if web:
        status = F.when(c == 0, WEB_STATUS[0]).when(c == 1, WEB_STATUS[1]).otherwise(WEB_STATUS_OTHER)
        message = F.replace(F.col(output), F.lit("\n"), F.lit(""))
    else:
        status = status_of(level)
        message = clean_message(F.col(output))
    return results.select(
        "host",
        F.col("plugin").alias("module"),
        "ts_s",
        level.alias("value"),
        status.alias("status"),
        message.alias("message"),
        F.lit(0).alias("reaction"),
    )


def counter_health(
    df: DataFrame, module: Column, entity: str, value: str = "value",
    warn: int = COUNTER_WARN, crit: int = COUNTER_CRIT,
) -> DataFrame:
    """Error counters per device: WARNING from `warn`, ERROR from `crit`, nothing below."""
    level = band(F.col(value), F.lit(warn), F.lit(crit))
    rows = df.withColumn("_level", level).filter(F.col("_level") > OK)
    head = F.when(F.col("_level") == ERROR, "Critical : corrupted with ").otherwise(
        "Warning : may be corrupted with "
    )
    message = F.concat(head, F.col(value).cast("string"), F.lit(" IO Errors on "), F.col(entity))
    return rows.select(
        "host",
        module.alias("module"),
        "ts_s",
        F.col("_level").alias("value"),
        status_of(F.col("_level")).alias("status"),
        message.alias("message"),
        F.lit(0).alias("reaction"),
    )


def heartbeats(df: DataFrame, keys: Sequence[str] = ("host", "scrape_id")) -> DataFrame:
    """One alive event per host and cycle, carrying the response time if the frame has one."""
    took = F.max("response_s") if "response_s" in df.columns else F.lit(None).cast("double")
    return (
        df.groupBy(*keys)
        .agg(F.max("ts_s").alias("ts_s"), took.alias("response_s"))
        .select(
            "host",
            F.lit(HEARTBEAT_MODULE).alias("module"),
            "ts_s",
            F.lit(OK).alias("value"),
            F.lit("OK").alias("status"),
            F.lit(HEARTBEAT_MESSAGE).alias("message"),
            F.lit(0).alias("reaction"),
            "response_s",
        )
    )


def last_seen(df: DataFrame, now: Column) -> DataFrame:
    """Seconds of silence per host."""
    return (
        df.groupBy("host")
        .agg(F.max("ts_s").alias("last_seen"))
        .withColumn("silent_s", now - F.col("last_seen"))
    )
