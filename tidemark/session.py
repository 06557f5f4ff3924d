"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    # Epoch arithmetic and the tests assume UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated label or tag keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Runtime re-planning: merges small shuffle partitions, splits hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
