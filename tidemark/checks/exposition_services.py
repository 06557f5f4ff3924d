"""Checks over exposition text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.registry import Check, register
from tidemark.operators.aggregates import histogram_quantile, mean_latency, sum_over
from tidemark.operators.filters import any_of
from tidemark.sources.base import scrape_columns
from tidemark.sources.exposition import buckets, extract_exposition
from tidemark.sources.opened import EXPOSITION

# Names and substrings each service is read by.
SUMMARY_WORDS = ("sum", "count", "process")
PROXY_RATES = ("requests_by_method_total", "requests_total", "responses_total", "requests_by_version_total")
PROXY_HISTOGRAMS = ("request_latency_seconds", "response_latency_seconds")
COTURN_WORDS = (
    "turn_traffic_sentb", "turn_traffic_peer_sentb", "turn_total_traffic_rcvb", "turn_total_traffic_peer_sentb",
    "process_open_fds", "turn_traffic_peer_sentp", "turn_total_traffic_sentb", "turn_traffic_rcvp",
    "turn_traffic_peer_rcvb", "stun_binding_request", "turn_total_traffic_rcvp", "process_virtual_memory_bytes",
)
COTURN_GAUGES = ("process_open_fds", "process_virtual_memory_bytes")
KUBE_TAGS = (
    ("kube_pod_container", ("container", "pod"), -3),
    ("kube_deployment", ("deployment",), 0),
    ("kube_endpoint_address", ("endpoint",), 0),
)
KUBE_WORDS = (
    "kube_deployment_status_replicas", "kube_endpoint_address_available",
    "kube_pod_container_status_waiting", "kube_pod_container_resource_limits_memory_bytes",
    "kube_pod_container_resource_limits_cpu_cores",
)
ENVOY_WORDS = ("downstream_cx_", "downstream_flow_control_", "downstream_rq_", "rs_too_large")
SCYLLA_SUMMED = (
    "scylla_cql_inserts", "scylla_cql_reads", "scylla_cql_deletes", "scylla_cql_updates", "scylla_cql_batches",
    "scylla_cache_row_hits", "scylla_cache_row_misses", "scylla_transport_requests_served",
)
SCYLLA_GAUGES = (
    "scylla_node_operation_mode", "scylla_reactor_utilization",
    "scylla_storage_proxy_coordinator_read_timeouts", "scylla_storage_proxy_coordinator_write_timeouts",
    "scylla_cache_bytes_total", "scylla_cache_bytes_used", "scylla_cache_concurrent_misses_same_key",
    "scylla_sstables_row_reads", "scylla_sstables_range_partition_reads",
    "scylla_sstables_range_tombstone_writes", "scylla_sstables_row_writes",
    "scylla_sstables_single_partition_reads", "scylla_sstables_sstable_partition_reads",
    "scylla_sstables_static_row_writes", "scylla_sstables_tombstone_writes",
    "scylla_transport_current_connections", "scylla_cql_statements_in_batches",
)


def _prefixed(prefix: str) -> Column:
    name = F.col("name")
    return F.when(name.startswith(prefix), name).otherwise(F.concat(F.lit(prefix), name))


def _rated(df: DataFrame, cond: Column) -> DataFrame:
    return df.withColumn("style", F.when(cond, "rate").otherwise("gauge")).withColumn(
        "chart_type", F.when(cond, "Rate")
    )


def proxy_requests(df: DataFrame, prefix: str) -> DataFrame:
    """Request counters rated, other values as they are; the buckets are left to `proxy_latency`."""
    rows = extract_exposition(df).filter(~F.col("name").isin(*[f"{prefix}_{h}_bucket" for h in PROXY_HISTOGRAMS]))
    rows = _rated(rows, F.col("name").isin(*[f"{prefix}_{r}" for r in PROXY_RATES]))
    cut = F.replace("name", F.lit("_total"), F.lit(""))
    return rows.withColumn("name", F.when(F.col("style") == "rate", cut).otherwise(F.col("name")))


def proxy_latency(df: DataFrame, prefix: str) -> DataFrame:
    """Latency quantiles per scrape, tag `percentile`."""
    keep = scrape_columns(df)
    rows = buckets(extract_exposition(df)).filter(F.col("name").isin(*[f"{prefix}_{h}" for h in PROXY_HISTOGRAMS]))
    found = histogram_quantile(rows, (*keep, "name"))
    return found.select(
        *keep,
        F.lit(0).cast("bigint").alias("seq"),
        F.replace("name", F.lit("_seconds"), F.lit("")).alias("name"),
        F.create_map(F.lit("percentile"), F.round(F.col("q") * 100).cast("int").cast("string")).alias("tags"),
        F.col("value").cast("string").alias("value_raw"),
        "value",
        F.lit("float").alias("value_kind"),
    )


def proxy_checks(source: str, prefix: str) -> list[Check]:
    """The two checks of a proxy that exports request counters and latency histograms under a prefix."""
    return [
        Check(source, partial(proxy_requests, prefix=prefix), (), source, form=EXPOSITION),
        Check(source, partial(proxy_latency, prefix=prefix), (), source, form=EXPOSITION),
    ]


def coredns(df: DataFrame) -> DataFrame:
    """Bare lines only."""
    rows = extract_exposition(df).filter(F.size("tags") == 0)
    return rows.withColumn("name", _prefixed("coredns_"))


def etcd(df: DataFrame) -> DataFrame:
    """Sums, counts and process values."""
    rows = extract_exposition(df).filter(any_of(F.col("name"), SUMMARY_WORDS))
    return rows.withColumn("name", _prefixed("etcd_"))


def envoy(df: DataFrame) -> DataFrame:
    name = F.col("name")
    admin = F.exists(F.map_values("tags"), lambda v: v.contains("admin"))
    return extract_exposition(df).filter(
        name.startswith("envoy_") & any_of(name, ENVOY_WORDS) & ~name.contains("_bucket") & ~name.contains("admin") & ~admin
    )


def coturn(df: DataFrame) -> DataFrame:
    rows = extract_exposition(df).filter(any_of(F.col("name"), COTURN_WORDS))
    rows = _rated(rows, ~F.col("name").isin(*COTURN_GAUGES))
    return rows.withColumn("name", F.concat(F.lit("coturn_"), F.col("name")))


def kube_state(df: DataFrame) -> DataFrame:
    """Each family keeps its own labels."""
    rows = extract_exposition(df).filter(any_of(F.col("name"), KUBE_WORDS))
    tags, reaction = F.col("tags"), F.lit(0)
    for prefix, names, level in KUBE_TAGS:
        mine = F.col("name").startswith(prefix)
        tags = F.when(mine, _keep(names)).otherwise(tags)
        reaction = F.when(mine, F.lit(level)).otherwise(reaction)
    return rows.withColumn("_tags", tags).withColumn("reaction", reaction).drop("tags").withColumnRenamed("_tags", "tags")


def _keep(names: tuple[str, ...]) -> Column:
    return F.map_filter("tags", lambda k, _: k.isin(*names))


def traefik(df: DataFrame) -> DataFrame:
    """Service values named by protocol, tag `status_code`; others under the prefix."""
    rows = extract_exposition(df).filter(any_of(F.col("name"), SUMMARY_WORDS))
    own = F.col("name").startswith("traefik_")
    protocol = F.coalesce(F.try_element_at("tags", F.lit("protocol")), F.lit("request"))
    named = F.when(own, F.replace("name", F.lit("request"), protocol)).otherwise(F.concat(F.lit("traefik_"), "name"))
    rows = rows.withColumn("_name", named).withColumn("reaction", F.when(own, -3).otherwise(0))
    code = F.when(
        own & F.map_contains_key("tags", "code"), F.create_map(F.lit("status_code"), F.col("tags")["code"])
    ).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn("_tags", code).drop("name", "tags").withColumnsRenamed({"_name": "name", "_tags": "tags"})


def _as_samples(df: DataFrame, keep: list[str], value: str, style: str) -> DataFrame:
    return df.select(
        *keep,
        F.lit(0).cast("bigint").alias("seq"),
        "name",
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
        F.col(value).cast("string").alias("value_raw"),
        F.col(value).cast("double").alias("value"),
        F.when(F.col(value) == F.floor(value), "int").otherwise("float").alias("value_kind"),
        F.lit(style).alias("style"),
    )


def _summed(df: DataFrame, names: tuple[str, ...], style: str, keep_label: str | None = None, out_label: str | None = None) -> DataFrame:
    """Sums per metric and scrape over all labels, or all but one; counters as integers."""
    keep = scrape_columns(df)
    rows = extract_exposition(df).filter(F.col("name").isin(*names))
    total = sum_over(rows, [*keep, "name"], "value", [keep_label] if keep_label else [])
    tags = F.lit(None).cast("map<string,string>")
    if keep_label:
        tags = F.when(F.col(keep_label).isNotNull(), F.create_map(F.lit(out_label), F.col(keep_label)))
    total = total.withColumn("tags", tags)
    if style.startswith("rate"):
        total = total.withColumn("total", F.col("total").cast("bigint"))
    return _as_samples(total, keep, "total", style)


def scylla_commands(df: DataFrame) -> DataFrame:
    """Command counters summed over shards, then rated."""
    return _summed(df, SCYLLA_SUMMED, "rate_int")


def scylla_gauges(df: DataFrame) -> DataFrame:
    """Other values summed over shards, per scheduling group where there is one."""
    return _summed(df, SCYLLA_GAUGES, "gauge", "scheduling_group_name", "scheduling_group")


def scylla_latency(df: DataFrame) -> DataFrame:
    """Mean read and write latency per scheduling group."""
    keep = scrape_columns(df)
    rows = extract_exposition(df).withColumn("group", F.try_element_at("tags", F.lit("scheduling_group_name")))
    kind = F.regexp_extract("name", "coordinator_(read|write)_latency_(?:sum|count)$", 1)
    rows = rows.withColumn("_kind", kind).filter(F.col("_kind") != "")
    part = F.when(F.col("name").endswith("_sum"), "sum").otherwise("count")
    rows = rows.withColumn("part", part)
    means = mean_latency(rows, [*keep, "group", "_kind"], "sum", "count", name="part")
    named = means.withColumn("name", F.concat(F.lit("scylla_storage_proxy_coordinator_"), "_kind", F.lit("_latency")))
    named = named.withColumn("tags", F.when(F.col("group").isNotNull(), F.create_map(F.lit("scheduling_group"), F.col("group"))))
    return _as_samples(named, keep, "mean", "gauge")


def traefik_total(df: DataFrame) -> DataFrame:
    """Service requests summed over all labels, then rated."""
    total = _summed(df, ("traefik_service_requests_total",), "rate")
    return total.withColumn("name", F.lit("traefik_totalrequests"))


for _name, _source, _fn, _type in (
    ("coredns", "coredns", coredns, "coredns"),
    ("etcd", "etcd", etcd, "etcd"),
    ("envoy", "envoy", envoy, "envoy"),
    ("coturn", "coturn", coturn, "coturn"),
    ("kube_state_metrics", "kube_state_metrics", kube_state, "kube-state-metrics"),
    ("traefik", "traefik", traefik, "traefik"),
    ("traefik_total", "traefik", traefik_total, "traefik"),
    ("scylla_commands", "scylla", scylla_commands, "scylladb"),
    ("scylla_gauges", "scylla", scylla_gauges, "scylladb"),
    ("scylla_latency", "scylla", scylla_latency, "scylladb"),
):
    register(_name, Check(_source, _fn, (), _type, form=EXPOSITION))

for _name, _check in zip(("proxy_requests", "proxy_latency"), proxy_checks("proxy", "proxy")):
    register(_name, _check)
