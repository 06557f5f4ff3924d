"""Checks over JSON documents, named stats and status tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.events import EVENT, MESSAGE, Health
from tidemark.checks.registry import Check, as_samples, register
from tidemark.functions.numbers import fixed, ratio
from tidemark.functions.text import percent_from_text, replace_chain
from tidemark.operators.filters import allow_or_all
from tidemark.operators.resume import SeriesState
from tidemark.operators.sets import union_sources
from tidemark.operators.windows import changed, delta_ratio
from tidemark.sources.base import DOCUMENT, document, finish, scrape_columns
from tidemark.sources.documents import Path, extract_named_arrays, extract_paths, plain_stat_name
from tidemark.sources.opened import JSON_TEXT, PARSED

# Names read from each service.
VARNISH_RATES = ("MAIN.sess_conn", "MAIN.client_req", "MAIN.cache_hit", "MAIN.cache_miss", "MAIN.cache_hitpass")
VARNISH_GAUGES = (
    "MAIN.threads", "MAIN.threads_created", "MAIN.threads_failed", "MAIN.threads_limited",
    "MAIN.thread_queue_len", "MAIN.sess_queued", "MAIN.backend_conn", "MAIN.backend_recycle",
    "MAIN.backend_reuse", "MAIN.backend_toolate", "MAIN.backend_fail", "MAIN.backend_unhealthy",
    "MAIN.backend_busy", "MAIN.backend_req", "MAIN.n_expired", "MAIN.n_lru_nuked", "MAIN.sess_dropped",
)
TWEMPROXY_RATES = ("requests", "request_bytes", "responses", "response_bytes")
TWEMPROXY_GAUGES = ("in_queue", "in_queue_bytes", "server_connections")
RIAK_PER_MINUTE = ("node_gets", "node_puts", "vnode_gets", "vnode_puts")
RIAK_GAUGES = (
    "sys_process_count", "memory_processes", "memory_processes_used", "mem_allocated", "read_repairs",
    "vnode_set_update",
)
COUCHDB_SECTIONS = {
    "couchdb": (
        "auth_cache_misses", "database_writes", "open_databases", "auth_cache_hits", "request_time",
        "database_reads", "open_os_files",
    ),
    "httpd_request_methods": ("GET", "PUT", "COPY", "DELETE", "POST", "HEAD"),
    "httpd_status_codes": (
        "200", "201", "202", "301", "304", "400", "401", "403", "404", "405", "409", "412", "500",
    ),
    "httpd": ("clients_requesting_changes", "temporary_view_reads", "requests", "bulk_requests", "view_reads"),
}
MESOS_MASTER = (
    "master/cpus_percent", "master/cpus_revocable_percent", "master/cpus_used", "master/disk_percent",
    "master/disk_revocable_percent", "master/disk_used", "master/event_queue_dispatches",
    "master/event_queue_http_requests", "master/event_queue_messages", "master/frameworks_active",
    "master/gpus_percent", "master/gpus_used", "master/mem_percent", "master/mem_used",
    "master/tasks_dropped", "master/tasks_error", "master/tasks_failed", "master/tasks_finished",
    "master/tasks_gone", "master/tasks_lost", "master/tasks_running", "master/tasks_staging",
    "master/tasks_starting", "master/tasks_unreachable", "master/messages_kill_task",
    "master/messages_reregister_framework", "master/slaves_connected", "allocator/mesos/allocation_run_ms",
    "allocator/mesos/allocation_run_ms/p99", "registrar/state_fetch_ms", "registrar/state_store_ms/p99",
)
MESOS_SLAVE = (
    "slave/executors_terminated", "slave/cpus_percent", "slave/executors_running",
    "slave/gpus_revocable_used", "slave/invalid_status_updates", "slave/cpus_used", "slave/disk_used",
    "slave/gpus_used", "slave/mem_percent", "slave/tasks_running", "slave/frameworks_active",
    "slave/mem_revocable_percent", "slave/tasks_failed", "slave/executors_terminating",
    "slave/tasks_killing", "slave/disk_percent", "slave/tasks_lost", "slave/recovery_errors",
    "slave/mem_used", "slave/cpus_revocable_used",
)
SOLR_REQUESTS = ("delete", "get", "head", "move", "options", "other", "put", "trace")
SOLR_RESPONSES = ("1xx", "2xx", "3xx", "4xx", "5xx")
SOLR_HEAP = ("committed", "init", "max", "used")
SOLR_HANDLER = "org.eclipse.jetty.server.handler.DefaultHandler."
RABBIT_RATES = ("publish", "ack", "deliver_get", "redeliver", "deliver")
RABBIT_TOTALS = ("messages", "messages_ready", "messages_unacknowledged")
CONSUL_GAUGES = (
    "consul.runtime.alloc_bytes", "consul.runtime.free_count", "consul.runtime.heap_objects",
    "consul.runtime.malloc_count", "consul.runtime.num_goroutines", "consul.runtime.sys_bytes",
    "consul.runtime.total_gc_pause_ns", "consul.runtime.total_gc_runs", "consul.session_ttl.active",
)
NOMAD_GAUGES = (
    "nomad.client.allocations.running", "nomad.client.allocations.blocked",
    "nomad.client.allocations.pending", "nomad.client.unallocated.cpu", "nomad.client.allocated.cpu",
    "nomad.client.allocated.memory", "nomad.client.unallocated.memory", "nomad.client.allocated.disk",
    "nomad.client.unallocated.disk", "nomad.client.allocated.network", "nomad.client.unallocated.network",
    "nomad.runtime.num_goroutines", "nomad.runtime.alloc_bytes", "nomad.runtime.heap_objects",
)
NOMAD_JOBS = (
    "nomad.nomad.job_summary.queued", "nomad.nomad.job_summary.complete", "nomad.nomad.job_summary.failed",
    "nomad.nomad.job_summary.running", "nomad.nomad.job_summary.starting", "nomad.nomad.job_summary.lost",
)
NOMAD_HEARTBEAT = "nomad.nomad.heartbeat.active"
MONGO_SECTIONS = (
    ("$.metrics.document", "mongo_document_", "rate"), ("$.metrics.operation", "mongo_operation_", "rate"),
    ("$.opcounters", "mongo_opcounters_", "rate"), ("$.connections", "mongo_connections_", "gauge"),
)
COUCHDB2_OPS = ("database_writes", "database_reads", "document_inserts", "document_writes")
COUCHDB2_HTTPD = ("bulk_requests", "requests", "temporary_view_reads", "view_reads")
FDB_WORKLOADS = ("bytes", "keys", "operations", "transactions")
FDB_OPERATIONS = ("read", "written", "read_requests", "reads", "writes", "committed", "conflicted", "started")
FDB_MEMORY = ("committed_bytes", "free_bytes", "total_bytes")
FDB_GAUGES = (
    ("data.partitions_count", "partitions_count"),
    ("data.average_partition_size_bytes", "partitions_size_avg"),
    ("data.least_operating_space_bytes_log_server", "least_operating_space_bytes_log_server"),
    ("data.least_operating_space_bytes_storage_server", "least_operating_space_bytes_storage_server"),
    ("latency_probe.commit_seconds", "latency_commit_seconds"),
    ("latency_probe.read_seconds", "latency_read_seconds"),
    ("clients.count", "connected_clients"),
    ("data.total_disk_used_bytes", "total_disk_used_bytes"),
    ("data.total_kv_size_bytes", "total_kv_size_bytes"),
    ("qos.worst_queue_bytes_log_server", "worst_queue_bytes_log_server"),
    ("qos.worst_queue_bytes_storage_server", "worst_queue_bytes_storage_server"),
)
MARATHON_GAUGES = (
    "marathon.apps.active.gauge", "marathon.deployments.active.gauge", "marathon.instances.running.gauge",
    "marathon.instances.launch-overdue.gauge", "marathon.pods.active.gauge",
    "marathon.http.requests.active.gauge", "marathon.groups.active.gauge",
    "marathon.http.event-streams.active.gauge", "marathon.instances.staged.gauge",
    "marathon.jvm.memory.heap.committed.gauge.bytes", "marathon.jvm.memory.heap.used.gauge.bytes",
    "marathon.jvm.memory.non-heap.committed.gauge.bytes", "marathon.jvm.memory.non-heap.used.gauge.bytes",
)
CHRONOS_GAUGES = (
    "jvm.memory.heap.committed", "jvm.memory.heap.used", "jvm.memory.non-heap.committed",
    "jvm.memory.non-heap.used", "jvm.threads.count", "jvm.threads.daemon.count", "jvm.threads.new.count",
    "jvm.threads.runnable.count",
)
COUCHBASE_NODE = (
    "cmd_get", "couch_docs_data_size", "curr_items", "curr_items_tot", "ep_bg_fetched", "get_hits",
    "mem_used", "ops", "vb_replica_curr_items",
)
COUCHBASE_BASIC = ("quotaPercentUsed", "opsPerSec", "itemCount", "memUsed")
RABBIT_QUEUE = (
    "messages", "messages_unacknowledged", "messages_ready", "message_bytes_persistent",
    "message_bytes_ram", "messages_persistent", "messages_ram",
)


def _at(*keys: str) -> str:
    """JSON path with quoted keys, which may hold dots and slashes."""
    return "$" + "".join(f"['{k}']" for k in keys)


def _flat(names: Iterable[str], prefix: str, drop: Sequence[tuple[str, str]] = (), style: str = "gauge", tail: Sequence[str] = ()) -> list[Path]:
    """Top-level keys to paths, their names shortened by literal replacements."""
    out = []
    for key in names:
        short = key
        for old, new in drop:
            short = short.replace(old, new)
        out.append(Path(_at(key, *tail), prefix + short.lower(), style))
    return out


VARNISH = [
    *_flat(VARNISH_RATES, "varnish_", [("MAIN.", "")], "rate", ["value"]),
    *_flat(VARNISH_GAUGES, "varnish_", [("MAIN.", "")], "gauge", ["value"]),
]
RIAK = _flat([*RIAK_GAUGES, *RIAK_PER_MINUTE], "riak_")
COUCHDB = [
    Path(_at(section, key, "current"), f"couchdb_{key.lower()}", "rate")
    for section, keys in COUCHDB_SECTIONS.items()
    for key in keys
]
SOLR = [
    *[
        Path(_at("metrics", "solr.jetty", f"{SOLR_HANDLER}{r}-requests", "count"), f"solr_{r}_requests", "rate")
        for r in SOLR_REQUESTS
    ],
    Path(_at("metrics", "solr.jetty", f"{SOLR_HANDLER}requests", "count"), "solr_requests_all", "rate"),
    *[
        Path(_at("metrics", "solr.jetty", f"{SOLR_HANDLER}{r}-responses", "count"), f"solr_{r}_responses", "rate")
        for r in SOLR_RESPONSES
    ],
    *[Path(_at("metrics", "solr.jvm", f"memory.heap.{h}"), f"solr_heap_{h}") for h in SOLR_HEAP],
    *[Path(_at("metrics", "solr.jvm", f"memory.non-heap.{h}"), f"solr_non_heap_{h}") for h in SOLR_HEAP],
    Path(_at("metrics", "solr.jvm", "threads.count"), "solr_threads"),
    Path(_at("metrics", "solr.jvm", "threads.daemon.count"), "solr_threads_daemon"),
]
RABBIT = [
    *[Path(_at("message_stats", f"{s}_details", "rate"), f"rabbitmq_{s}_rate") for s in RABBIT_RATES],
    *[Path(_at("queue_totals", t), f"rabbitmq_{t}") for t in RABBIT_TOTALS],
]
ELASTIC_NODE = [
    *[
        Path(f"$.indices.{path}", f"elasticsearch_{name}", "rate")
        for path, name in (
            ("search.query_total", "search_total"), ("indexing.index_total", "index_total"), ("indexing.delete_total", "delete_total"),
            ("refresh.total", "refresh_total"), ("get.total", "get_total"), ("search.fetch_total", "fetch_total"),
            ("search.fetch_time_in_millis", "fetch_time"), ("indexing.index_time_in_millis", "index_time"),
            ("search.query_time_in_millis", "search_search_time"), ("merges.total_time_in_millis", "merge_time"),
            ("merges.total_docs", "merge_docs"),
        )
    ],
    Path("$.jvm.mem.non_heap_committed_in_bytes", "elasticsearch_non_heap_commited"),
    Path("$.jvm.mem.non_heap_used_in_bytes", "elasticsearch_non_heap_used"),
    Path("$.process.open_file_descriptors", "elasticsearch_open_files"),
    Path("$.http.current_open", "elasticsearch_http_connections"),
    Path("$.jvm.mem.heap_committed_in_bytes", "elasticsearch_heap_commited"),
    Path("$.jvm.mem.heap_used_in_bytes", "elasticsearch_heap_used"),
    Path("$.jvm.gc.collectors.old.collection_count", "elasticsearch_gc_old_count", "rate"),
    Path("$.jvm.gc.collectors.young.collection_count", "elasticsearch_gc_young_count", "rate"),
    Path("$.indices.merges.total_size_in_bytes", "elasticsearch_merge_size", "rate"),
    Path("$.indices.refresh.total_time_in_millis", "elasticsearch_refresh_time", "rate"),
    Path("$.indices.get.time_in_millis", "elasticsearch_get_time", "rate"),
    Path("$.indices.query_cache.evictions", "elasticsearch_query_cache_evictions", "rate"),
    Path("$.indices.query_cache.hit_count", "elasticsearch_query_cache_hit", "rate"),
    Path("$.indices.query_cache.miss_count", "elasticsearch_query_cache_mis", "rate"),
]


# Thread pools of a node, cluster totals and shards.
ELASTIC_TOTALS = [
    Path("$._all.primaries.docs.count", "elasticsearch_cluster_docs"),
    Path("$._all.primaries.docs.count", "elasticsearch_cluster_ingest_rate", "rate"),
    Path("$._shards.total", "elasticsearch_cluster_shards"),
    Path("$._all.total.store.size_in_bytes", "elasticsearch_cluster_storage_usage"),
]
ELASTIC_SHARDS = ("active_shards", "relocating_shards", "initializing_shards", "unassigned_shards")
DOCKER_MEMORY = ("active_anon", "active_file", "inactive_anon", "inactive_file", "file_mapped", "unevictable")
DOCKER_NETWORK = ("rx_errors", "tx_errors", "rx_dropped", "tx_dropped")


def riak(df: DataFrame) -> DataFrame:
    """Per-minute counts become per-second values."""
    rows = extract_paths(df, RIAK)
    minute = F.col("name").isin(*[f"riak_{n}" for n in RIAK_PER_MINUTE])
    value = F.when(minute, F.col("value") / 60).otherwise(F.col("value"))
    return rows.withColumn("value", value).withColumn(
        "value_kind", F.when(minute, "float").otherwise(F.col("value_kind"))
    )


def twemproxy(df: DataFrame) -> DataFrame:
    """Every backend's values, tag `backend`."""
    spec = [
        *[Path(_at(n), f"twemproxy_{n}", "rate") for n in TWEMPROXY_RATES],
        *[Path(_at(n), f"twemproxy_{n}") for n in TWEMPROXY_GAUGES],
    ]
    whole = [Path("$.curr_connections", "twemproxy_current_connections"), Path("$.proxy.client_connections", "twemproxy_client_connections")]
    return union_sources(extract_paths(df, spec, each="$.proxy", tag="backend"), extract_paths(df, whole))


def elasticsearch(df: DataFrame) -> DataFrame:
    """The first node only."""
    return extract_paths(df, ELASTIC_NODE, each="$.nodes", tag="node", first=1).withColumn(
        "tags", F.create_map().cast("map<string,string>")
    )


def elastic_pauses(df: DataFrame) -> DataFrame:
    """Collector time and count of the first node side by side."""
    keep = scrape_columns(df)
    node = F.get(F.map_values(F.try_variant_get(document(df), "$.nodes", "map<string,variant>")), F.lit(0))
    rows = df.select(*keep, F.lit(0).cast("bigint").alias("seq"), node.alias("_node"))
    parts = {
        f"{kind}_{what}": F.try_variant_get("_node", f"$.jvm.gc.collectors.{kind}.collection_{path}", "double")
        for kind in ("young", "old") for what, path in (("time", "time_in_millis"), ("count", "count"))
    }
    return rows.withColumns(parts).drop("_node").filter(F.col("young_time").isNotNull() & F.col("old_time").isNotNull())


def pause_means(rows: DataFrame, ranges: int | None = None, resume: SeriesState | None = None) -> DataFrame:
    """Mean pause since the scrape before, 0 unless time and count grew."""
    out = rows
    for kind in ("young", "old"):
        out = delta_ratio(out, f"{kind}_time", f"{kind}_count", ("host",), out=f"{kind}_ms", ranges=ranges, resume=resume)
    metrics = {f"{kind}_ms": (f"elasticsearch_gc_{kind}_time_ms", None, 0) for kind in ("young", "old")}
    held = [f"{kind}_{what}" for kind in ("young", "old") for what in ("time", "count")]
    return as_samples(out, metrics, F.create_map().cast("map<string,string>"), scrape_columns(rows.drop(*held)))


def elastic_health(df: DataFrame) -> DataFrame:
    """Shards as samples, the state of the cluster as an event with its message."""
    keep = scrape_columns(df)
    doc = document(df)
    shards = extract_paths(df, [Path(f"$.{s}", f"elasticsearch_{s}") for s in ELASTIC_SHARDS])

    def text(key: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.{key}", "string"), F.lit(""))

    message = F.concat(
        F.lit("Cluster: "), text("cluster_name"), F.lit(", Status: "), text("status"), F.lit(", Shards Active: "), text("active_shards"),
        F.lit(", Relocating: "), text("relocating_shards"), F.lit(", Initializing: "), text("initializing_shards"),
    )
    state = df.select(
        *keep, F.lit(4).cast("bigint").alias("seq"), F.lit("elasticsearch_status").alias("name"),
        F.create_map(F.lit(MESSAGE), message).alias("tags"), F.try_variant_get(doc, "$.status", "string").alias("value_raw"),
    ).filter(F.col("value_raw").isNotNull())
    return union_sources(shards, finish(state, keep).withColumn("style", F.lit(EVENT)))


def thread_pools(df: DataFrame) -> DataFrame:
    """Active and queued threads per pool of the first node."""
    node = F.get(F.map_values(F.try_variant_get(document(df), "$.nodes", "map<string,variant>")), F.lit(0))
    rows = df.withColumn(DOCUMENT, node)
    found = extract_paths(rows, [Path("$.active", "active"), Path("$.queue", "queue")], each="$.thread_pool", tag="pool")
    # What is counted is told by the type, not by the name.
    return found.withColumn("check_type", F.col("name")).withColumn("name", F.lit("elasticsearch_thread_pool")).withColumn("reaction", F.lit(-3))


def docker(df: DataFrame) -> DataFrame:
    """One container's statistics: processor share by its own earlier reading, throttling, network, memory."""
    keep = scrape_columns(df)
    doc = document(df)

    def number(path: str) -> Column:
        return F.try_variant_get(doc, path, "double")

    grown = number("$.cpu_stats.cpu_usage.total_usage") - number("$.precpu_stats.cpu_usage.total_usage")
    system = number("$.cpu_stats.system_cpu_usage") - number("$.precpu_stats.system_cpu_usage")
    share = df.select(*keep, doc.alias(DOCUMENT), F.lit(0).cast("bigint").alias("seq"), F.lit("docker_master_cpu_usage").alias("name"),
                      fixed(ratio(grown, system) * 100, 3).cast("string").alias("value_raw"))
    share = finish(share.filter(F.col("value_raw").isNotNull()), [*keep, DOCUMENT])
    plain = extract_paths(df.withColumn(DOCUMENT, doc).withColumn("_name", _container(doc)), [
        Path("$.cpu_stats.throttling_data.throttled_periods", "docker_cpu_throttled_periods"),
        Path("$.cpu_stats.throttling_data.throttled_time", "docker_cpu_throttled_time"),
        Path("$.memory_stats.usage", "docker_mem_cur_usage"),
        *[Path(f"$.memory_stats.stats.{m}", f"docker_mem_{m}") for m in DOCKER_MEMORY],
    ])
    plain = plain.withColumn("tags", F.create_map(F.lit("container"), F.col("_name"))).drop("_name")
    spec = [
        *[Path(f"$.{d}_bytes", f"docker_bytes_{d}_") for d in ("rx", "tx")],
        *[Path(f"$.{d}_packets", f"docker_{d}_packets_", "rate") for d in ("rx", "tx")],
        *[Path(f"$.{n}", f"docker_{n}_") for n in DOCKER_NETWORK],
    ]
    nets = extract_paths(df.withColumn(DOCUMENT, doc).withColumn("_name", _container(doc)), spec, each="$.networks", tag="nic")
    nets = nets.withColumn("name", F.concat("name", F.col("tags")["nic"])).withColumn("tags", F.create_map(F.lit("container"), F.col("_name"))).drop("_name")
    share = share.withColumn("tags", F.create_map(F.lit("container"), _container(F.col(DOCUMENT)))).drop(DOCUMENT).withColumn("style", F.lit("gauge"))
    chart = F.when(F.col("name") == "docker_master_cpu_usage", "Percent").when(F.col("name").rlike("_bytes_|_packets_"), "Rate")
    return union_sources(share, plain, nets).withColumn("chart_type", chart)


CEPH_ALWAYS = ("bytes_avail", "bytes_total", "bytes_used", "data_bytes", "num_pgs")
# Listed only while something is going on; 0 otherwise.
CEPH_SOMETIMES = (
    "read_bytes_sec", "write_bytes_sec", "degraded_objects", "degraded_ratio", "degraded_total", "misplaced_objects", "misplaced_ratio",
    "misplaced_total", "recovering_bytes_per_sec", "num_objects_recovered", "recovering_keys_per_sec",
)
CEPH_SHARES = (("PG_DEGRADED", "ceph_degraded_percent"), ("OBJECT_MISPLACED", "ceph_misplaced_percent"))
CEPH_OSD = (("utilization", "utilization"), ("kb_avail", "space_avail"), ("kb_used", "space_used"))
STORM_COUNTERS = ("emitted", "transferred", "acked", "failed")
HDFS_SIZES = ("length", "directoryCount", "spaceConsumed", "fileCount")


def ceph(df: DataFrame) -> DataFrame:
    """Cluster status: placement map, percentages out of the health texts, and the state as an event."""
    keep = scrape_columns(df)
    doc = document(df)

    def text(path: str) -> Column:
        return F.try_variant_get(doc, path, "string")

    sometimes = [(f"ceph_{n}", F.coalesce(text(f"$.pgmap.{n}"), F.lit("0"))) for n in CEPH_SOMETIMES]
    shares = [
        (name, F.coalesce(percent_from_text(text(f"$.health.checks.{check}.summary")).cast("string"), F.lit("0.0"))) for check, name in CEPH_SHARES
    ]
    state = F.coalesce(text("$.health.status"), text("$.health.overall_status"))
    found = [
        *[(f"ceph_{n}", text(f"$.pgmap.{n}"), "gauge") for n in CEPH_ALWAYS], *[(n, v, "gauge") for n, v in (*sometimes, *shares)],
        ("ceph_status", state, EVENT),
    ]
    parts = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value_raw"), F.lit(style).alias("style")) for n, v, style in found])
    rows = df.filter(F.try_variant_get(doc, "$.pgmap", "variant").isNotNull()).select(*keep, F.posexplode(parts).alias("_at", "_p"))
    rows = rows.filter(F.col("_p.value_raw").isNotNull())
    rows = rows.select(*keep, F.col("_at").cast("bigint").alias("seq"), "_p.name", "_p.value_raw", "_p.style")
    rated = F.col("name").isin("ceph_read_bytes_sec", "ceph_write_bytes_sec")
    return finish(rows.withColumn("chart_type", F.when(rated, "Rate")), [*keep, "style", "chart_type"])


def storm_counters(df: DataFrame) -> DataFrame:
    """All-time counters of a topology, one row each; a missing one counts as 0."""
    keep = scrape_columns(df)
    doc = document(df)
    stats = F.filter(F.try_variant_get(doc, "$.topologyStats", "array<variant>"), lambda v: F.try_variant_get(v, "$.windowPretty", "string") == "All time")
    whole = F.get(stats, F.lit(0))
    parts = F.array(*[F.struct(F.lit(f"storm_{c}").alias("name"), F.try_variant_get(whole, f"$.{c}", "double").alias("v")) for c in STORM_COUNTERS])
    rows = df.filter(whole.isNotNull()).select(*keep, F.try_variant_get(doc, "$.name", "string").alias("topology"), F.posexplode(parts).alias("_at", "_p"))
    return rows.select(*keep, "topology", F.col("_at").cast("bigint").alias("seq"), F.col("_p.name").alias("counter"), "_p.v")


def grown_counters(rows: DataFrame, ranges: int | None = None, resume: SeriesState | None = None) -> DataFrame:
    """Counters that grew since the scrape before; those without a value as 0."""
    keep = scrape_columns(rows.drop("topology", "counter", "v"))
    known = changed(rows.filter(F.col("v").isNotNull()), ["v"], ("host", "topology", "counter"), ranges=ranges, resume=resume)
    out = known.unionByName(rows.filter(F.col("v").isNull()).withColumn("v", F.lit(0.0)))
    return out.select(
        *keep, "seq", F.col("counter").alias("name"), F.create_map(F.lit("name"), F.col("topology")).alias("tags"),
        F.col("v").cast("string").alias("value_raw"), F.col("v").alias("value"), F.lit("float").alias("value_kind"), F.lit("Counter").alias("chart_type"),
    )


def hdfs_sizes(df: DataFrame) -> DataFrame:
    """Content summaries of folders, tag `hadoop_dir`: the folder without slashes at its ends, underscores inside."""
    rows = extract_paths(
        df, [Path(f"$.{n}", f"hdfs_dir_{n.lower()}") for n in HDFS_SIZES], each="$", tag="hadoop_dir"
    )
    # One folder per key of the payload.
    clean = F.translate(F.trim(F.translate(F.col("tags")["hadoop_dir"], "/", " ")), " ", "_")
    return rows.withColumn("_tags", F.create_map(F.lit("hadoop_dir"), clean)).drop("tags").withColumnRenamed("_tags", "tags").withColumn("reaction", F.lit(-3))


def _container(doc: Column) -> Column:
    return F.replace(F.try_variant_get(doc, "$.name", "string"), F.lit("/"), F.lit(""))


def container_times(df: DataFrame) -> DataFrame:
    """Processor time of a container and of its machine side by side."""
    keep = scrape_columns(df)
    doc = document(df)
    rows = df.select(
        *keep, F.lit(0).cast("bigint").alias("seq"), _container(doc).alias("container"),
        F.try_variant_get(doc, "$.cpu_stats.cpu_usage.total_usage", "double").alias("used"),
        F.try_variant_get(doc, "$.cpu_stats.system_cpu_usage", "double").alias("system"),
        F.size(F.map_keys(F.try_variant_get(doc, "$.precpu_stats.cpu_usage", "map<string,variant>"))).alias("parts"),
    )
    return rows.filter(F.col("used").isNotNull() & F.col("system").isNotNull())


def container_usage(rows: DataFrame, ranges: int | None = None, resume: SeriesState | None = None) -> DataFrame:
    """Share of a container in its machine's processor time since the scrape before."""
    out = delta_ratio(rows, "used", "system", ("host", "container"), gated=False, factor=F.col("parts") * 100.0, out="share", ranges=ranges, resume=resume)
    keep = scrape_columns(rows.drop("container", "used", "system", "parts"))
    return as_samples(out, {"share": ("docker_container_cpu_usage", "Percent", 0)}, F.create_map(F.lit("container"), F.col("container")), keep)


def mongodb(df: DataFrame) -> DataFrame:
    """Whole sections of the server status: every key is a metric."""
    parts = []
    for path, prefix, style in MONGO_SECTIONS:
        rows = extract_paths(df, [Path("$", "_", style)], each=path, tag="key")
        rows = rows.withColumn("name", F.concat(F.lit(prefix), F.col("tags")["key"]))
        parts.append(rows.withColumn("tags", F.create_map().cast("map<string,string>")))
    return union_sources(*parts)


def consul(df: DataFrame, rate_or_count: str = "Rate") -> DataFrame:
    """Listed gauges, all counters and samples."""
    rows = extract_named_arrays(df, rate_or_count)
    rows = rows.filter((F.col("section") != "Gauges") | F.col("name").isin(*CONSUL_GAUGES))
    return _plain(rows)


def vault(df: DataFrame, rate_or_count: str = "Rate") -> DataFrame:
    """All gauges and samples."""
    return _plain(extract_named_arrays(df, rate_or_count).filter(F.col("section") != "Counters"))


def _plain(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("name", plain_stat_name(F.col("name")))
        .withColumn("tags", F.create_map().cast("map<string,string>"))
        .drop("section")
    )


def nomad(df: DataFrame) -> DataFrame:
    """Client gauges, and job summaries with the job as tag."""
    rows = extract_named_arrays(df).filter(F.col("section") == "Gauges")
    job = F.col("name").isin(*NOMAD_JOBS)
    rows = rows.filter(job | F.col("name").isin(*NOMAD_GAUGES, NOMAD_HEARTBEAT))
    label = F.replace(F.try_element_at("tags", F.lit("job")), F.lit("/"), F.lit("_"))
    tags = F.when(job & label.isNotNull(), F.create_map(F.lit("nomad_jobname"), label)).otherwise(
        F.create_map().cast("map<string,string>")
    )
    rows = rows.withColumn("_tags", tags).drop("tags", "section").withColumnRenamed("_tags", "tags")
    return rows.withColumn("name", replace_chain(F.col("name"), [("nomad.nomad", "nomad"), (".", "_")]))


COUCHDB2 = [
    *[Path(_at("couchdb", op, "value"), f"couchdb_{op}", "rate_int") for op in COUCHDB2_OPS],
    *[Path(_at("couchdb", "httpd", h, "value"), f"couchdb_{h}", "rate_int") for h in COUCHDB2_HTTPD],
]
FDB = [
    *[
        Path(_at("cluster", "workload", l, o, "counter"), f"fdb_{l}_{o}", "rate")
        for l in FDB_WORKLOADS
        for o in FDB_OPERATIONS
    ],
    *[Path("$.cluster." + path, f"fdb_{name}") for path, name in FDB_GAUGES],
]


def foundationdb(df: DataFrame) -> DataFrame:
    """Workload rates, cluster gauges, memory per machine and moving data by kind."""
    memory = [Path(f"$.memory.{m}", f"fdb_memory_{m}") for m in FDB_MEMORY]
    return union_sources(
        extract_paths(df, FDB),
        extract_paths(df, memory, each="$.cluster.machines", tag="node", tag_path="$.address"),
        extract_paths(df, [Path("$", "fdb_moving_data")], each="$.cluster.data.moving_data", tag="fdb_move_type"),
    )


def _gauge_paths(names: Sequence[str], prefix: str, drop: Sequence[tuple[str, str]]) -> list[Path]:
    out = []
    for key in names:
        short = key
        for old, new in (*drop, (".", "_"), ("-", "_")):
            short = short.replace(old, new)
        out.append(Path(_at("gauges", key, "value"), prefix + short))
    return out


MARATHON = _gauge_paths(
    MARATHON_GAUGES, "mesos_marathon_",
    [("marathon.", ""), (".gauge", ""), ("jvm.memory.heap", "heap"), ("jvm.memory.non-heap", "nonheap"), (".bytes", "")],
)
CHRONOS = _gauge_paths(
    CHRONOS_GAUGES, "mesos_chronos_",
    [("jvm.memory.heap", "heap"), ("jvm.memory.non-heap", "nonheap"), (".count", "")],
)


def _keyed(df: DataFrame, each: str, path: str) -> DataFrame:
    """Every child of a section with its key in the column `key`."""
    rows = extract_paths(df, [Path(path, "_")], each=each, tag="key")
    return rows.withColumn("key", F.col("tags")["key"])


def _tagged(rows: DataFrame, tag: str, value: Column, name: Column) -> DataFrame:
    rows = rows.withColumn("name", name).withColumn("tags", F.create_map(F.lit(tag), value))
    return rows.filter(F.col("name").isNotNull()).drop("key")


def mesos_marathon(df: DataFrame) -> DataFrame:
    """Listed gauges, and collector gauges told apart by the length of their key."""
    gc = _keyed(df, "$.gauges", "$.value").filter(F.col("key").contains("marathon.jvm.gc"))
    parts = F.split("key", r"\.")
    name = F.when(F.size(parts) == 6, "mesos_marathon_gc_collections").when(F.size(parts) == 8, "mesos_marathon_gc_duration")
    return union_sources(extract_paths(df, MARATHON), _tagged(gc, "gctype", F.get(parts, F.lit(3)), name))


def mesos_chronos(df: DataFrame) -> DataFrame:
    """Listed gauges, collector gauges and job counters."""
    key = F.col("key")
    gc = _keyed(df, "$.gauges", "$.value").filter(key.contains("jvm.gc"))
    kind = F.lower(F.get(F.split("key", r"\."), F.lit(2)))
    count = key.contains("count")
    gc = _tagged(
        gc, "gctype", F.when(count, F.replace(kind, F.lit(" "), F.lit("_"))).otherwise(F.replace(kind, F.lit(" "), F.lit("-"))),
        F.when(count, "mesos_chronos_gc_collections").when(key.contains("time"), "mesos_chronos_gc_duration"),
    )
    jobs = _keyed(df, "$.counters", "$.count")
    job = F.replace(F.get(F.split("key", r"\."), F.lit(3)), F.lit(" "), F.lit("_"))
    outcome = F.when(key.contains("jobs.run.success"), "mesos_chronos_jobs_success").when(
        key.contains("jobs.run.failure"), "mesos_chronos_jobs_failure"
    )
    return union_sources(extract_paths(df, CHRONOS), gc, _tagged(jobs, "chronos_jobname", job, outcome))


def couchbase(df: DataFrame) -> DataFrame:
    """Node values under the node's host, cluster values under the scraping host."""
    nodes = extract_paths(
        df, [Path(f"$.interestingStats.{s}", f"couchbase_{s}") for s in COUCHBASE_NODE],
        each="$.nodes", tag="node", tag_path="$.hostname",
    )
    nodes = nodes.withColumn("host", F.substring_index(F.col("tags")["node"], ":", 1))
    nodes = nodes.withColumn("tags", F.create_map().cast("map<string,string>"))
    wide = extract_paths(
        df, [Path(f"$.basicStats.{s}", f"couchbase_clusterwide_{s.lower()}") for s in COUCHBASE_BASIC]
    )
    return union_sources(nodes, wide)


def rabbitmq_queues(df: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """Per-queue values of a list of queues; all of them when none are asked for."""
    rows = extract_paths(
        df, [Path(f"$.{s}", f"rabbitmq_{s}") for s in RABBIT_QUEUE], each="$", tag="queue", tag_path="$.name",
    )
    rows = allow_or_all(rows.withColumn("_queue", F.col("tags")["queue"]), list(wanted), "_queue")
    clean = F.regexp_replace("_queue", "[^a-zA-Z0-9]", "_")
    return rows.withColumn("tags", F.create_map(F.lit("queue"), clean)).drop("_queue")


def janus(df: DataFrame) -> DataFrame:
    """Number of sessions, and of handles per session."""
    keep = scrape_columns(df)
    doc = document(df)
    sizes = F.create_map(
        F.lit("janus_sessions"), F.size(F.try_variant_get(doc, "$.sessions", "array<variant>")),
        F.lit("janus_handlers"), F.size(F.try_variant_get(doc, "$.handles", "array<variant>")),
    )
    session = F.try_variant_get(doc, "$.session_id", "string")
    rows = df.select(*keep, session.alias("_s"), F.explode(sizes).alias("name", "n")).filter(F.col("n") >= 0)
    tags = F.when(F.col("_s").isNotNull(), F.create_map(F.lit("session"), F.col("_s")))
    rows = rows.select(
        *keep, F.lit(0).cast("bigint").alias("seq"), "name",
        F.coalesce(tags, F.create_map().cast("map<string,string>")).alias("tags"), F.col("n").cast("string").alias("value_raw"),
    )
    return finish(rows, keep)


for _name, _check in {
    "elasticsearch_gc": Check("elasticsearch", elastic_pauses, (), "elasticsearch", form=PARSED, derive=pause_means),
    "elasticsearch_pools": Check("elasticsearch", thread_pools, (), "elasticsearch", form=PARSED),
    "elasticsearch_totals": Check("elasticsearch_totals", partial(extract_paths, spec=ELASTIC_TOTALS), (), "elasticsearch", form=PARSED),
    "elasticsearch_health": Check("elasticsearch_health", elastic_health, (), "elasticsearch", form=PARSED, health=(
        Health("elasticsearch_status", "ElasticSearch-Health", kind="state"),
    )),
    "docker": Check("docker", docker, (), "docker", form=PARSED),
    "ceph": Check("ceph", ceph, (), "ceph", form=PARSED, health=(Health("ceph_status", "Ceph-Health", kind="state"),)),
    "ceph_pg": Check("ceph_pg", partial(extract_paths, spec=[Path("$.io_sec", "ceph_io_sec")]), (), "ceph", form=PARSED),
    "ceph_osd": Check("ceph_osd", partial(
        extract_paths, spec=[Path(f"$.{n}", f"ceph_osd_{m}") for n, m in CEPH_OSD], each="$.nodes", tag="osd_name", tag_path="$.name",
    ), (), "ceph", form=PARSED),
    "storm_topology": Check("storm_topology", storm_counters, (), "storm_topology", form=PARSED, derive=grown_counters),
    "hdfs_dirsize": Check("hdfs_dirsize", hdfs_sizes, (), "hdfs", form=PARSED),
    "docker_usage": Check("docker", container_times, (), "docker", form=PARSED, derive=container_usage),
}.items():
    register(_name, _check)

for _name, _fn, _type in (
    ("varnish", partial(extract_paths, spec=VARNISH), "varnish"),
    ("riak", riak, "riak"),
    ("couchdb_1x", partial(extract_paths, spec=COUCHDB), "couchdb"),
    ("mesos_master", partial(extract_paths, spec=_flat(MESOS_MASTER, "mesos_", [("/", "_")])), "mesos"),
    ("mesos_slave", partial(extract_paths, spec=_flat(MESOS_SLAVE, "mesos_", [("/", "_")])), "mesos"),
    ("solr", partial(extract_paths, spec=SOLR), "solr"),
    ("rabbitmq", partial(extract_paths, spec=RABBIT), "rabbitmq"),
    ("twemproxy", twemproxy, "twemproxy"),
    ("elasticsearch", elasticsearch, "elasticsearch"),
    ("mongodb", mongodb, "mongo"),
    ("couchdb_2x", partial(extract_paths, spec=COUCHDB2), "couchdb"),
    ("foundationdb", foundationdb, "foundationdb"),
    ("mesos_marathon", mesos_marathon, "marathon"),
    ("mesos_chronos", mesos_chronos, "chronos"),
    ("couchbase_5x", couchbase, "couchbase"),
    ("rabbitmq_queues", rabbitmq_queues, "rabbitmq"),
    ("janus", janus, "janus"),
    ("hashicorp_consul", consul, "consul"),
    ("hashicorp_vault", vault, "vault"),
    ("hashicorp_nomad", nomad, "nomad"),
):
    # Arrays of named stats are read by their schema, from the text.
    register(_name, Check(_name, _fn, (), _type, form=JSON_TEXT if _name.startswith("hashicorp_") else PARSED))
