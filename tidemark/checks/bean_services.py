"""Checks over management beans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.registry import Check, Recipe, gauges, rates, register
from tidemark.functions.numbers import percent_share
from tidemark.operators.aggregates import dedup_last, gc_kind
from tidemark.operators.projections import keep_tags
from tidemark.operators.sets import union_sources
from tidemark.sources.base import finish, scrape_columns
from tidemark.sources.beans import extract_bean_array, extract_bean_map
from tidemark.sources.opened import PARSED

# Memory fields, thread counts and the attributes of each service.
HEAP_FIELDS = ("max", "init", "committed", "used")
THREADS = ("PeakThreadCount", "ThreadCount", "DaemonThreadCount")
DATANODE_NAMES = (
    ("Capacity", "datanode_capacity", None), ("DfsUsed", "datanode_dfsused", "Rate"),
    ("OpenFileDescriptorCount", "datanode_openfiles", None), ("Remaining", "datanode_space_remaining", "Rate"),
)
DATANODE_RATES = ("BytesRead", "BytesWritten", "TotalReadTime", "TotalWriteTime")
NAMENODE_GAUGES = (
    "CapacityTotal", "CapacityUsed", "BlocksTotal", "MissingBlocks", "CorruptBlocks", "UnderReplicatedBlocks",
    "PendingReplicationBlocks", "ScheduledReplicationBlocks", "BlockCapacity", "NonDfsUsedSpace",
    "CapacityRemaining", "PercentRemaining", "OpenFileDescriptorCount", "NumStaleDataNodes",
    "NumStaleStorages", "NumLiveDataNodes", "NumDeadDataNodes", "NumDecomLiveDataNodes",
    "NumDecomDeadDataNodes", "NumDecommissioningDataNodes", "RpcAuthenticationFailures",
    "RpcAuthenticationSuccesses", "RpcAuthorizationFailures", "RpcAuthorizationSuccesses",
)
NAMENODE_RATES = (
    "CreateFileOps", "GetBlockLocations", "FilesRenamed", "GetListingOps", "DeleteFileOps", "FilesDeleted",
    "FileInfoOps", "AddBlockOps", "TransactionsNumOps", "ReceivedBytes", "SentBytes",
)
HMASTER_RATES = ("clusterRequests", "GcTimeMillis")
HMASTER_GAUGES = (
    "GcCount", "numRegionServers", "numDeadRegionServers", "ritOldestAge", "ritCountOverThreshold", "ritCount",
    "averageLoad", "authenticationSuccesses", "authorizationFailures", "authenticationFallbacks",
    "authorizationSuccesses",
)
HREST_THREADS = ("TotalStartedThreadCount", "PeakThreadCount", "ThreadCount", "DaemonThreadCount")
HREST_GAUGES = (
    "PauseTimeWithGc_99th_percentile", "PauseTimeWithGc_90th_percentile",
    "PauseTimeWithoutGc_90th_percentile", "PauseTimeWithoutGc_99th_percentile",
)
HREST_RATES = (
    "requests", "successfulDelete", "successfulGet", "successfulPut", "successfulScanCount",
    "failedDelete", "failedGet", "failedPut", "failedScanCount",
)
HREGION_RATES = (
    "totalRequestCount", "readRequestCount", "writeRequestCount", "Delete_num_ops", "Mutate_num_ops",
    "FlushTime_num_ops", "GcTimeMillis", "compactedCellsCount", "majorCompactedCellsCount",
    "compactedCellsSize", "majorCompactedCellsSize",
)
HREGION_GAUGES = (
    "GcCount", "OpenFileDescriptorCount", "blockCacheSize", "blockCacheExpressHitPercent",
    "blockCountHitPercent", "slowAppendCount", "slowGetCount", "slowPutCount", "slowIncrementCount",
    "slowDeleteCount", "memStoreSize", "regionCount", "storeFileSize", "storeFileCount", "hlogFileCount",
    "hlogFileSize", "percentFilesLocal", "authenticationFallbacks", "authorizationSuccesses",
    "authenticationFailures",
)
HREGION_CACHE = ("blockCacheFreeSize", "blockCacheCount")
HREGION_CACHE_RATES = ("blockCacheHitCount", "blockCacheMissCount", "blockCacheEvictionCount")
HREGION_HEDGED = ("hedgedReads", "hedgedReadWins")
HTHRIFT_GAUGES = (*HREST_GAUGES, "callQueueLen", "TimeInQueue_num_ops")
HTHRIFT_RATES = ("BatchMutate_num_ops", "ThriftCall_num_ops", "SlowThriftCall_num_ops", "BatchGet_num_ops")
BROKER_STATS = (
    "TotalConnectionsCount", "TotalMessageCount", "MemoryPercentUsage", "TotalProducerCount", "StorePercentUsage",
    "TotalConsumerCount", "TotalEnqueueCount", "TotalDequeueCount",
)
KAFKA_TOPICS = (
    "TotalProduceRequestsPerSec", "TotalFetchRequestsPerSec", "BytesInPerSec", "BytesOutPerSec", "BytesRejectedPerSec",
    "FailedFetchRequestsPerSec", "FailedProduceRequestsPerSec", "MessagesInPerSec",
)
KAFKA_REQUESTS = (
    "Produce", "JoinGroup", "FetchFollower", "GroupCoordinator", "OffsetCommit", "LeaderAndIsr", "Offsets", "OffsetFetch",
    "Fetch", "FetchConsumer",
)
CASSANDRA2_CACHES = ("RowCacheHits", "KeyCacheHits", "RowCacheRequests", "KeyCacheRequests")
CASSANDRA2_STAGES = ("RequestResponseStage", "ReadStage", "MutationStage")
CASSANDRA_CQL = ("PreparedStatementsExecuted", "RegularStatementsExecuted")
CASSANDRA_LATENCY = ("Read", "ViewWrite", "RangeSlice", "CASRead", "CASWrite", "Write")


def collector_recipes(prefix: str) -> list[Recipe]:
    return [
        Recipe("LastGcInfo.duration", f"{prefix}lastgcinfo"),
        Recipe("CollectionCount", f"{prefix}gc_collectioncount", reaction=-1),
        Recipe("CollectionTime", f"{prefix}gc_collectiontime", reaction=-1),
    ]


def heap_recipes(prefix: str, fields: Sequence[str] = HEAP_FIELDS, **kw) -> list[Recipe]:
    return [
        Recipe(f"{kind}MemoryUsage.{f}", f"{prefix}{kind.lower()}_{f}", **kw)
        for kind in ("Heap", "NonHeap")
        for f in fields
    ]


def bean_rows(df: DataFrame) -> DataFrame:
    """Attributes of an array of beans; a repeated attribute keeps its last value, except per collector."""
    rows = keep_tags(extract_bean_array(df), ["gctype"])
    rows = rows.withColumn("gctype", F.try_element_at("tags", F.lit("gctype")))
    collector = F.col("name").isin("LastGcInfo.duration", "CollectionCount", "CollectionTime")
    rows = rows.filter(~collector | F.col("gctype").isNotNull())
    return dedup_last(rows, [*scrape_columns(df), "name", "gctype"]).drop("gctype")


def datanode_rows(df: DataFrame) -> DataFrame:
    """Bean attributes, and the used share of the space as one more of them."""
    keep = scrape_columns(df)
    rows = bean_rows(df)
    space = rows.filter(F.col("name").isin("DfsUsed", "Remaining")).groupBy(*keep).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("DfsUsed", "Remaining")]
    )
    share = space.select(
        *keep, F.lit(0).cast("bigint").alias("seq"), F.lit("du_percent").alias("name"), F.create_map().cast("map<string,string>").alias("tags"),
        percent_share(F.col("DfsUsed"), F.col("Remaining")).cast("string").alias("value_raw"),
    ).filter(F.col("value_raw").isNotNull())
    return union_sources(rows, finish(share, keep))


def bean_map_rows(df: DataFrame) -> DataFrame:
    return keep_tags(extract_bean_map(df), ["gctype"])


def jvm(prefix: str) -> list[Recipe]:
    """The recipes all services behind a bean bridge share."""
    return [
        *collector_recipes(prefix),
        *heap_recipes(prefix, ("used", "committed", "max")),
        *gauges(prefix, THREADS),
    ]


HDFS_DATANODE = [
    *heap_recipes("datanode_", reaction=-3),
    *collector_recipes("datanode_"),
    *[Recipe(m, n, "gauge", chart, -3) for m, n, chart in DATANODE_NAMES],
    *rates("datanode_", DATANODE_RATES),
    Recipe("du_percent", "datanode_du_percent", "gauge", "Percent", -3),
]
HDFS_NAMENODE = [
    *heap_recipes("namenode_"),
    *collector_recipes("namenode_"),
    *gauges("namenode_", NAMENODE_GAUGES),
    *rates("namenode_", NAMENODE_RATES),
]
HBASE_MASTER = [
    *heap_recipes("hmaster_"),
    *collector_recipes("hmaster_"),
    *gauges("hmaster_node_", HMASTER_GAUGES),
    *rates("hmaster_node_", HMASTER_RATES),
]
HBASE_REST = [
    *heap_recipes("hrest_"),
    *collector_recipes("hrest_"),
    *gauges("hrest_", (*HREST_THREADS, *HREST_GAUGES)),
    *rates("hrest_", HREST_RATES),
]

HBASE_REGION = [
    *heap_recipes("hregion_node_"),
    *collector_recipes("hregion_"),
    *gauges("hregion_node_", (*HREGION_GAUGES, *HREGION_HEDGED)),
    *gauges("hregion_node_", HREGION_CACHE, reaction=-3),
    *rates("hregion_node_", HREGION_RATES),
    *rates("hregion_node_", HREGION_CACHE_RATES, reaction=-3),
]


def region_rows(df: DataFrame) -> DataFrame:
    """Hedged reads only once there are any."""
    return bean_rows(df).filter(~F.col("name").isin(*HREGION_HEDGED) | (F.col("value") > 0))


def thrift_rows(df: DataFrame) -> DataFrame:
    """Thread, memory and per-queue values; the queue is the tag `thrift_queue`."""
    rows = extract_bean_array(df)
    bean = F.try_element_at("tags", F.lit("bean"))
    queue = F.when(bean.endswith("sub=ThriftOne"), "one").when(bean.endswith("sub=ThriftTwo"), "two")
    per_queue = F.col("name").isin(*HTHRIFT_GAUGES, *HTHRIFT_RATES)
    pairs = F.create_map(
        F.lit("thrift_queue"), F.when(per_queue, queue),
        F.lit("gctype"), F.try_element_at("tags", F.lit("gctype")),
    )
    collector = F.col("name").isin("LastGcInfo.duration", "CollectionCount", "CollectionTime")
    rows = rows.withColumn("_tags", F.map_filter(pairs, lambda _, v: v.isNotNull())).filter(
        (~per_queue | queue.isNotNull()) & (~collector | F.map_contains_key("_tags", "gctype"))
    )
    return rows.drop("tags").withColumnRenamed("_tags", "tags")


HBASE_THRIFT = [
    *heap_recipes("hthrift_"),
    *collector_recipes("hthrift_"),
    *gauges("hthrift_", (*HREST_THREADS, *HTHRIFT_GAUGES)),
    *[Recipe(r, "hthrift_" + r.replace("_num_ops", "").lower(), "rate", "Rate") for r in HTHRIFT_RATES],
]


def cassandra3(df: DataFrame) -> DataFrame:
    """Statement counters, latencies, cache rates, pending compactions and memory."""
    rows = extract_bean_map(df, properties=("type", "scope", "name"))

    def prop(key: str) -> Column:
        return F.try_element_at("tags", F.lit(key))

    kind, scope, name, attr = prop("type"), prop("scope"), prop("name"), F.col("name")
    cql = (kind == "CQL") & name.isin(*CASSANDRA_CQL) & (attr == "Count")
    latency = (kind == "ClientRequest") & (name == "Latency") & scope.isin(*CASSANDRA_LATENCY) & (attr == "Mean")
    cache = (kind == "Cache") & name.isin("Hits", "Requests") & scope.isin("KeyCache", "RowCache") & (attr == "OneMinuteRate")
    pending = (kind == "Compaction") & (name == "PendingTasks") & (attr == "Value")
    pool = F.regexp_extract(attr, r"^(Heap|NonHeap)MemoryUsage\.(used|committed|max)$", 1)
    pool_field = F.regexp_extract(attr, r"^(Heap|NonHeap)MemoryUsage\.(used|committed|max)$", 2)
    metric = (
        F.when(cql, F.concat(F.lit("cassa_cql_"), name))
        .when(latency & (F.col("value") != 0), F.concat(F.lit("cassa_latency_"), scope))
        .when(cache, F.concat(F.lit("cassa_"), name, F.lit("_"), scope))
        .when(pending, F.lit("cassa_compaction_pending"))
        .when(pool != "", F.concat(F.lit("cassa_"), pool, F.lit("_"), pool_field))
    )
    rows = rows.withColumn("_metric", F.lower(metric)).withColumn("style", F.when(cql, "rate").otherwise("gauge"))
    return (
        rows.filter(F.col("_metric").isNotNull())
        .withColumn("name", F.col("_metric"))
        .withColumn("tags", F.create_map().cast("map<string,string>"))
        .drop("_metric")
    )


COLLECTOR_ROUTES = {"cms": ("cms", "parnew"), "g1": ("g1_old", "g1_young")}


def jvm_routed(df: DataFrame, prefix: str, threads: Sequence[str] = THREADS, named: dict[str, str] | None = None) -> DataFrame:
    """Memory, threads and collectors of a bean map, the collectors by the kind that the scrape runs.

    A scrape with a concurrent-mark-sweep collector gives that and its young one, else one with G1 gives its two;
    others give none. The names carry the collector: last pause, count, and the rate of the time.
    """
    rows = extract_bean_map(df).withColumn("gctype", F.try_element_at("tags", F.lit("gctype")))
    rules = [("cms", F.col("gctype") == "cms"), ("g1", F.col("gctype") == "g1_young")]
    rows = gc_kind(rows, rules)
    wanted = F.create_map(*[x for kind, types in COLLECTOR_ROUTES.items() for x in (F.lit(kind), F.array(*[F.lit(t) for t in types]))])
    routed = F.array_contains(wanted[F.col("gc_kind")], F.col("gctype"))
    names = {"LastGcInfo.duration": "lastgcinfo", "CollectionCount": "collectioncount", "CollectionTime": "collectiontime"} | (named or {})
    part = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("name")]
    heap = F.regexp_extract("name", r"^(Heap|NonHeap)MemoryUsage\.(used|committed|max)$", 1)
    field = F.regexp_extract("name", r"^(Heap|NonHeap)MemoryUsage\.(used|committed|max)$", 2)
    metric = (
        F.when(part.isNotNull() & routed, F.concat_ws("_", F.lit(prefix.rstrip("_")), "gctype", part))
        .when(heap != "", F.concat(F.lit(prefix), F.lower(heap), F.lit("_"), field))
        .when(F.col("gctype").isNull() & F.col("name").isin(*threads), F.concat(F.lit(prefix), F.lower("name")))
    )
    timed = (F.col("name") == "CollectionTime") & routed
    quiet = ((heap != "") & (field != "used")) | ((F.col("name") == "CollectionCount") & (F.col("gc_kind") == "g1"))
    out = rows.withColumns({
        "_metric": metric, "style": F.when(timed, "rate").otherwise("gauge"), "chart_type": F.when(timed, "Rate"),
        "reaction": F.when(quiet, -3).otherwise(0), "tags": F.create_map().cast("map<string,string>"),
    }).filter(F.col("_metric").isNotNull())
    return out.withColumn("name", F.col("_metric")).drop("_metric", "gctype", "gc_kind")


def _bean_attributes(df: DataFrame, rules: Sequence[tuple[Column, Column, str]]) -> DataFrame:
    """Attributes picked by bean: rules of condition, metric and style over `bean`, its `type` and `name` and the attribute."""
    rows = extract_bean_map(df, properties=("type", "name", "request"))
    rows = rows.withColumns({k: F.try_element_at("tags", F.lit(t)) for k, t in (("_bean", "bean"), ("_type", "type"), ("_name", "name"), ("_request", "request"))})
    metric, style = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, name, kind in reversed(rules):
        metric, style = F.when(cond, name).otherwise(metric), F.when(cond, kind).otherwise(style)
    rows = rows.withColumns({
        "_metric": metric, "style": style, "chart_type": F.when(style == "rate", "Rate"), "tags": F.create_map().cast("map<string,string>"),
    }).filter(F.col("_metric").isNotNull())
    return rows.withColumn("name", F.col("_metric")).withColumn("reaction", F.lit(0)).drop("_metric", "_bean", "_type", "_name", "_request")


def activemq(df: DataFrame) -> DataFrame:
    """The machine's own values and the broker's totals."""
    broker = F.col("_bean").contains("type=Broker") & F.col("name").isin(*BROKER_STATS)
    totals = _bean_attributes(df, [(broker, F.concat(F.lit("activemq_"), F.lower("name")), "gauge")])
    return union_sources(jvm_routed(df, "activemq_"), totals)


def kafka(df: DataFrame) -> DataFrame:
    """Topic rates of the broker, and requests by kind."""
    topics = (F.col("_type") == "BrokerTopicMetrics") & F.col("_name").isin(*KAFKA_TOPICS) & (F.col("name") == "OneMinuteRate")
    requests = (F.col("_type") == "RequestMetrics") & (F.col("_name") == "RequestsPerSec") & F.col("_request").isin(*KAFKA_REQUESTS) & (F.col("name") == "Count")
    return _bean_attributes(df, [
        (topics, F.concat(F.lit("kafka_"), F.lower("_name")), "gauge"), (requests, F.concat(F.lit("kafka_"), F.lower("_request")), "rate"),
    ])


def cassandra2(df: DataFrame) -> DataFrame:
    """Caches in use, stages, native requests, compactions and the machine's own values."""
    named = F.concat(F.lit("cassa_"), F.lower("name"))
    caches = (F.col("_type") == "Caches") & F.col("name").isin(*CASSANDRA2_CACHES) & (F.col("value") > 0)
    done = F.col("name") == "CompletedTasks"
    found = _bean_attributes(df, [
        (caches, named, "rate"),
        (F.col("_bean").startswith("org.apache.cassandra.request:") & F.col("_type").isin(*CASSANDRA2_STAGES) & done, F.concat(F.lit("cassa_"), F.lower("_type")), "rate"),
        ((F.col("_type") == "Native-Transport-Requests") & done, F.lit("cassa_native_transport_requests"), "rate"),
        ((F.col("_type") == "Compaction") & (F.col("_name") == "PendingTasks") & (F.col("name") == "Value"), F.lit("cassa_pending_compactions"), "gauge"),
    ])
    named = {"CollectionCount": "collection_count", "CollectionTime": "collection_time"}
    return union_sources(jvm_routed(df, "cassa_", ("TotalStartedThreadCount", *THREADS), named), found)


for _name, _fn, _type in (
    ("activemq", activemq, "activemq"),
    ("kafka_broker", kafka, "kafka"),
    ("cassandra2", cassandra2, "cassandra"),
    ("spark_master", partial(jvm_routed, prefix="spark_master_", named={"CollectionCount": "collection_count"}), "spark"),
    ("spark_worker", partial(jvm_routed, prefix="spark_worker_", named={"CollectionCount": "collection_count"}), "spark"),
):
    register(_name, Check("kafka" if _name == "kafka_broker" else _name, _fn, (), _type, form=PARSED))

register("cassandra3", Check("cassandra3", cassandra3, (), "cassandra", form=PARSED))

for _name, _fn, _recipes, _type in (
    ("hadoop_datanode", datanode_rows, HDFS_DATANODE, "hdfs"),
    ("hadoop_namenode", bean_rows, HDFS_NAMENODE, "hdfs"),
    ("hbase_master", bean_rows, HBASE_MASTER, "hbase"),
    ("hbase_rest", bean_rows, HBASE_REST, "hbase"),
    ("hbase_regionserver", region_rows, HBASE_REGION, "hbase"),
    ("hbase_thrift", thrift_rows, HBASE_THRIFT, "hbase"),
    ("jetty", bean_map_rows, jvm("jetty_"), "jetty"),
    ("jolokia", bean_map_rows, jvm("jolokia_"), "jolokia"),
    ("jmx", bean_map_rows, jvm("jmx_"), "jmx"),
    ("kafka", bean_map_rows, jvm("kafka_"), "kafka"),
    ("storm_workers", bean_map_rows, jvm("storm_"), "Storm"),
):
    register(_name, Check(_name, _fn, _recipes, _type, form=PARSED))
