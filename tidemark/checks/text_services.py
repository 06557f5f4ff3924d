"""Checks over line-oriented payloads."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checks.events import EVENT, Health
from tidemark.checks.registry import Check, Recipe, as_samples, gauges, rates, register
from tidemark.functions.numbers import fixed, int_text, percent_of, percent_rest
from tidemark.functions.text import path_tag
from tidemark.operators.filters import digits_only, not_loopback, whole_disk
from tidemark.operators.joins import resolve_oid
from tidemark.operators.projections import extract_all_indexed
from tidemark.operators.sets import union_sources
from tidemark.operators.resume import SeriesState
from tidemark.operators.windows import changed_rate, delta_share
from tidemark.sources.base import finish, lines, scrape_columns, split_lines
from tidemark.sources.status import STATUS_GAUGES
from tidemark.sources.text import Cell, extract_columns, extract_csv, extract_kv_lines, extract_positional, extract_script_lines

# Names read from each service and the metrics they become.
REDIS = [
    *gauges("redis_", (
        "connected_clients", "used_memory", "used_memory_rss", "used_memory_peak", "uptime_in_seconds",
        "mem_fragmentation_ratio", "rdb_changes_since_last_save", "rdb_bgsave_in_progress",
        "rdb_last_bgsave_time_sec", "rdb_current_bgsave_time_sec",
    )),
    *rates("redis_", (
        "total_commands_processed", "expired_keys", "evicted_keys", "total_net_input_bytes",
        "total_net_output_bytes", "keyspace_hits", "keyspace_misses",
    )),
]
MEMCACHED = [
    *gauges("memcached_", (
        "curr_connections", "curr_items", "rusage_user", "rusage_system", "get_misses", "incr_misses",
        "evictions", "limit_maxbytes",
    )),
    *rates("memcached_", (
        "cmd_get", "cmd_set", "get_hits", "set_hits", "delete_misses", "delete_hits", "bytes",
        "bytes_read", "bytes_written",
    )),
]
APACHE = gauges("apache_", (
    "ReqPerSec", "BytesPerSec", "BytesPerReq", "BusyWorkers", "IdleWorkers", "Total kBytes", "Total Accesses",
))
LIGHTTPD = [
    *rates("lighttpd_", ("accesses", "kbytes")),
    *gauges("lighttpd_", ("busyservers", "idleservers")),
]
NGINX = [
    Cell("connections", 0, 2), Cell("accept", 2, 0), Cell("handled", 2, 1), Cell("requests", 2, 2),
    Cell("reading", 3, 1), Cell("writing", 3, 3), Cell("waiting", 3, 5),
]
NGINX_RECIPES = [
    *gauges("nginx_", ("connections", "reading", "writing", "waiting")),
    *rates("nginx_", ("requests", "handled", "accept")),
]
PHPFPM = [
    Cell("connections", 4, 1, ":"), Cell("proc_idle", 8, 1, ":"), Cell("proc_active", 9, 1, ":"),
    Cell("proc_total", 10, 1, ":"), Cell("max_active", 11, 1, ":"), Cell("max_children", 12, 1, ":"),
    Cell("slow_request", 13, 1, ":"),
]
PHPFPM_RECIPES = [
    Recipe("connections", "phpfpm_conns_per_sec", "rate", "Rate"),
    *gauges("phpfpm_", ("proc_idle", "proc_active", "proc_total", "max_active", "max_children", "slow_request")),
]
ZOOKEEPER_RATES = ("zk_packets_received", "zk_packets_sent")
MEMORY_NAMES = ("MemTotal", "MemAvailable", "Buffers", "Cached", "Active", "Inactive")
HAPROXY = gauges("haproxy_", (
    "rate", "rate_max", "req_rate", "req_rate_max", "conn_rate", "conn_rate_max", "conn_tot", "reuse",
    "cache_lookups", "cache_hits",
))
LOAD = [Cell("sys_load_1", 0, 0), Cell("sys_load_5", 0, 1), Cell("sys_load_15", 0, 2)]
CONNTRACK = [Cell("conntrack_cur", 0, 0), Cell("conntrack_max", 1, 0)]
CPU_WATCHED = ("cpu_user", "cpu_iowait")
CPU_PARTS = ("cpu_user", "cpu_nice", "cpu_system", "cpu_idle", "cpu_iowait", "cpu_irq", "cpu_softirq")

# Socket states by their code, thread counters.
TCP_STATES = (
    ("01", "established"), ("02", "syn_sent"), ("03", "syn_recv"), ("04", "syn_recv"), ("05", "fin_wait1"),
    ("06", "fin_wait2"), ("07", "time_wait"), ("08", "close"), ("09", "close_wait"), ("0A", "last_ack"),
    ("0B", "listen"), ("0C", "closing"), ("0D", "new_syn_recv"), ("0E", "max_states"),
)
TOMCAT_THREADS = ("PeakThreadCount", "DaemonThreadCount", "ThreadCount", "TotalStartedThreadCount")


def _short_kv(df: DataFrame) -> DataFrame:
    """Keys squeezed: blanks and `Total` dropped, lower case."""
    rows = extract_kv_lines(df, ":")
    return rows.withColumn("name", F.lower(F.replace(F.replace("name", F.lit(" "), F.lit("")), F.lit("Total"), F.lit(""))))


def zookeeper(df: DataFrame) -> DataFrame:
    rows = extract_kv_lines(df, "\t").filter(digits_only(F.col("value_raw")))
    rated = F.col("name").isin(*ZOOKEEPER_RATES)
    return rows.withColumn("style", F.when(rated, "rate").otherwise("gauge")).withColumn(
        "chart_type", F.when(rated, "Rate")
    )


def memory(df: DataFrame) -> DataFrame:
    """Kilobyte lines to bytes under short names, and the used percentage."""
    keep = scrape_columns(df)
    rows = extract_kv_lines(df, ":", first_token=True, last_wins=True).filter(F.col("name").isin(*MEMORY_NAMES))
    bytes_ = (F.col("value").cast("bigint") * 1024).alias("bytes")
    # A scrape has a handful of these rows; they meet to give the percentage.
    held = rows.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("seq", bytes_)))).alias("_m"))
    rest = percent_rest(F.col("_m")["MemAvailable"]["bytes"], F.col("_m")["MemTotal"]["bytes"])
    parts = F.transform(F.map_entries("_m"), lambda e: F.struct(
        e["value"]["seq"].alias("seq"), F.concat(F.lit("mem_"), F.lower(F.replace(e["key"], F.lit("Mem"), F.lit("")))).alias("name"),
        e["value"]["bytes"].cast("string").alias("raw"), F.when(e["key"] == "Buffers", -3).otherwise(0).alias("reaction"), F.lit(None).cast("string").alias("chart_type"),
    ))
    used = F.struct(
        F.lit(0).cast("bigint").alias("seq"), F.lit("mem_used_percent").alias("name"), rest.cast("string").alias("raw"), F.lit(0).alias("reaction"), F.lit("Percent").alias("chart_type"),
    )
    found = held.select(*keep, F.explode(F.concat(parts, F.array(used))).alias("_p")).filter(F.col("_p.raw").isNotNull())
    out = finish(found.select(*keep, "_p.seq", "_p.name", F.col("_p.raw").alias("value_raw"), "_p.reaction", "_p.chart_type"), [*keep, "reaction", "chart_type"])
    return out


def load_average(df: DataFrame) -> DataFrame:
    """The three averages, and the first as a percentage of the cores where the page lists them.

    Cores are the lines of processor statistics after the averages, one `cpu` line being the sum.
    """
    keep = scrape_columns(df)
    cores = F.size(F.filter(split_lines("payload"), lambda line: line.startswith("cpu"))) - 1
    first = F.get(F.split(F.ltrim("payload"), r"\s+"), F.lit(0)).try_cast("double")
    level = F.when(cores > 0, first * 100 / cores)
    percent = df.select(*keep, F.lit(3).cast("bigint").alias("seq"), F.lit("sys_load_percent").alias("name"), level.cast("string").alias("value_raw"))
    percent = finish(percent.filter(F.col("value_raw").isNotNull()), keep).withColumn("style", F.lit(EVENT))
    averages = extract_positional(df, LOAD).filter(F.col("value").isNotNull())
    return union_sources(averages.withColumn("style", F.lit("gauge")), percent)


def haproxy(df: DataFrame) -> DataFrame:
    """Back-end rows, application as tag."""
    rows = extract_csv(df, ids=("pxname", "svname")).filter(F.col("svname") == "BACKEND")
    rows = rows.withColumn("tags", F.create_map(F.lit("appname"), F.col("pxname")))
    return rows.drop("row", "pxname", "svname")


def script(df: DataFrame) -> DataFrame:
    return extract_script_lines(df).drop("type")


def disk_io(df: DataFrame) -> DataFrame:
    """Milliseconds spent on I/O per whole disk; their rate over ten is the busy percentage."""
    rows = extract_columns(df, {"drive": 2, "value_raw": 12}).filter(whole_disk(F.col("drive")))
    rows = rows.withColumn("name", F.lit("drive_io_percent_used")).withColumn("tags", F.create_map(F.lit("drive"), F.col("drive")))
    return finish(rows.filter(F.col("value_raw").isNotNull()), scrape_columns(df)).withColumn("style", F.lit("rate_tenth"))


def mounts(df: DataFrame) -> DataFrame:
    """`path used available [total]` lines to bytes per mount point, and the used percentage of a total."""
    rows = extract_columns(df, {"path": 0, "drive_bytes_used": 1, "drive_bytes_available": 2, "total": 3})
    used = fixed(percent_of(F.col("drive_bytes_used").try_cast("double"), F.col("total").try_cast("double")))
    rows = rows.withColumn("drive_percent_used", used.cast("string"))
    wide = rows.unpivot(
        [*scrape_columns(df), "seq", "path"], ["drive_bytes_used", "drive_bytes_available", "drive_percent_used"], "name", "value_raw"
    ).filter(F.col("value_raw").isNotNull())
    out = finish(wide.withColumn("tags", F.create_map(F.lit("mountpoint"), path_tag(F.col("path")))), scrape_columns(df))
    return out.withColumn("chart_type", F.when(F.col("name") == "drive_percent_used", "Percent"))


def disk_bytes(df: DataFrame) -> DataFrame:
    """`device sector_size` and the device's statistics to bytes read and written, rated."""
    rows = extract_columns(df, {"drive": 0, "size": 1, "drive_reads": 4, "drive_writes": 8})
    rows = rows.filter(~F.col("drive").contains("ram") & ~F.col("drive").contains("loop"))
    sector = F.col("size").try_cast("bigint")
    rows = rows.withColumns({c: (F.col(c).try_cast("bigint") * sector).cast("string") for c in ("drive_reads", "drive_writes")})
    wide = rows.unpivot([*scrape_columns(df), "seq", "drive"], ["drive_reads", "drive_writes"], "name", "value_raw").filter(F.col("value_raw").isNotNull())
    out = finish(wide.withColumn("tags", F.create_map(F.lit("drive"), F.col("drive"))), scrape_columns(df))
    return out.withColumn("style", F.lit("rate"))


def interfaces(df: DataFrame) -> DataFrame:
    """`name rx tx` lines as byte counters side by side, loopback left out."""
    rows = extract_columns(df, {"nic": 0, "rx": 1, "tx": 2}).filter(not_loopback(F.col("nic")))
    return rows.withColumns({c: int_text(F.col(c)) for c in ("rx", "tx")})


def interface_rates(rows: DataFrame, ranges: int | None = None, resume: SeriesState | None = None) -> DataFrame:
    """Byte rates over the rows in which either counter grew: a rate spans the idle time before it."""
    rated = changed_rate(rows, {"rx": "rx_rate", "tx": "tx_rate"}, ("host", "nic"), ranges=ranges, resume=resume)
    metrics = {"rx_rate": ("bytes_rx", "Rate", 0), "tx_rate": ("bytes_tx", "Rate", 0)}
    return as_samples(rated, metrics, F.create_map(F.lit("interface"), F.col("nic")), scrape_columns(rows.drop("nic", "rx", "tx")))


def cpu_times(df: DataFrame) -> DataFrame:
    """Processor lines as wide rows per core, the input of `delta_share`."""
    rows = extract_columns(
        df, {"core": 0, **{p: i + 1 for i, p in enumerate(CPU_PARTS)}}, where=F.col("line").startswith("cpu")
    )
    core = F.when(F.col("core") == "cpu", "all").otherwise(F.replace("core", F.lit("cpu"), F.lit("core")))
    return rows.withColumn("core", core).withColumns({p: F.col(p).try_cast("double") for p in CPU_PARTS})


def core_shares(rows: DataFrame, ranges: int | None = None, resume: SeriesState | None = None) -> DataFrame:
    """Wide rows per core to percent samples, tag `core`."""
    total, load = CPU_PARTS[:4], CPU_PARTS[:3]
    out = delta_share(rows, CPU_PARTS, total, load, ("host", "core"), ranges=ranges, resume=resume)
    metrics = {"load_pct": ("cpu_load", "Percent", 0)}
    metrics |= {f"{p}_pct": (p, "Percent", 0 if p in CPU_WATCHED else -3) for p in CPU_PARTS}
    keep = [c for c in scrape_columns(rows) if c not in ("core", *CPU_PARTS)]
    return as_samples(out, metrics, F.create_map(F.lit("core"), F.col("core")), keep)


def cpu_shares(raw: DataFrame, ranges: int | None = None) -> DataFrame:
    """Processor times to percent samples, tag `core`."""
    return core_shares(cpu_times(raw), ranges)


def btrfs(df: DataFrame) -> DataFrame:
    """Error counters per device, names cleaned of brackets, dots and slashes."""
    rows = extract_kv_lines(df, r"\s+")
    return rows.withColumn("name", F.concat(F.lit("btrfs"), F.translate("name", "./[]", "__")))


def btrfs_errors(df: DataFrame) -> DataFrame:
    """The same counters under one name, device counter as tag, for their events."""
    rows = btrfs(df).withColumn("tags", F.create_map(F.lit("counter"), F.col("name")))
    return rows.withColumn("name", F.lit("btrfs_io_errors")).withColumn("style", F.lit(EVENT))


def udp_sockets(df: DataFrame) -> DataFrame:
    """Lines of the socket tables, headers included, as the number of clients."""
    keep = scrape_columns(df)
    n = F.size(F.filter(split_lines("payload"), lambda line: line != ""))
    rows = df.filter(F.col("payload").isNotNull()).select(
        *keep, F.lit(0).cast("bigint").alias("seq"), F.lit("udp_clients").alias("name"),
        F.create_map(F.lit("flag"), F.lit("udp")).alias("tags"), n.cast("string").alias("value_raw"),
    )
    return finish(rows, keep)


def sockets(df: DataFrame) -> DataFrame:
    """TCP sockets by state; every state is present."""
    keep = scrape_columns(df)
    rows = extract_columns(df, {"code": 3}, skip=1).filter(F.col("code").isNotNull())
    label = F.create_map(*[F.lit(x) for pair in TCP_STATES for x in pair])[F.col("code")]
    labels = list(dict.fromkeys(name for _, name in TCP_STATES))
    counts = rows.withColumn("flag", label).groupBy(*keep).pivot("flag", labels).agg(F.count(F.lit(1)))
    wide = counts.fillna(0, subset=labels)
    long = wide.unpivot(keep, labels, "flag", "n").select(
        *keep, F.lit(0).cast("bigint").alias("seq"), F.lit("tcp_connections").alias("name"),
        F.create_map(F.lit("flag"), F.col("flag")).alias("tags"), F.col("n").cast("string").alias("value_raw"),
    )
    return finish(long, keep)


def snmp(df: DataFrame, names: DataFrame) -> DataFrame:
    """`oid = TYPE: value` lines of a device, named by a table of its object ids; others are left out.

    The host of the scrape is the device.
    """
    keep = scrape_columns(df)
    rows = lines(df).withColumn("oid", F.replace(F.get(F.split(F.trim("line"), r"\s+"), F.lit(0)), F.lit("iso."), F.lit(".1.")))
    rows = rows.withColumn("value_raw", F.element_at(F.split(F.trim("line"), r"\s+"), -1)).withColumn("device", F.col("host"))
    named = resolve_oid(rows, names).filter(F.col("name").isNotNull())
    named = named.withColumn("name", F.concat(F.lit("snmp_"), F.col("name"))).withColumn("tags", F.create_map(F.lit("devicename"), F.col("device")))
    return finish(named, keep)


def snmp_check(names: DataFrame, source: str = "snmp") -> Check:
    """The check of devices whose object ids `names` (device, oid, name) lists."""
    return Check(source, partial(snmp, names=names), (), "snmp")


def mysql(df: DataFrame) -> DataFrame:
    """Tab-separated status rows."""
    rows = extract_kv_lines(df, "\t")
    gauge = F.col("name").isin(*STATUS_GAUGES)
    return rows.withColumn("style", F.when(gauge, "gauge").otherwise("rate")).withColumn(
        "name", F.concat(F.lit("mysql_"), F.lower("name"))
    )


def tomcat(df: DataFrame) -> DataFrame:
    """Memory pools, thread counts and the numbered durations of the last collections."""
    keep = scrape_columns(df)
    rows = lines(df)
    heap = F.regexp_extract("line", r"^(NonHeap|Heap)MemoryUsage", 1)
    fields_ = F.arrays_zip(
        F.regexp_extract_all("line", F.lit(r"(\w+)=(\d+)"), F.lit(1)).alias("key"),
        F.regexp_extract_all("line", F.lit(r"(\w+)=(\d+)"), F.lit(2)).alias("value"),
    )
    memory_ = rows.filter(heap != "").select(
        *keep, "seq", F.lower(heap).alias("_heap"), F.explode(fields_).alias("_f")
    ).select(*keep, "seq", F.concat(F.lit("tomcat_"), "_heap", F.lit("_"), "_f.key").alias("name"), F.col("_f.value").alias("value_raw"))
    threads = rows.withColumn("_key", F.regexp_extract("line", r"^(\w+):?\s+(\d+)$", 1)).filter(
        F.col("_key").isin(*TOMCAT_THREADS)
    ).select(*keep, "seq", F.concat(F.lit("tomcat_"), F.lower("_key")).alias("name"),
             F.regexp_extract("line", r"^(\w+):?\s+(\d+)$", 2).alias("value_raw"))
    gc = extract_all_indexed(df, r"duration=([+-]?\d+(?:\.\d+)?)").select(
        *keep, F.col("idx").cast("bigint").alias("seq"),
        F.concat(F.lit("tomcat_lastgc_"), F.col("idx").cast("string")).alias("name"), "value_raw",
    )
    return finish(union_sources(memory_, threads, gc), keep)


for _name, _check in {
    "redis": Check("redis", partial(extract_kv_lines, sep=":", last_wins=True), REDIS, "redis"),
    "memcached": Check("memcached", partial(extract_kv_lines, sep=" ", prefix="STAT "), MEMCACHED, "memcached"),
    "apache": Check("apache", partial(extract_kv_lines, sep=":"), APACHE, "apache"),
    "lighttpd": Check("lighttpd", _short_kv, LIGHTTPD, "lighttpd"),
    "nginx": Check("nginx", partial(extract_positional, spec=NGINX), NGINX_RECIPES, "nginx"),
    "phpfpm": Check("phpfpm", partial(extract_positional, spec=PHPFPM), PHPFPM_RECIPES, "php-fpm"),
    "zookeeper": Check("zookeeper", zookeeper, (), "zookeeper"),
    "memory": Check("memory", memory, (), "system", health=(
        Health("mem_used_percent", "Memory-Usage", text="Systems memory usage is"),
    )),
    "haproxy": Check("haproxy", haproxy, HAPROXY, "haproxy"),
    "load_average": Check("load_average", load_average, (), "system", health=(
        Health("sys_load_percent", "Load-Average", text="System Load average is at", after=" percent of available  resources", emit_ok=True),
    )),
    "ipconntrack": Check("ipconntrack", partial(extract_positional, spec=CONNTRACK), (), "system"),
    "disk_io": Check("disk_io", disk_io, (), "system"),
    "disk_bytes": Check("disk_bytes", disk_bytes, (), "system"),
    "mounts": Check("mounts", mounts, (), "system", health=(
        Health("drive_percent_used", "Disk-Usage-{entity}", text="Storage usage of {entity} is at", after=" percent of available  space", tag="mountpoint"),
    )),
    "network_bytes": Check("network_bytes", interfaces, (), "system", derive=interface_rates),
    "cpu": Check("cpu", cpu_times, (), "gauge", derive=core_shares, health=(
        Health("cpu_load", "CPU-Load-{entity}", text="CPU load is at", tag="core"),
    )),
    "btrfs": Check("btrfs", btrfs, (), "system"),
    "btrfs_errors": Check("btrfs", btrfs_errors, (), "system", health=(
        Health("btrfs_io_errors", "BTRFS ", kind="counter", tag="counter"),
    )),
    "tcpconn": Check("tcpconn", sockets, (), "system"),
    "udpconn": Check("udpconn", udp_sockets, (), "system"),
    "mysql": Check("mysql", mysql, (), "mysql"),
    "tomcat": Check("tomcat", tomcat, (), "tomcat"),
    "scripts": Check("scripts", script),
}.items():
    register(_name, _check)
