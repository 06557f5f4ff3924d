"""Registered queries: payloads rendered from whole tables, extracted back.

The SQL side reads the source columns and never parses a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import dedup_last, histogram_quantile
from tidemark.functions.numbers import fixed
from tidemark.sources import beans, documents, exposition, status, text
from tidemark.plans.tables import cents, table


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(*rows: Column) -> Column:
    return F.concat_ws("\n", *rows)


def _num(col: str) -> Column:
    return F.col(col).cast("string")


def exposition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per line item: comments, labelled and bare lines, an odd label."""
    li = table(spark, sf_dir, "lineitem")
    payload = _lines(
        F.lit("# HELP price_cents Extended price."),
        F.lit("# TYPE price_cents counter"),
        _text('price_cents{flag="', F.col("l_returnflag"), '",note="a,b={c}"} ', cents("l_extendedprice").cast("string")),
        _text("quantity ", _num("l_quantity")),
        F.lit("{broken"),
        _text('supp{supplier="', _num("l_suppkey"), '"} ', _num("l_suppkey"), " 1700000000"),
    )
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", payload.alias("payload"))
    out = exposition.extract_exposition(df)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "seq", "name",
        F.array_join(F.transform(F.array_sort(F.map_entries("tags")),
                                 lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("tags"),
        "value", "value_kind",
    )


def exposition_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latency histogram per customer as exposition text, then its quantiles."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.abs(F.floor("c_acctbal")).cast("bigint").alias("n"))
    n = F.col("n")
    payload = _lines(
        F.lit("# TYPE latency histogram"),
        _text('latency_bucket{le="0.1"} ', F.floor(n / 4).cast("string")),
        _text('latency_bucket{le="10"} ', n.cast("string")),
        _text('latency_bucket{le="2.5"} ', F.floor(n / 2).cast("string")),
        _text('latency_bucket{le="+Inf"} ', n.cast("string")),
    )
    rows = exposition.buckets(exposition.extract_exposition(c.select("c_custkey", payload.alias("payload"))))
    out = histogram_quantile(rows, ("c_custkey", "name"))
    return out.withColumn("value", fixed(F.col("value"), 4))


def bean_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bean array per supplier: nested memory, a wanted counter, an unwanted one."""
    s = table(spark, sf_dir, "supplier")
    payload = _text(
        '{"beans":[{"name":"java.lang:type=Memory","HeapMemoryUsage":{"used":', _num("s_suppkey"),
        ',"max":1000}},{"name":"Hadoop:name=Info","Capacity":', _num("s_acctbal"), ',"Unwanted":1},'
        '{"name":"third","State":"', F.col("s_name"), '","Missing":null}]}',
    )
    out = beans.extract_bean_array(
        s.select("s_suppkey", payload.alias("payload")), ["HeapMemoryUsage", "Capacity", "State", "Missing"]
    )
    return out.select("s_suppkey", "seq", F.col("tags")["bean"].alias("bean"), "name", "value_raw", "value", "value_kind")


def bean_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bean map per customer, with topic and name taken out of the bean key."""
    c = table(spark, sf_dir, "customer")
    payload = _text(
        '{"value":{"kafka:type=Topics,name=In,topic=', F.col("c_mktsegment"), '":{"Count":', _num("c_custkey"),
        ',"Rate":{"mean":1.5}},"java:type=Threading":{"Threads":', _num("c_nationkey"), "}}}",
    )
    out = beans.extract_bean_map(
        c.select("c_custkey", payload.alias("payload")), properties=("topic", "name")
    )
    return out.select(
        "c_custkey", F.col("tags")["topic"].alias("topic"), F.try_element_at("tags", F.lit("name")).alias("prop"),
        "name", "value", "value_kind",
    )


def bean_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector beans per customer; every second kind has no last collection."""
    c = table(spark, sf_dir, "customer")
    payload = _text(
        '{"value":{"a:name=G1 Young Generation,type=GC":{"Name":"G1 Young Generation","CollectionCount":',
        _num("c_custkey"), ',"CollectionTime":', _num("c_nationkey"), ',"LastGcInfo":null},'
        '"a:name=ConcurrentMarkSweep,type=GC":{"Name":"ConcurrentMarkSweep","CollectionTime":7,'
        '"LastGcInfo":{"duration":', _num("c_custkey"), "}}}}",
    )
    out = beans.collector_stats(c.select("c_custkey", payload.alias("payload")))
    return out.select("c_custkey", "collector", "name", "value")


ORDER_PATHS = (
    documents.Path("$.jvm.mem.heap", "heap"),
    documents.Path("$.indices.docs[0].count", "docs", "rate"),
    documents.Path("$.status", "status"),
    documents.Path("$.absent.path", "absent"),
)


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document per order, listed paths picked out."""
    o = table(spark, sf_dir, "orders")
    payload = _text(
        '{"jvm":{"mem":{"heap":', cents("o_totalprice").cast("string"), '}},"indices":{"docs":[{"count":',
        _num("o_custkey"), '}]},"status":"', F.col("o_orderstatus"), '"}',
    )
    out = documents.extract_paths(o.select("o_orderkey", payload.alias("payload")), ORDER_PATHS)
    return out.select("o_orderkey", "name", "style", "value_raw", "value", "value_kind")


def json_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of nodes per order; paths applied to every child, key as tag."""
    o = table(spark, sf_dir, "orders")
    payload = _text(
        '{"nodes":{"n1":{"up":', _num("o_orderkey"), '},"n2":{"up":', _num("o_custkey"), ',"load":0.5}}}'
    )
    out = documents.extract_paths(
        o.select("o_orderkey", payload.alias("payload")),
        (documents.Path("$.up", "up"), documents.Path("$.load", "load")),
        each="$.nodes", tag="node",
    )
    return out.select("o_orderkey", F.col("tags")["node"].alias("node"), "name", "value", "value_kind")


def named_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A telemetry document of named stats per part, samples by count."""
    p = table(spark, sf_dir, "part")
    payload = _text(
        '{"Gauges":[{"Name":"app.p-size","Value":', _num("p_size"), ',"Labels":{"brand":"', F.col("p_brand"),
        '"}}],"Counters":[{"Name":"app.hits","Rate":', _num("p_retailprice"),
        ',"Count":1}],"Samples":[{"Name":"app.lat","Rate":0.5,"Count":', _num("p_partkey"), "}]}",
    )
    out = documents.extract_named_arrays(p.select("p_partkey", payload.alias("payload")), "Count")
    return out.select(
        "p_partkey", "section", documents.plain_stat_name(F.col("name")).alias("name"),
        F.try_element_at("tags", F.lit("brand")).alias("brand"), "value",
    )


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value page per order, one key repeated: the last one wins."""
    o = table(spark, sf_dir, "orders")
    payload = F.concat_ws(
        "\r\n",
        F.lit("# Server"),
        _text("used_memory:", cents("o_totalprice").cast("string")),
        _text("custkey: ", _num("o_custkey")),
        _text("status:", F.col("o_orderstatus"), ":extra"),
        _text("custkey: ", _num("o_orderkey")),
    )
    df = o.select(F.col("o_orderkey").alias("host"), F.lit("s").alias("scrape_id"), payload.alias("payload"))
    out = dedup_last(text.extract_kv_lines(df, ":").drop("tags"))
    return out.select(F.col("host").alias("o_orderkey"), "name", "value_raw", "value", "value_kind")


def kv_lines_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-separated lines behind a prefix, and values followed by a unit."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    stat = p.select("p_partkey", _lines(_text("STAT size ", _num("p_size")), F.lit("END")).alias("payload"))
    mem = p.select("p_partkey", _lines(_text("MemTotal:   ", _num("p_retailprice"), " kB"), F.lit("nothing")).alias("payload"))
    one = text.extract_kv_lines(stat, " ", prefix="STAT ")
    two = text.extract_kv_lines(mem, ":", first_token=True)
    return one.union(two).select("p_partkey", "name", "value")


STATUS_PAGE = (
    text.Cell("connections", 0, 2), text.Cell("accepts", 2, 0), text.Cell("handled", 2, 1),
    text.Cell("requests", 2, 2), text.Cell("reading", 3, 1), text.Cell("waiting", 3, 5),
    text.Cell("absent", 9, 0),
)


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-line status page per order."""
    o = table(spark, sf_dir, "orders")
    payload = _lines(
        _text("Active connections: ", _num("o_custkey"), " "),
        F.lit("server accepts handled requests"),
        _text(" ", _num("o_orderkey"), " ", _num("o_custkey"), " ", cents("o_totalprice").cast("string"), " "),
        F.lit("Reading: 0 Writing: 1 Waiting: 2"),
    )
    out = text.extract_positional(o.select("o_orderkey", payload.alias("payload")), STATUS_PAGE)
    return out.select("o_orderkey", "name", "value")


def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A socket table per order behind a header line."""
    o = table(spark, sf_dir, "orders")
    payload = _lines(
        F.lit("  sl  local_address rem_address   st"),
        _text("   0: ", _num("o_orderkey"), ":1F90 00000000:0000 ", F.col("o_orderstatus"), " x"),
        _text("   1: ", _num("o_custkey"), ":0050 00000000:0000 0A x"),
    )
    out = text.extract_columns(o.select("o_orderkey", payload.alias("payload")), {"local": 1, "st": 3, "none": 9}, skip=1)
    return out.select("o_orderkey", "seq", "local", "st", "none")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proxy statistics page per part: back-end rows, blank cells skipped, a quoted cell."""
    p = table(spark, sf_dir, "part")
    payload = _lines(
        F.lit("# pxname,svname,rate,note,size"),
        _text("web", _num("p_partkey"), ",BACKEND,", _num("p_size"), ",,", _num("p_retailprice")),
        _text("web", _num("p_partkey"), ',FRONTEND,1,"', F.col("p_name"), ', ""x""",2'),
    )
    out = text.extract_csv(p.select("p_partkey", payload.alias("payload")), ids=("pxname", "svname"))
    return out.select("p_partkey", "pxname", "svname", "name", "value_raw", "value")


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plug-in output per supplier; an unknown style is left out."""
    s = table(spark, sf_dir, "supplier")
    payload = _lines(
        _text("m_key ", _num("s_suppkey"), " gauge stack"),
        _text("m_bal ", _num("s_acctbal"), " gauge rate"),
        F.lit("m_odd 1 gauge other"),
    )
    out = text.extract_script_lines(s.select("s_suppkey", payload.alias("payload")))
    return out.select("s_suppkey", "name", "type", "style", "value")


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status variables read off customers: market segments stand for variables."""
    c = table(spark, sf_dir, "customer")
    variable = F.when(F.col("c_mktsegment") == "BUILDING", "Open_files").otherwise(F.col("c_mktsegment"))
    df = c.select("c_custkey", variable.alias("variable"), F.col("c_acctbal").alias("value"))
    return status.extract_status_rows(df).select("c_custkey", "name", "style", "value")


NAMED_QUERIES = {
    "order_count": "SELECT count(*) FROM tm_orders",
    "largest_customer": "SELECT o_custkey FROM tm_orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1",
    "top_prices": "SELECT o_totalprice FROM tm_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
}


def named_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named scalar queries over a view, one of them a top five."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tm_orders")
    out = status.run_named_queries(spark, NAMED_QUERIES)
    return out.select("name", F.col("tags")["prettyname"].alias("prettyname"), "value")


QUERIES = {
    "exposition_lines": exposition_lines,
    "exposition_histogram": exposition_histogram,
    "bean_array": bean_array,
    "bean_map": bean_map,
    "bean_collectors": bean_collectors,
    "json_paths": json_paths,
    "json_children": json_children,
    "named_arrays": named_arrays,
    "kv_lines": kv_lines,
    "kv_lines_unit": kv_lines_unit,
    "positional": positional,
    "fixed_columns": fixed_columns,
    "csv_rows": csv_rows,
    "script_lines": script_lines,
    "status_rows": status_rows,
    "named_queries": named_queries,
}


def _union(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


ORACLE = {
    "exposition_lines": _union(
        """SELECT l_orderkey, l_linenumber, l_partkey, CAST(2 AS BIGINT) AS seq, 'price_cents' AS name,
           'flag=' || l_returnflag || ';note=a,b={c}' AS tags, CAST(round(l_extendedprice * 100) AS DOUBLE) AS value,
           'int' AS value_kind FROM lineitem""",
        "SELECT l_orderkey, l_linenumber, l_partkey, 3, 'quantity', '', l_quantity, 'float' FROM lineitem",
        """SELECT l_orderkey, l_linenumber, l_partkey, 5, 'supp', 'supplier=' || l_suppkey, CAST(l_suppkey AS DOUBLE), 'int'
           FROM lineitem""",
    ),
    "exposition_histogram": """
WITH c AS (SELECT c_custkey, CAST(abs(floor(c_acctbal)) AS BIGINT) AS n FROM customer),
h AS (SELECT c_custkey, 0.1::DOUBLE AS bound, CAST(n // 4 AS DOUBLE) AS cnt, n FROM c
      UNION ALL SELECT c_custkey, 2.5, n // 2, n FROM c UNION ALL SELECT c_custkey, 10, n, n FROM c
      UNION ALL SELECT c_custkey, CAST('infinity' AS DOUBLE), n, n FROM c),
p AS (SELECT *, lag(bound, 1, 0.0) OVER w AS pb, lag(cnt, 1, 0.0) OVER w AS pc
      FROM h WINDOW w AS (PARTITION BY c_custkey ORDER BY bound)),
q(q) AS (VALUES (0.50::DOUBLE), (0.75), (0.85), (0.90), (0.95), (0.99)),
f AS (SELECT c_custkey, q, CASE WHEN n = 0 THEN NULL WHEN cnt - pc = 0 THEN bound
             ELSE pb + ((q * n - pc) / (cnt - pc)) * (bound - pb) END AS value
      FROM p, q WHERE cnt >= q * n
      QUALIFY row_number() OVER (PARTITION BY c_custkey, q ORDER BY bound) = 1)
SELECT c_custkey, 'latency' AS name, q, CAST(format('{:.4f}', value) AS DOUBLE) AS value FROM f
""",
    "bean_array": _union(
        """SELECT s_suppkey, CAST(0 AS BIGINT) AS seq, 'java.lang:type=Memory' AS bean, 'HeapMemoryUsage.used' AS name,
           CAST(s_suppkey AS VARCHAR) AS value_raw, CAST(s_suppkey AS DOUBLE) AS value, 'int' AS value_kind FROM supplier""",
        """SELECT s_suppkey, 0, 'java.lang:type=Memory', 'HeapMemoryUsage.max', '1000', 1000, 'int' FROM supplier""",
        """SELECT s_suppkey, 1, 'Hadoop:name=Info', 'Capacity', rtrim(rtrim(format('{:.2f}', s_acctbal), '0'), '.'),
           s_acctbal, 'float' FROM supplier""",
        "SELECT s_suppkey, 2, 'third', 'State', s_name, NULL, 'str' FROM supplier",
    ),
    "bean_map": _union(
        """SELECT c_custkey, c_mktsegment AS topic, 'In' AS prop, 'Count' AS name, CAST(c_custkey AS DOUBLE) AS value,
           'int' AS value_kind FROM customer""",
        "SELECT c_custkey, c_mktsegment, 'In', 'Rate.mean', 1.5, 'float' FROM customer",
        "SELECT c_custkey, NULL, NULL, 'Threads', c_nationkey, 'int' FROM customer",
    ),
    "bean_collectors": _union(
        "SELECT c_custkey, 'G1 Young Generation' AS collector, 'last' AS name, CAST(0 AS BIGINT) AS value FROM customer",
        "SELECT c_custkey, 'G1 Young Generation', 'count', c_custkey FROM customer",
        "SELECT c_custkey, 'G1 Young Generation', 'time', c_nationkey FROM customer",
        "SELECT c_custkey, 'ConcurrentMarkSweep', 'last', c_custkey FROM customer",
        "SELECT c_custkey, 'ConcurrentMarkSweep', 'count', 0 FROM customer",
        "SELECT c_custkey, 'ConcurrentMarkSweep', 'time', 7 FROM customer",
    ),
    "json_paths": _union(
        """SELECT o_orderkey, 'heap' AS name, 'gauge' AS style, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value_raw,
           CAST(round(o_totalprice * 100) AS DOUBLE) AS value, 'int' AS value_kind FROM orders""",
        "SELECT o_orderkey, 'docs', 'rate', CAST(o_custkey AS VARCHAR), o_custkey, 'int' FROM orders",
        "SELECT o_orderkey, 'status', 'gauge', o_orderstatus, NULL, 'str' FROM orders",
    ),
    "json_children": _union(
        "SELECT o_orderkey, 'n1' AS node, 'up' AS name, CAST(o_orderkey AS DOUBLE) AS value, 'int' AS value_kind FROM orders",
        "SELECT o_orderkey, 'n2', 'up', o_custkey, 'int' FROM orders",
        "SELECT o_orderkey, 'n2', 'load', 0.5, 'float' FROM orders",
    ),
    "named_arrays": _union(
        """SELECT p_partkey, 'Gauges' AS section, 'app_p_size' AS name, p_brand AS brand, CAST(p_size AS DOUBLE) AS value
           FROM part""",
        "SELECT p_partkey, 'Counters', 'app_hits', NULL, p_retailprice FROM part",
        "SELECT p_partkey, 'Samples', 'app_lat', NULL, p_partkey FROM part",
    ),
    "kv_lines": _union(
        """SELECT o_orderkey, 'used_memory' AS name, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value_raw,
           CAST(round(o_totalprice * 100) AS DOUBLE) AS value, 'int' AS value_kind FROM orders""",
        "SELECT o_orderkey, 'custkey', CAST(o_orderkey AS VARCHAR), o_orderkey, 'int' FROM orders",
        "SELECT o_orderkey, 'status', o_orderstatus || ':extra', NULL, 'str' FROM orders",
    ),
    "kv_lines_unit": _union(
        "SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part",
        "SELECT p_partkey, 'MemTotal', p_retailprice FROM part",
    ),
    "positional": _union(
        "SELECT o_orderkey, 'connections' AS name, CAST(o_custkey AS DOUBLE) AS value FROM orders",
        "SELECT o_orderkey, 'accepts', o_orderkey FROM orders",
        "SELECT o_orderkey, 'handled', o_custkey FROM orders",
        "SELECT o_orderkey, 'requests', round(o_totalprice * 100) FROM orders",
        "SELECT o_orderkey, 'reading', 0 FROM orders",
        "SELECT o_orderkey, 'waiting', 2 FROM orders",
    ),
    "fixed_columns": _union(
        """SELECT o_orderkey, CAST(1 AS BIGINT) AS seq, o_orderkey || ':1F90' AS local, o_orderstatus AS st,
           CAST(NULL AS VARCHAR) AS none FROM orders""",
        "SELECT o_orderkey, 2, o_custkey || ':0050', '0A', NULL FROM orders",
    ),
    "csv_rows": _union(
        """SELECT p_partkey, 'web' || p_partkey AS pxname, 'BACKEND' AS svname, 'rate' AS name,
           CAST(p_size AS VARCHAR) AS value_raw, CAST(p_size AS DOUBLE) AS value FROM part""",
        "SELECT p_partkey, 'web' || p_partkey, 'BACKEND', 'size', CAST(p_retailprice AS VARCHAR), p_retailprice FROM part",
        "SELECT p_partkey, 'web' || p_partkey, 'FRONTEND', 'rate', '1', 1 FROM part",
        "SELECT p_partkey, 'web' || p_partkey, 'FRONTEND', 'note', p_name || ', \"x\"', NULL FROM part",
        "SELECT p_partkey, 'web' || p_partkey, 'FRONTEND', 'size', '2', 2 FROM part",
    ),
    "script_lines": _union(
        "SELECT s_suppkey, 'm_key' AS name, 'gauge' AS type, 'gauge' AS style, CAST(s_suppkey AS DOUBLE) AS value FROM supplier",
        "SELECT s_suppkey, 'm_bal', 'gauge', 'rate', s_acctbal FROM supplier",
    ),
    "status_rows": """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'mysql_open_files' ELSE 'mysql_' || lower(c_mktsegment) END AS name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'gauge' ELSE 'rate' END AS style, c_acctbal AS value FROM customer
""",
    "named_queries": """
SELECT 'mysql_custom_querry' AS name, 'order_count' AS prettyname, CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL (SELECT 'mysql_custom_querry', 'largest_customer', o_custkey FROM orders GROUP BY o_custkey
           ORDER BY count(*) DESC, o_custkey LIMIT 1)
UNION ALL (SELECT 'mysql_custom_querry', 'top_prices', o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
""",
}
