"""Registered queries: envelope, tags, naming, typing, scaling and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as n
from tidemark.functions import text as t
from tidemark.operators import filters as flt
from tidemark.operators import projections as prj
from tidemark.plans.tables import cents, event_samples, table


def _kv(col: Column) -> Column:
    """Map as sorted `k=v` text."""
    pairs = F.transform(
        F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(pairs, ",")


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a segment get a default host and type; HOUSEHOLD plays the missing value."""
    seg = F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD"))
    df = table(spark, sf_dir, "customer").select("c_custkey", seg.alias("host"), seg.alias("check_type"))
    return prj.normalise(df, "collector-1")


def with_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity tags from the nation of a customer; the sample's own tag overrides location."""
    nation = table(spark, sf_dir, "nation")
    identity = nation.select(
        F.col("n_name").alias("host"),
        F.concat(F.lit("cluster"), F.col("n_regionkey")).alias("cluster"),
        F.lit("web").alias("group"),
        F.lit("earth").alias("location"),
    )
    c = table(spark, sf_dir, "customer")
    df = c.select(
        "c_custkey",
        F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("host"),
        F.lit("gauge").alias("check_type"),
        F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("location"), F.col("c_mktsegment"))).alias("tags"),
    )
    return prj.with_identity(df, identity).select("c_custkey", _kv(F.col("all_tags")).alias("all_tags"))


def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    return prj.melt(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, camelCase to snake, chained replacements, GC names, paths."""
    p = table(spark, sf_dir, "part")
    camel = F.concat(F.lit("total"), F.initcap("p_type"), F.lit("Size"))
    dotted = F.concat(F.lit("a.b-"), F.col("p_brand"))
    gc = F.concat(F.upper(F.split("p_name", " ")[0]), F.lit(" Old Generation"))
    path = F.concat(F.lit("/mnt/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/"))
    df = p.select("p_partkey", camel.alias("name"), dotted.alias("dotted"), gc.alias("gc"), path.alias("path"))
    df = prj.rename(df, [t.snake, lambda c: F.concat(F.lit("part_"), c)])
    return df.select(
        "p_partkey",
        "name",
        F.lower(t.replace_chain(F.col("dotted"), [(".", "_"), ("-", "_"), ("#", "")])).alias("dotted"),
        t.gc_name(F.col("gc")).alias("gc"),
        t.path_tag(F.col("path")).alias("path"),
    )


def typed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer, float and unreadable text out of part columns."""
    raw = (
        F.when(F.col("p_size") < 15, F.col("p_size").cast("string"))
        .when(F.col("p_size") < 30, F.col("p_retailprice").cast("string"))
        .when(F.col("p_size") < 45, F.col("p_name"))
    )
    df = table(spark, sf_dir, "part").select("p_partkey", raw.alias("value_raw"))
    return prj.typed_value(df)


def default_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without priority 1 lack the price; an absent column appears."""
    price = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    return prj.default_missing(df, {"price": 0.0, "degraded": "0.0"})


def keep_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(
        F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"),
        F.lit("name"), F.col("c_name"),
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", tags.alias("tags"))
    return prj.keep_tags(df, ["segment", "nation"]).select("c_custkey", _kv(F.col("tags")).alias("tags"))


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and type chosen by the metric's prefix."""
    df = event_samples(spark, sf_dir).select("seq", "name", "check_type", "value")
    return prj.route(
        df,
        [
            (F.col("name").startswith("err"), {"name": F.lit("errors"), "check_type": F.lit("counter")}),
            (F.col("name").isin("click", "view"), {"name": F.concat(F.lit("ui_"), F.col("name"))}),
        ],
    )


def percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percent forms over siblings of a line item."""
    li = table(spark, sf_dir, "lineitem")
    df = prj.percent(li, "l_tax", "l_discount")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        n.fixed(F.col("percent"), 4).alias("percent"),
        n.fixed(n.percent_rest(F.col("l_quantity"), F.lit(50.0)), 4).alias("used"),
        n.fixed(n.percent_share(F.col("l_quantity"), F.col("l_linenumber")), 4).alias("share"),
    )


def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KB to bytes, sectors by sector size, per minute to per second."""
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("bigint").alias("kb"), F.col("p_partkey").alias("sectors"),
        F.col("p_size").cast("bigint").alias("per_minute"),
    )
    df = prj.scale(df, F.col("kb"), "sectors")
    df = prj.scale(df, 1024, "kb")
    return df.withColumn("per_second", n.fixed(n.ratio(F.col("per_minute"), F.lit(60)), 4)).drop("per_minute")


def url_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint tag of every page, with a port injected into http pages."""
    with_port = F.when(
        F.col("url").startswith("http:"),
        F.regexp_replace("url", r"^(http://[^/]+)", F.lit("$1:8080")),
    ).otherwise(F.col("url"))
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", t.url_endpoint(F.col("url")).alias("plain"), t.url_endpoint(with_port).alias("ported")
    )


def short_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host part of page URLs, and customer names (not valid host names)."""
    pages = table(spark, sf_dir, "pages").select(t.url_host(F.col("url")).alias("host"))
    names = table(spark, sf_dir, "customer").select(
        F.concat(F.col("c_name"), F.lit(".example.org")).alias("host")
    )
    return pages.union(names).select("host", t.short_host(F.col("host")).alias("short"))


def percent_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text summaries rendered from parts; every brand ending in 5 has none."""
    text = F.when(
        ~F.col("p_brand").endswith("5"),
        F.concat(F.lit("Degraded data: "), F.col("p_partkey"), F.lit(" objects ("), F.col("p_size"), F.lit(".5%)")),
    ).otherwise("no percent here")
    return table(spark, sf_dir, "part").select("p_partkey", t.percent_from_text(text).alias("percent"))


def extract_all_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of every page, numbered."""
    out = prj.extract_all_indexed(
        table(spark, sf_dir, "pages").select("page_id", "html"), r'href="([^"]*)"', "html"
    )
    return out.select("page_id", "idx", "value_raw")


def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.allow(event_samples(spark, sf_dir), ["click", "error"]).select("seq", "name", "value")


def allow_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers of one segment, through a dimension."""
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return flt.allow(table(spark, sf_dir, "orders"), wanted, "o_custkey").select("o_orderkey", "o_custkey")


def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.contains_any(table(spark, sf_dir, "part"), "p_name", ["ring", "red", "big"]).select("p_partkey", "p_name")


def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup lines by prefix, without some substrings."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("pos", "line"))
    return flt.line_filter(lines, ["p>", "li>", "a "], ["ad", "%"])


def require(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both labels present after an outer join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return flt.require(docs.join(labels, "doc_id", "left"), ["quality", "toxic"])


def value_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive balances, non-negative remainders, all-digit text."""
    c = table(spark, sf_dir, "customer")
    digits = F.regexp_extract("c_name", "#(.*)$", 1)
    keep = (
        flt.positive(F.col("c_acctbal")) & flt.non_negative(F.col("c_acctbal") - 1000) & flt.digits_only(digits)
    )
    return c.filter(keep).select("c_custkey", "c_acctbal")


def entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device names built from parts: partitions, loop devices and loopback are left out."""
    kind = F.col("p_size") % 5
    device = (
        F.when(kind == 0, "sda").when(kind == 1, "sda1").when(kind == 2, "loop0")
        .when(kind == 3, "nvme0n1p2").otherwise("nvme0n1")
    )
    nic = F.when(kind == 0, "lo").otherwise("eth0")
    df = table(spark, sf_dir, "part").select("p_partkey", device.alias("device"), nic.alias("nic"))
    return df.filter(flt.whole_disk(F.col("device")) & flt.not_loopback(F.col("nic")))


def allow_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured list restricts; an empty one lets every order through."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    some = flt.allow_or_all(orders, ["F", "P"], "o_orderstatus").withColumn("list", F.lit("some"))
    every = flt.allow_or_all(orders, [], "o_orderstatus").withColumn("list", F.lit("none"))
    return some.union(every)


def allow_or_all_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list as a table: the segments with customers in debt, and one that holds nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    debts = table(spark, sf_dir, "customer").filter("c_acctbal < -500").select("c_nationkey")
    some = flt.allow_or_all(c, debts, "c_nationkey").withColumn("list", F.lit("some"))
    every = flt.allow_or_all(c, debts.filter("c_nationkey < 0"), "c_nationkey").withColumn("list", F.lit("none"))
    return some.union(every)


def as_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer reading: text with a fraction fails, a float is truncated."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") < 25, "float").otherwise("str")
    value = n.as_int(F.col("p_retailprice").cast("string"), kind, F.col("p_retailprice"))
    return p.select("p_partkey", value.alias("counter"))


def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point rounding of price ratios, the form every rate goes through."""
    li = table(spark, sf_dir, "lineitem")
    unit = n.ratio(cents("l_extendedprice"), F.col("l_quantity") * 100)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", n.fixed(unit).alias("unit"))


QUERIES = {
    "normalise": normalise,
    "with_identity": with_identity,
    "melt": melt,
    "rename": rename,
    "typed_value": typed_value,
    "default_missing": default_missing,
    "keep_tags": keep_tags,
    "route": route,
    "percents": percents,
    "scale": scale,
    "url_endpoint": url_endpoint,
    "short_host": short_host,
    "percent_from_text": percent_from_text,
    "extract_all_indexed": extract_all_indexed,
    "allow_list": allow_list,
    "allow_dimension": allow_dimension,
    "contains_any": contains_any,
    "line_filter": line_filter,
    "require": require,
    "value_filters": value_filters,
    "entity_filter": entity_filter,
    "allow_or_all": allow_or_all,
    "allow_or_all_frame": allow_or_all_frame,
    "as_int": as_int,
    "fixed_point": fixed_point,
}


def _f4(expr: str) -> str:
    return f"CAST(format('{{:.4f}}', {expr}) AS DOUBLE) + 0.0"


ORACLE = {
    "normalise": """
SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'collector-1' ELSE c_mktsegment END AS host,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'untyped' ELSE c_mktsegment END AS check_type FROM customer
""",
    "with_identity": """
SELECT c_custkey, 'cluster=cluster' || n_regionkey || ',group=web,host=' || n_name || ',location='
       || CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'earth' END || ',type=gauge' AS all_tags
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "melt": """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
""",
    "rename": """
SELECT p_partkey, 'part_total_' || lower(p_type) || '_size' AS name,
       'a_b_' || lower(replace(p_brand, '#', '')) AS dotted,
       lower(split_part(p_name, ' ', 1)) || '_old' AS gc,
       'mnt_' || replace(p_name, ' ', '_') AS path FROM part
""",
    "typed_value": """
SELECT p_partkey,
       CASE WHEN p_size < 15 THEN CAST(p_size AS VARCHAR) WHEN p_size < 30 THEN CAST(p_retailprice AS VARCHAR)
            WHEN p_size < 45 THEN p_name END AS value_raw,
       CASE WHEN p_size < 15 THEN CAST(p_size AS DOUBLE) WHEN p_size < 30 THEN p_retailprice END AS value,
       CASE WHEN p_size < 15 THEN 'int' WHEN p_size < 30 THEN 'float' WHEN p_size < 45 THEN 'str' END AS value_kind
FROM part
""",
    "default_missing": """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0 ELSE o_totalprice END AS price,
       '0.0' AS degraded FROM orders
""",
    "keep_tags": """
SELECT c_custkey, 'nation=' || c_nationkey || ',segment=' || c_mktsegment AS tags FROM customer
""",
    "route": """
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'errors'
         WHEN event_type IN ('click', 'view') THEN 'ui_' || event_type ELSE event_type END AS name,
       CASE WHEN event_type = 'error' THEN 'counter' ELSE 'gauge' END AS check_type, value FROM events
""",
    "percents": "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN "
    + _f4("l_tax * 100 / l_discount") + " END AS percent, "
    + _f4("100.0::DOUBLE - l_quantity * 100 / 50.0::DOUBLE") + " AS used, "
    + _f4("l_quantity / (l_quantity + l_linenumber) * 100") + " AS share FROM lineitem",
    "scale": "SELECT p_partkey, CAST(p_size AS BIGINT) * 1024 AS kb, p_partkey * p_size AS sectors, "
    + _f4("p_size / 60.0::DOUBLE") + " AS per_second FROM part",
    "url_endpoint": """
WITH h AS (SELECT page_id, url, replace(regexp_extract(url, '://([^/?#]+)', 1), '.', '_') AS host FROM pages)
SELECT page_id, host || CASE WHEN starts_with(url, 'https') THEN '_443' ELSE '_80' END AS plain,
       host || CASE WHEN starts_with(url, 'https') THEN '_443' ELSE '_8080' END AS ported FROM h
""",
    "short_host": """
WITH h AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages
           UNION ALL SELECT c_name || '.example.org' FROM customer)
SELECT host, CASE WHEN regexp_matches(host, '^[a-z0-9.-]+$') THEN split_part(host, '.', 1)
                  ELSE replace(host, '.', '_') END AS short FROM h
""",
    "percent_from_text": """
SELECT p_partkey, CASE WHEN suffix(p_brand, '5') THEN 0.0 ELSE p_size + 0.5::DOUBLE END AS percent FROM part
""",
    "extract_all_indexed": """
WITH m AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS idx, found[i] AS value_raw
FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM m)
""",
    "allow_list": "SELECT event_id AS seq, event_type AS name, value FROM events WHERE event_type IN ('click', 'error')",
    "allow_dimension": """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""",
    "contains_any": """
SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%red%' OR p_name LIKE '%big%'
""",
    "line_filter": """
WITH l AS (SELECT page_id, string_split(html, '<') AS parts FROM pages),
x AS (SELECT page_id, CAST(i - 1 AS INT) AS pos, parts[i] AS line
      FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l))
SELECT * FROM x WHERE (starts_with(line, 'p>') OR starts_with(line, 'li>') OR starts_with(line, 'a '))
                  AND NOT contains(line, 'ad') AND NOT contains(line, '%') AND NOT starts_with(line, '#')
""",
    "require": "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "value_filters": """
SELECT c_custkey, c_acctbal FROM customer
WHERE c_acctbal > 0 AND c_acctbal >= 1000 AND regexp_matches(split_part(c_name, '#', 2), '^[0-9]+$')
""",
    "entity_filter": """
SELECT p_partkey, 'nvme0n1' AS device, 'eth0' AS nic FROM part WHERE p_size % 5 = 4
""",
    "allow_or_all": """
SELECT o_orderkey, o_orderstatus, 'some' AS list FROM orders WHERE o_orderstatus IN ('F', 'P')
UNION ALL SELECT o_orderkey, o_orderstatus, 'none' FROM orders
""",
    "allow_or_all_frame": """
SELECT c_custkey, c_mktsegment, c_nationkey, 'some' AS list FROM customer
WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -500)
UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey, 'none' FROM customer
""",
    "as_int": """
SELECT p_partkey, CASE WHEN p_size < 25 THEN CAST(trunc(p_retailprice) AS BIGINT) END AS counter FROM part
""",
    "fixed_point": """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(format('{:.2f}', CAST(round(l_extendedprice * 100) AS BIGINT) / (l_quantity * 100)) AS DOUBLE) AS unit
FROM lineitem
""",
}
