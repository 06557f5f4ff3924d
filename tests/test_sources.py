"""Golden payloads per shape, including malformed ones."""

from pyspark.sql import functions as F

from tidemark.operators.aggregates import count_by, histogram_quantile
from tidemark.operators.joins import label_counts
from tidemark.sources import base, beans, documents, exposition, scrapes, status, text


def payloads(spark, *texts):
    return spark.createDataFrame([("h", t) for t in texts], "host STRING, payload STRING")


def pairs(df):
    return sorted((r["name"], r["value_raw"]) for r in df.collect())


def test_exposition(spark):
    got = exposition.extract_exposition(payloads(
        spark, '# TYPE x counter\nx_total{method="GET"} 5\nup 1\n', 'a{l="x,y=z}{",l="last"} +Inf 1700\n{no} 1\nopen{a="1" 2\nalone\n',
        'esc{p="c:\\\\new\\"q\\"\\nend"}\t7', "", None,
    )).collect()
    by = {r["name"]: r for r in got}
    assert set(by) == {"x_total", "up", "a", "esc"}
    assert by["x_total"]["tags"] == {"method": "GET"} and by["x_total"]["value"] == 5.0
    assert by["up"]["tags"] == {} and by["up"]["value_kind"] == "int"
    assert by["a"]["tags"] == {"l": "last"} and by["a"]["value"] == float("inf")
    assert by["esc"]["tags"] == {"p": 'c:\\new"q"\nend'} and by["esc"]["value"] == 7.0


def test_long_label_block(spark):
    many = ",".join(f'l{i}="{"v" * 50}"' for i in range(400))
    got = exposition.extract_exposition(payloads(spark, f"m{{{many}}} 1", f'm{{{many},q="a,b"}} 1')).collect()
    assert sorted(len(r["tags"]) for r in got) == [400, 401]


def test_histogram_quantiles(spark):
    rows = [("a", le, c) for le, c in (("1.0", 40.0), ("0.1", 10.0), ("+Inf", 40.0), ("0.5", 30.0))]
    rows += [("zero", "0.1", 0.0), ("zero", "+Inf", 0.0), ("inf", "1", 1.0), ("inf", "+Inf", 10.0)]
    df = spark.createDataFrame(rows, "k STRING, le STRING, cumulative DOUBLE")
    got = {(r["k"], r["q"]): r["value"] for r in histogram_quantile(df, ["k"]).collect()}
    assert [round(got["a", q], 9) for q in (0.5, 0.75, 0.9)] == [0.3, 0.5, 0.8]
    assert got["zero", 0.5] is None and got["inf", 0.5] == float("inf")
    clamped = {(r["k"], r["q"]): r["value"] for r in histogram_quantile(df, ["k"], clamp=True).collect()}
    assert clamped["inf", 0.5] == 1.0


def test_bean_array_nested_and_bad(spark):
    doc = '{"beans":[{"name":"m","HeapMemoryUsage":{"used":1,"max":2},"none":null},{"name":"n","State":"Active"}]}'
    df = payloads(spark, doc, '{"beans":5}', "{bad", '{"a":1,"a":2}')
    assert pairs(beans.extract_bean_array(df)) == [
        ("HeapMemoryUsage.max", "2"), ("HeapMemoryUsage.used", "1"), ("State", "Active"), ("name", "m"), ("name", "n"),
    ]
    assert pairs(beans.extract_bean_array(df, ["State"])) == [("State", "Active")]
    wanted = spark.createDataFrame([("State",)], "key STRING")
    assert pairs(beans.extract_bean_array(df, wanted)) == [("State", "Active")]
    assert base.bad_json(df).count() == 2


def test_json_paths_and_kinds(spark):
    spec = [documents.Path("$.a.b", "b"), documents.Path("$.f", "f"), documents.Path("$.t", "t"), documents.Path("$.n", "n")]
    got = documents.extract_paths(payloads(spark, '{"a":{"b":7},"f":1.5,"t":"12","n":null}', "[]"), spec).collect()
    assert {r["name"]: (r["value_raw"], r["value_kind"]) for r in got} == {"b": ("7", "int"), "f": ("1.5", "float"), "t": ("12", "str")}


def test_named_arrays_count_or_rate(spark):
    doc = '{"Gauges":[{"Name":"a.b-c","Value":1}],"Counters":[],"Samples":[{"Name":"s","Rate":0.5,"Count":9}]}'
    for how, value in (("Rate", 0.5), ("Count", 9.0)):
        got = documents.extract_named_arrays(payloads(spark, doc, "{}", "no"), how).collect()
        assert {r["name"]: r["value"] for r in got} == {"a.b-c": 1.0, "s": value}


def test_key_value_last_wins_without_a_shuffle(spark):
    df = payloads(spark, "a:1\nb:2:3\r\na:4\nnone\n:x\n")
    out = text.extract_kv_lines(df, ":", last_wins=True)
    assert pairs(out) == [("a", "4"), ("b", "2:3")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert pairs(text.extract_kv_lines(df, ":")) == [("a", "1"), ("a", "4"), ("b", "2:3")]


def test_socket_table_counts_all_labels(spark):
    head = "  sl  local_address rem_address   st tx_queue"
    four = f"{head}\n 0: A:1 B:2 0A x\n 1: A:1 B:2 01 x\n 2: A:1 B:2 04 x\n"
    six = f"{head}\n 0: A:1 B:2 03 x\n"
    rows = text.extract_columns(payloads(spark, four, six), {"code": 3}, skip=1)
    labels = [("01", "established"), ("03", "syn_recv"), ("04", "syn_recv"), ("0A", "listen"), ("0C", "closing")]
    dim = spark.createDataFrame(labels, "code STRING, label STRING")
    got = {r["label"]: r["n"] for r in label_counts(rows, dim, keys=["host"]).collect()}
    assert got == {"established": 1, "syn_recv": 2, "listen": 1, "closing": 0}
    assert count_by(rows, ["host"]).first()["n"] == 4


def test_csv_cells(spark):
    doc = '# pxname,svname,rate,note,\nweb,BACKEND,4,,\nweb,FRONTEND,9,"a, ""b""",extra,more\nshort\n'
    got = text.extract_csv(payloads(spark, doc), ids=("pxname",)).collect()
    assert sorted((r["pxname"], r["name"], r["value_raw"]) for r in got) == [
        ("web", "note", 'a, "b"'), ("web", "rate", "4"), ("web", "rate", "9"), ("web", "svname", "BACKEND"), ("web", "svname", "FRONTEND"),
    ]


def test_status_and_named_queries(spark):
    df = spark.createDataFrame([("h", "Queries", "10"), ("h", "Open_files", "3")], "host STRING, variable STRING, value STRING")
    got = {r["name"]: (r["style"], r["value"]) for r in status.extract_status_rows(df).collect()}
    assert got == {"mysql_queries": ("rate", 10.0), "mysql_open_files": ("gauge", 3.0)}
    spark.range(5).createOrReplaceTempView("t_numbers")
    out = status.run_named_queries(spark, {"n": "SELECT count(*) FROM t_numbers", "top": "SELECT id FROM t_numbers ORDER BY id DESC LIMIT 2"})
    assert sorted((r["tags"]["prettyname"], r["value"]) for r in out.collect()) == [("n", 5.0), ("top", 3.0), ("top", 4.0)]


def test_landed_scrapes_are_pruned(spark, scratch):
    df = spark.range(200).select(
        F.lit("h").alias("host"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.col("id").cast("string").alias("scrape_id"), (F.col("id") * 3600).alias("ts_s"), F.lit("text").alias("format"),
        F.lit("x 1").alias("payload"),
    )
    scrapes.write_scrapes(df, scratch + "/t")
    got = scrapes.read_scrapes(spark, scratch + "/t", ["a"], since=86_400 * 2, until=86_400 * 3)
    assert got.count() == 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "source" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_named_queries_keep_text_and_long_integers(spark):
    found = status.run_named_queries(spark, {"text": "SELECT 'on' AS v", "long": "SELECT 9007199254740993L AS v", "real": "SELECT 12345678.5D AS v", "none": "SELECT CAST(NULL AS INT) AS v"})
    got = {r["tags"]["prettyname"]: (r["value_raw"], r["value_kind"], r["value"]) for r in found.collect()}
    assert got["text"] == ("on", "str", None)
    assert got["long"] == ("9007199254740993", "int", 9007199254740992.0)
    assert got["real"][1:] == ("float", 12345678.5)
    assert got["none"] == (None, None, None)
