"""What outlives a run: bucket tables, saved series, backlogs, checks on streams."""

import os

import pytest
from pyspark.sql import functions as F

from test_windows import found, frame, series_rows
from tidemark import checks
from tidemark.bucketed import BucketTable
from tidemark.operators import windows as w
from tidemark.operators.resume import SeriesState
from tidemark.streaming import cycle
from tidemark.streaming.checks import checks_sink
from tidemark.streaming.derive import saved_state, stateful, stream_state
from tidemark.streaming.forward import forward_sink, read_backlog
from tidemark.streaming.silence import silence_events


def union(known, batch):
    return batch if known is None else known.unionByName(batch)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_touched_buckets_are_rewritten(spark, scratch):
    table = BucketTable(spark, scratch, ["k"], buckets=8)
    assert table.read() is None and table.versions() == []
    table.fold(0, spark.createDataFrame([(i, 0) for i in range(100)], "k int, v int"), union)
    before = files(scratch)
    table.fold(1, spark.createDataFrame([(3, 1)], "k int, v int"), union)
    after = files(scratch)
    assert before <= after and len(after) == len(before) + 1
    assert pairs(table.read()) == sorted([(i, 0) for i in range(100)] + [(3, 1)])
    assert pairs(table.read(before=1)) == [(i, 0) for i in range(100)]
    # The bucket of 3 was written twice; the first of these files goes once no kept version names it.
    table.fold(2, spark.createDataFrame([], "k int, v int"), union)
    assert len(files(scratch)) == len(before)
    assert pairs(table.read()) == sorted([(i, 0) for i in range(100)] + [(3, 1)])


def test_a_version_folded_again_replaces_itself(spark, scratch):
    table = BucketTable(spark, scratch, ["k"], buckets=4)
    table.fold(0, spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), union)
    for rows in ([(1, 1), (9, 1)], [(1, 1)], [(1, 1)]):
        table.fold(1, spark.createDataFrame(rows, "k int, v int"), union)
    assert pairs(table.read()) == [(1, 0), (1, 1), (2, 0)]
    assert table.versions() == [1, 0]


def test_emptied_buckets_and_new_columns(spark, scratch):
    table = BucketTable(spark, scratch, ["k"], buckets=4)
    table.fold(0, spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), union)
    table.fold(1, spark.createDataFrame([(1, 5)], "k int, v int"), lambda known, batch: known.join(batch.select("k"), "k", "left_anti"))
    assert pairs(table.read()) == [(2, 0)]
    more = spark.createDataFrame([(7, 7, "x")], "k int, v int, s string")
    table.fold(2, more, lambda known, batch: known.unionByName(batch, allowMissingColumns=True))
    assert pairs(table.read()) == [(2, 0, None), (7, 7, "x")]


KINDS = {
    "rate": lambda df, s: w.counter_rate(df, {"v": "x"}, ("s",), resume=s),
    "delta": lambda df, s: w.delta(df, "v", ("s",), out="x", resume=s),
    "prev": lambda df, s: w.prev_value(df, "v", ("s",), out="x", resume=s),
    "ratio": lambda df, s: w.delta_ratio(df, "v", "w", ("s",), out="x", resume=s),
    "share": lambda df, s: w.delta_share(df, ["v"], ["v", "w"], ["v"], ("s",), resume=s).withColumn("x", F.col("v_pct")),
    "changed": lambda df, s: w.changed_rate(df, {"v": "x"}, ("s",), resume=s),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_runs_that_resume_equal_one_run(spark, scratch, kind):
    rows = series_rows(31, n=240, nulls=kind in ("rate", "delta"))
    df = frame(spark, rows).withColumn("w", (F.col("seq") * 3 + F.col("v") % 7).cast("double"))
    times = sorted(r[1] for r in rows)
    cuts = [-1, times[60], times[120], 1 << 60]
    parts = []
    for run, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = df.filter((F.col("ts_s") > a) & (F.col("ts_s") <= b))
        # A run that failed before its commit, or after it, is repeated.
        KINDS[kind](part, SeriesState(spark, scratch, run, buckets=4)).count()
        for _ in range(2):
            state = SeriesState(spark, scratch, run, buckets=4)
            out = KINDS[kind](part, state)
            again = found(out, "x")
            state.commit()
        parts.append(again)
    merged = {k: v for p in parts for k, v in p.items()}
    assert merged == found(KINDS[kind](df, None), "x")


def test_a_late_run_leaves_the_state_alone(spark, scratch):
    schema = "s STRING, ts_s BIGINT, seq BIGINT, v BIGINT"
    runs = [[("x", 100, 0, 10), ("x", 200, 1, 20)], [("x", 150, 2, 15), ("y", 150, 3, 1)], [("x", 300, 4, 70), ("y", 250, 5, 11)]]
    rates, deltas = {}, {}
    for i, rows in enumerate(runs):
        a, b = SeriesState(spark, scratch + "/a", i), SeriesState(spark, scratch + "/b", i)
        df = spark.createDataFrame(rows, schema)
        rates |= found(w.counter_rate(df, {"v": "x"}, ("s",), resume=a), "x")
        deltas |= found(w.delta(df, "v", ("s",), out="x", resume=b), "x")
        a.commit()
        b.commit()
    assert rates == {0: 0.0, 1: 0.1, 2: None, 3: 0.0, 4: 0.5, 5: 0.1}
    assert deltas == {0: 0.0, 1: 10.0, 2: None, 3: 0.0, 4: 50.0, 5: 10.0}


def scrapes(spark, rows):
    return spark.createDataFrame(
        [(h, "redis", f"{h}-{ts}", ts, "text", f"keyspace_hits:{v}\nused_memory:{v}\nother:1") for h, ts, v in rows],
        "host string, source string, scrape_id string, ts_s bigint, format string, payload string",
    )


def test_a_failed_and_repeated_micro_batch_gives_the_same_tables(spark, scratch):
    known = checks.registered()
    slices = [[("a", 10, 100), ("b", 10, 7)], [("a", 20, 200), ("c", 20, 1)], [("a", 30, 250), ("b", 30, 47)]]
    seen = []

    def run(path, fail):
        def then(samples, batch_id):
            seen.append((path, batch_id, samples.count()))
            if fail and seen.count((path, batch_id, samples.count())) == 1:
                raise RuntimeError("the sink is down")

        sink = checks_sink([known["redis"]], path, then=then, buckets=4)
        for i, rows in enumerate(slices):
            for _ in range(2 if fail else 1):
                try:
                    sink(scrapes(spark, rows), i)
                except RuntimeError:
                    pass
        out = spark.read.parquet(path + "/rows").select("host", "ts_s", "name", "value")
        state = BucketTable(spark, path + "/state/styles/step-0", ["_hash", "_series"]).read()
        return pairs(out), pairs(state.select("_series.host", "_series.name", "_state.ts", "_state.c"))

    once, repeated = run(scratch + "/once", False), run(scratch + "/twice", True)
    assert once == repeated
    rates = {r[:2]: r[3] for r in once[0] if r[2] == "redis_keyspace_hits"}
    assert rates == {("a", 10): 0.0, ("b", 10): 0.0, ("a", 20): 10.0, ("c", 20): 0.0, ("a", 30): 5.0, ("b", 30): 2.0}
    assert {r[0]: r[2:] for r in once[1]} == {"a": (30, 250), "b": (30, 47), "c": (20, 1)}


def test_store_and_forward_walks_in_order_and_repeats_harmlessly(spark, scratch):
    schema = "host string, batch_id string, seq bigint, body string"
    codes = {}
    sink = forward_sink(lambda b, i: b.select("batch_id").withColumn(
        "code", F.create_map(*[F.lit(x) for x in (("", 0), *codes.items()) for x in x])[F.col("batch_id")]), scratch, max_cache=1, buckets=4)

    def routes(i):
        df = spark.read.parquet(f"{scratch}/routes/batch={i}")
        return {r["batch_id"]: r["route"] for r in df.collect()}

    def waiting():
        return sorted(r["batch_id"] for r in read_backlog(spark, scratch).collect())

    codes |= {"a1": 200, "a2": 503, "a3": 500, "a4": 500, "b1": 402}  # none for b2: a transport error
    first = spark.createDataFrame([("a", f"a{i}", i, "x") for i in (1, 2, 3, 4)] + [("b", "b1", 1, "x"), ("b", "b2", 2, None)], schema)
    for _ in range(2):
        sink(first, 0)
        assert routes(0) == {"a1": "done", "a2": "cached", "a3": "cached", "a4": "overflow", "b1": "refused", "b2": "cached"}
        assert waiting() == ["a2", "a3", "b2"]
    # The walk over a's backlog stops at a2, although a3 would get through.
    codes |= {"a3": 200, "a5": 503, "b2": 204, "b3": 503}
    second = spark.createDataFrame([("a", "a5", 5, "x"), ("b", "b3", 3, "x")], schema)
    for _ in range(2):
        sink(second, 1)
        assert routes(1) == {"a5": "overflow", "b2": "replayed", "b3": "cached"}
        assert waiting() == ["a2", "a3", "b3"]
    codes |= {"a2": 200}
    sink(spark.createDataFrame([], schema), 2)
    assert routes(2) == {"a2": "replayed", "a3": "replayed"}
    assert waiting() == ["b3"]


def test_untouched_hosts_of_the_latest_table_stay(spark, scratch):
    schema = "host STRING, scrape_id STRING, ts_s BIGINT, v INT"
    fold = cycle.latest_sink(scratch, buckets=16)
    fold(spark.createDataFrame([(f"h{i}", "1", 10, i) for i in range(60)], schema), 0)
    before = files(scratch)
    fold(spark.createDataFrame([("h7", "2", 20, 70), ("h8", "0", 5, 80)], schema), 1)
    assert before <= files(scratch)
    got = {r["host"]: (r["ts_s"], r["v"]) for r in cycle.read_latest(spark, scratch).collect()}
    assert got == {f"h{i}": (20, 70) if i == 7 else (10, i) for i in range(60)}


def streamed(spark, parts, schema, path, build):
    """Land the parts one after the other, each as a run of its own of the same stream."""
    import uuid

    name = f"t-{uuid.uuid4().hex}"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path + "/in")
        stream = spark.readStream.schema(schema).parquet(path + "/in")
        query = cycle.start(build(stream), cycle.table_sink(path + "/out"), name, None, path + "/cp")
        assert query.awaitTermination(120) and query.exception() is None
    return spark.read.parquet(path + "/out"), name


@pytest.mark.parametrize("kind", ["rate", "delta", "prev", "ratio"])
def test_a_stream_starts_from_what_a_batch_left(spark, scratch, kind):
    rows = [(s, ts, seq, v, float(seq * 3 + (v or 0) % 7)) for s, ts, seq, v in series_rows(41, n=160, nulls=False)]
    schema = "s STRING, ts_s BIGINT, seq BIGINT, v BIGINT, w DOUBLE"
    cut = sorted(r[1] for r in rows)[80]
    early, late = [r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]
    state = SeriesState(spark, scratch + "/state", 0, buckets=4)
    first = found(KINDS[kind](spark.createDataFrame(early, schema), state), "x")
    state.commit()
    start = saved_state(state.left(), kind)
    values = {"rate": {"v": "x"}, "delta": {"v": "x"}, "prev": {"v": "x"}, "ratio": ["v", "w", "x"]}[kind]
    half = len(late) // 2
    late = sorted(late, key=lambda r: (r[1], r[2]))
    while late[half][1] == late[half - 1][1]:
        half += 1
    out, name = streamed(spark, [late[:half], late[half:]], schema, scratch, lambda s: stateful(s, kind, values, ("s",), start=start))
    assert first | found(out, "x") == found(KINDS[kind](spark.createDataFrame(rows, schema), None), "x")
    # The stream's own state can be read back, and is the last row of every series.
    last = {}
    for s, ts, seq, v, _ in sorted(rows, key=lambda r: (r[1], -r[2] if kind == "rate" else r[2])):
        last[s] = ts
    kept = {r["tm_key"]: r["ts"] for r in stream_state(spark, name, scratch + "/cp").collect()}
    assert sorted(kept.values()) == sorted(last.values())


def test_gates_do_not_start_from_one_state(spark):
    df = spark.createDataFrame([], "s STRING, ts_s BIGINT, seq BIGINT, v BIGINT")
    with pytest.raises(ValueError):
        stateful(df, "changed_rate", {"v": "x"}, ("s",), start=df)


def test_silence_is_told_once_and_cleared(spark, scratch):
    schema = "host string, ts_s bigint"
    parts = [
        [("a", 0), ("a", 40), ("b", 0), ("b", 10), ("c", 0), (None, 5)],  # a's gap of 40 ends in this slice
        [("b", 50), ("b", 55), ("d", 100)],  # b was away between the slices
        [("c", 150), ("b", 120)],  # a and d stay away: only a's time is passed by the newest time before this slice
        [("e", 300)],
    ]
    # Time 0 is late for any stream: its watermark begins there.
    parts = [[(host, 1000 + ts) for host, ts in part] for part in parts]
    out, _ = streamed(spark, parts, schema, scratch, lambda s: silence_events(s, 30))
    got = sorted((r["host"], r["ts_s"] - 1000, r["value"]) for r in out.collect())
    assert got == [
        ("a", 30, 16), ("a", 40, 0), ("a", 70, 16), ("b", 40, 16), ("b", 50, 0), ("b", 85, 16), ("b", 120, 0), ("b", 150, 16), ("c", 30, 16), ("c", 150, 0),
        ("d", 130, 16),
    ]


def test_checks_encode_and_forward_on_a_stream(spark, scratch):
    """Scrapes to delivered lines, with the sink down in the second micro-batch."""
    from tidemark.operators.projections import with_identity
    from tidemark.sinks.encoders import to_graphite

    identity = spark.createDataFrame([("a", "prod", "front", None)], "host string, cluster string, `group` string, location string")

    def deliver(batches, batch_id):
        return batches.select("batch_id", F.lit(503 if batch_id == 1 else 200).alias("code"))

    forward = forward_sink(deliver, scratch + "/delivery", buckets=4)

    def encode(samples, batch_id):
        tagged = with_identity(samples, identity)
        # One batch per host and micro-batch: its lines as one body.
        lines = to_graphite(tagged).withColumn("host", F.split("line", r"\.")[2])
        bodies = lines.groupBy("host").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("body"))
        forward(bodies.select("host", F.concat_ws("-", "host", F.lit(batch_id)).alias("batch_id"), F.lit(batch_id).cast("bigint").alias("seq"), "body"), batch_id)

    sink = checks_sink([checks.registered()["redis"]], scratch, then=encode, buckets=4)
    for i, ts in enumerate((10, 20, 30)):
        sink(scrapes(spark, [("a", ts, ts * 10)]), i)
    got = {(r["batch_id"], r["route"], r["batch"]): r["body"] for r in spark.read.parquet(scratch + "/delivery/routes").collect()}
    assert set(got) == {("a-0", "done", 0), ("a-1", "cached", 1), ("a-1", "replayed", 2), ("a-2", "done", 2)}
    assert got["a-1", "replayed", 2] == "prod.front.a.redis.redis_keyspace_hits 10.0 20\nprod.front.a.redis.redis_used_memory 200 20"


def test_a_stream_goes_on_from_a_batch_run_of_the_checks(spark, scratch):
    from tidemark.streaming.checks import read_samples, run_checks_on

    known = [checks.registered()["redis"], checks.registered()["network_bytes"]]
    checks_sink(known, scratch, buckets=4)(scrapes(spark, [("a", 10, 100), ("b", 10, 5)]), 0)
    later = scrapes(spark, [("a", 20, 200)])
    later.write.parquet(scratch + "/in")
    stream = spark.readStream.schema(later.schema).parquet(scratch + "/in")
    run_checks_on(stream, known, scratch, "goes-on", period=None, checkpoint=scratch + "/cp", first=1).awaitTermination()
    rates = {(r["host"], r["ts_s"]): r["value"] for r in read_samples(spark, scratch).collect() if r["name"] == "redis_keyspace_hits"}
    assert rates == {("a", 10): 0.0, ("b", 10): 0.0, ("a", 20): 10.0}


def test_a_table_function_reads_a_custom_payload(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    from tidemark.checks.custom import register_table_function, table_extract

    def parse(payloads):
        parts = pc.split_pattern(payloads, ";")
        pairs = pc.split_pattern(pc.list_flatten(parts), ":", max_splits=1)
        row, ok = pc.list_parent_indices(parts), pc.equal(pc.list_value_length(pairs), 2)
        pairs, row = pairs.filter(ok), row.filter(ok)
        return pa.table({"row": row, "name": pc.list_element(pairs, 0), "value_raw": pc.list_element(pairs, 1)})

    rows = [("h", "mine", "c1", 0, "t", "a:1;b:2;junk"), ("h", "mine", "c2", 10, "t", "a:21;b:x"), ("h", "mine", "c3", 10, "t", None), ("h", "mine", "c4", 30, "t", "")]
    raw = spark.createDataFrame(rows, "host string, source string, scrape_id string, ts_s bigint, format string, payload string")
    check = checks.Check("mine", table_extract(parse), [checks.Recipe("a", "my_a", "rate"), checks.Recipe("b", "my_b")], "custom")
    got = {(r["name"], r["scrape_id"]): (r["seq"], r["value"]) for r in checks.run_checks(raw, [check]).collect()}
    assert got == {("my_a", "c1"): (0, 0.0), ("my_a", "c2"): (0, 2.0), ("my_b", "c1"): (1, 2.0), ("my_b", "c2"): (1, None)}
    register_table_function(spark, "mine_pairs", parse, raw.drop("payload").schema)
    raw.filter("payload is not null").createOrReplaceTempView("mine_raw")
    assert spark.sql("SELECT count(*) FROM mine_pairs(TABLE(mine_raw)) WHERE name = 'a'").first()[0] == 2


def test_a_stream_of_some_sources_and_a_time_range(spark, scratch):
    from tidemark.sources.scrapes import stream_scrapes

    scrapes(spark, [("a", ts, 1) for ts in (10, 20, 30)]).write.parquet(scratch + "/in")
    stream = stream_scrapes(spark, scratch + "/in", ["redis"], since=20, until=30)
    cycle.start(stream, cycle.table_sink(scratch + "/out"), "ranged", None, scratch + "/cp").awaitTermination()
    assert [r["ts_s"] for r in spark.read.parquet(scratch + "/out").collect()] == [20]
