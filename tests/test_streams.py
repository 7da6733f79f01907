import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.operators import windows
from weirflow.operators.times import WatermarkStrategy
from weirflow.plans import graph
from weirflow.plans.environment import Environment
from weirflow.sources import readers, sinks
from weirflow.streaming import processors
from weirflow.streaming.jobs import Jobs, drain, progress_metrics

START = datetime(2024, 1, 1)


def write(spark, path, number, rows):
    values = [(k, START + timedelta(seconds=s), v) for k, s, v in rows]
    spark.createDataFrame(values, "k string, ts timestamp, v int").coalesce(1).write.mode("append").parquet(f"{path}/batch={number}")


def stream(spark, path):
    return spark.readStream.schema("k string, ts timestamp, v int").option("maxFilesPerTrigger", 1).parquet(f"{path}/batch=*")


def test_late_rows_are_dropped_and_the_last_window_stays_open(spark, folder):
    path = f"{folder}/in"
    for n, rows in enumerate([[("a", 1, 1), ("a", 9, 1)], [("a", 30, 1)], [("a", 31, 1)], [("a", 2, 1)], [("a", 60, 1)], [("a", 61, 1)]]):
        write(spark, path, n, rows)
    df = WatermarkStrategy.bounded_out_of_orderness(5000).apply(stream(spark, path))
    out = drain(windows.aggregate(df, ["k"], windows.Tumbling(10_000), F.count("*").alias("n")), "late")
    found = sorted((int((r.window_start - START).total_seconds()), r.n) for r in out.collect())
    assert found == [(0, 2), (30, 2)]


def test_stream_state_survives_a_restart(spark, folder):
    path = f"{folder}/in"
    jobs = Jobs(spark, f"{folder}/jobs")

    def counts():
        return stream(spark, path).groupBy("k").agg(F.sum("v").alias("total"))

    write(spark, path, 0, [("a", 1, 1), ("b", 1, 2)])
    seen = []
    collect = lambda rows, n: seen.append({r.k: r.total for r in rows.collect()})
    for n in (1, 2):
        query = counts().writeStream.foreachBatch(collect).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        write(spark, path, n, [("a", 5, 10)])
    assert seen[-1] == {"a": 11, "b": 2}
    assert jobs.list() == []


def test_job_control(spark, folder):
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 1)])
    jobs = Jobs(spark, f"{folder}/jobs")
    job = jobs.submit("copy", stream(spark, path), "memory")
    job.query.awaitTermination()
    assert job.status == "FINISHED" and jobs.checkpoints_of("copy") == [0]
    assert jobs.metrics("copy")["records"] == 1 and progress_metrics(None)["records"] == 0
    live = jobs.submit("live", stream(spark, path), "parquet", interval_ms=100, path=f"{folder}/out")
    assert live.status == "RUNNING" and jobs.histogram()["RUNNING"] == 1
    with pytest.raises(ValueError):
        jobs.submit("live", stream(spark, path), "memory")
    live.query.processAllAvailable()
    assert jobs.cancel("live", f"{folder}/saved")["status"] == "CANCELED"
    write(spark, path, 1, [("b", 1, 1)])
    again = jobs.submit("from_savepoint", stream(spark, path), "parquet", checkpoint=f"{folder}/saved", path=f"{folder}/out")
    again.query.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b"]  # each once
    assert len(jobs.list()) == 3


def test_dedup_with_expiry(spark, folder):
    path = f"{folder}/in"
    for n, rows in enumerate([[("a", 1, 1), ("a", 2, 1)], [("a", 3, 1), ("b", 60, 1)], [("c", 61, 1)], [("a", 120, 1)]]):
        write(spark, path, n, rows)
    out = drain(processors.deduplicate(stream(spark, path), ["k"], 5000), "dedup")
    assert sorted(r.k for r in out.collect()) == ["a", "a", "b", "c"]


def test_running_and_process_over_batches_of_a_stream(spark, folder):
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 5), ("b", 2, 1)])
    write(spark, path, 1, [("a", 3, 7)])
    out = drain(processors.running(stream(spark, path), "k", ["ts"], "v", "avg", "k string, ts timestamp, v int, result double"), "running", "update")
    assert sorted((r.k, r.v, r.result) for r in out.collect()) == [("a", 5, 5.0), ("a", 7, 6.0), ("b", 1, 1.0)]
    with pytest.raises(ValueError):
        processors.running(stream(spark, path), "k", ["ts"], "v", "median", "k string")


def test_late_rows_can_fire_again(spark, folder):
    path = f"{folder}/in"
    for n, rows in enumerate([[("a", 1, 1), ("a", 9, 2)], [("a", 30, 4)], [("a", 2, 8)], [("a", 60, 16)]]):
        write(spark, path, n, rows)
    out = drain(processors.refiring_windows(stream(spark, path), "k", 10_000, 5000, int.__add__, "v", "key string, start_ms bigint, end_ms bigint, value bigint"), "refire", "update")
    start = int(START.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1000)
    assert sorted(((r.start_ms - start) // 1000, r.value) for r in out.collect()) == [(0, 3), (0, 8), (30, 4)]


def test_collection_stream(spark):
    df = readers.collection_stream(spark, ["x", "y", "z"], "value string", per_trigger=2)
    assert [r.value for r in drain(df.select("seq", "value"), "collected").orderBy("seq").collect()] == ["x", "y", "z"]


def test_state_kinds():
    with pytest.raises(ValueError):
        processors.Descriptor("x", "set")


def test_states_of_several_kinds_in_a_real_store(spark, folder):
    """Values, lists, maps, reducing and aggregating state over two micro-batches, with a row that fails."""
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 3), ("b", 2, 9), ("a", 3, 4)])
    write(spark, path, 1, [("a", 4, 2), ("a", 5, -1), ("b", 6, 1)])
    d = processors.Descriptor
    kinds = (
        d("n", schema="n bigint"), d("all", "list", schema="v int"), d("seen", "map", schema="n int", key_schema="v int"),
        d("top", "reducing").with_reduce_function(max), d("mean", "aggregating").with_aggregator(lambda s, v: (s[0] + v, s[1] + 1), lambda s: s[0] / max(s[1], 1), (0, 0)),
    )

    def step(key, row, states):
        if row["v"] < 0:
            raise ValueError
        n = (states["n"].get()[0] if states["n"].exists() else 0) + 1
        states["n"].update((n,))
        states["all"].appendValue((row["v"],))
        states["seen"].updateValue((row["v"],), (1,))
        empty = states["top"].get() is None
        states["top"].add(row["v"])
        states["mean"].add(row["v"])
        if n == 3:
            states["top"].clear()
        return [(key, n, len(list(states["all"].get())), len(list(states["seen"].keys())), empty, states["top"].get(), states["mean"].get())], None

    failed = spark.sparkContext.accumulator(0)
    schema = "k string, n bigint, held bigint, seen bigint, empty boolean, top bigint, mean double"
    out = drain(processors.keyed_process(stream(spark, path), ["k"], ["ts"], step, schema, descriptors=kinds, failed=failed), "kinds", "update")
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == [
        ("a", 1, 1, 1, True, 3, 3.0), ("a", 2, 2, 2, False, 4, 3.5), ("a", 3, 3, 3, False, None, 3.0), ("b", 1, 1, 1, True, 9, 9.0), ("b", 2, 2, 2, False, 9, 5.0)
    ]
    assert failed.value == 1


def _kinds_of_state():
    d = processors.Descriptor
    kinds = (
        d("n", schema="n bigint"), d("last", "list", schema="v bigint"), d("seen", "map", schema="n bigint", key_schema="v bigint"),
        d("top", "reducing").with_reduce_function(max), d("sum", "aggregating").with_aggregator(lambda s, v: s + v, lambda s: s, 0),
    )

    def step(key, row, states):
        if row["v"] < 0:
            raise ValueError
        n = (states["n"].get()[0] if states["n"].exists() else 0) + 1
        states["n"].update((n,))
        states["last"].put([*states["last"].get(), (row["v"],)][-2:])
        states["seen"].updateValue((row["v"] % 3,), (n,))
        if n % 4 == 0 and states["seen"].containsKey((0,)):
            states["seen"].removeKey((0,))
        states["top"].add(row["v"])
        states["sum"].add(row["v"])
        return [(key, n, str([v for (v,) in states["last"].get()]), str(sorted(states["seen"].iterator())), states["top"].get(), states["sum"].get())], None

    return kinds, step, "k string, n bigint, last string, seen string, top bigint, total bigint"


def test_a_row_costs_no_call_of_the_store(spark):
    """All of a key's rows of a micro-batch read each state once and write it once; packed states are one."""
    import pandas as pd

    calls = []

    class Cell:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(*values):
                calls.append(name)
                if name in ("updateValue", "update", "put"):
                    self.held[values[0] if len(values) == 2 else None] = values[-1]
                elif name == "removeKey":
                    self.held.pop(values[0], None)
                return {"getValue": lambda: self.held.get(values[0]), "get": lambda: self.held.get(None, [] if self.list else None), "iterator": lambda: iter(list(self.held.items()))}.get(name, lambda: None)()
            return call

    class Handle:
        def _make(self, *_, many=False):
            cell = Cell()
            cell.list = many
            return cell

        getValueState = getMapState = _make

        def getListState(self, *_):
            return self._make(many=True)

    kinds, step, schema = _kinds_of_state()
    kinds, names, told = [d.parse() for d in kinds], [c.split(" ")[0] for c in schema.split(", ")], []
    frame = pd.DataFrame({"k": "a", "v": range(200), "ownbucket": 0, "ownkey0": "a", "ownnull0": False})
    for processor, most in ((processors.KeyedProcess(step, ["v"], names, descriptors=kinds), 30), (processors.PackedProcess(step, "ownbucket", ["ownkey0", "ownnull0"], ["v"], names, kinds), 4)):
        processor.init(Handle())
        calls.clear()
        told.append([row for _ in range(2) for out in processor.handleInputRows(("a",), iter([frame]), None) for row in out.itertuples(index=False, name=None)])
        assert len(calls) <= most
    assert told[0] == told[1] and told[0][-1][1] == 400


@pytest.mark.parametrize("packed", [True, False])
def test_packed_states_are_those_of_spark(spark, folder, packed):
    """Null and other keys, rows that fail and several micro-batches, against a fold in Python."""
    path, batches = f"{folder}/in", [[("a", 1, 3), (None, 2, 9), ("a", 3, 4), ("", 4, 1)], [("a", 5, 6), (None, 6, -1), ("b", 7, 1), (None, 8, 5)], [("a", 9, 7), ("a", 10, 2)]]
    for n, rows in enumerate(batches):
        write(spark, path, n, rows)
    kinds, step, schema = _kinds_of_state()
    out = drain(processors.keyed_process(stream(spark, path), ["k"], ["ts"], step, schema, descriptors=kinds, packed=packed), "packed", "update")
    want, held = [], {}
    for k, _, v in (r for rows in batches for r in rows if r[2] >= 0):
        n, values, seen = held.get(k, (0, [], {}))
        n, values, seen = n + 1, [*values, v], {**seen, v % 3: n + 1}
        if n % 4 == 0:
            seen.pop(0, None)
        held[k] = n, values, seen
        want.append((k, n, str(values[-2:]), str(sorted(((a,), (b,)) for a, b in seen.items())), max(values), sum(values)))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_whole_number_keys_stay_whole_beside_null_ones(spark, folder):
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 1), ("b", 2, None), ("c", 3, 0)])
    count = processors.Descriptor("n", schema="n bigint")
    df = stream(spark, path).withColumn("v", F.col("v") + F.lit(2**60))
    out = drain(processors.keyed_process(df, ["v"], ["ts"], lambda key, row, states: ([(repr(key), row["k"])], None), "key string, k string", descriptors=(count,)), "whole", "update")
    assert sorted(map(tuple, out.collect())) == [(str(2**60), "c"), (str(2**60 + 1), "a"), ("None", "b")]


@pytest.mark.parametrize("packed", [True, False])
def test_a_row_that_raises_fails_a_strict_query(spark, folder, packed):
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 1), ("b", 2, -1), ("c", 3, 2)])
    kinds, step, schema = _kinds_of_state()
    with pytest.raises(Exception, match="ValueError"):
        drain(processors.keyed_process(stream(spark, path), ["k"], ["ts"], step, schema, descriptors=kinds, packed=packed, strict=True), "strict", "update")


@pytest.mark.parametrize("packed", [True, False])
def test_rows_that_are_left_out_leave_states_alone(spark, folder, packed):
    """The function fails after it has changed every state, on the first rows of a key and later, and while it makes its rows."""
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, -1), ("a", 2, 3), ("a", 3, -3), ("a", 4, 5), ("b", 1, -4)])
    write(spark, path, 1, [("a", 5, -6), ("b", 6, 2), ("a", 7, -9), ("a", 8, 1), ("b", 9, -2)])
    kinds, inner, schema = _kinds_of_state()

    def step(key, row, states):
        made, after = inner(key, {**row, "v": abs(row["v"])}, states)
        if row["v"] < 0 and row["v"] % 3 == 0:
            states["seen"].clear()
            states["last"].append_value((7,))
        return (made[0] if i == 0 else 1 // 0 for i in range(2 if row["v"] < 0 else 1)), after

    failed = spark.sparkContext.accumulator(0)
    out = drain(processors.keyed_process(stream(spark, path), ["k"], ["ts"], step, schema, descriptors=kinds, failed=failed, packed=packed), "undone", "update")
    assert sorted(map(tuple, out.collect())) == [
        ("a", 1, "[3]", "[((0,), (1,))]", 3, 3), ("a", 2, "[3, 5]", "[((0,), (1,)), ((2,), (2,))]", 5, 8), ("a", 3, "[5, 1]", "[((0,), (1,)), ((1,), (3,)), ((2,), (2,))]", 5, 9), ("b", 1, "[2]", "[((2,), (1,))]", 2, 2)
    ]
    assert failed.value == 6


def test_rows_can_be_taken_as_they_come(spark, folder):
    """Without an order no key's micro-batch is held; what does not depend on order is the same."""
    path = f"{folder}/in"
    write(spark, path, 0, [("a", s, 1) for s in range(500)])
    count = lambda key, row, n: ([(key, (n or 0) + 1)] if ((n or 0) + 1) % 100 == 0 else [], (n or 0) + 1)
    out = drain(processors.keyed_process(stream(spark, path), ["k"], None, count, "k string, n bigint"), "unordered", "update")
    assert sorted(r.n for r in out.collect()) == [100, 200, 300, 400, 500]
    total = drain(processors.running(stream(spark, path), "k", None, "v", "sum", "k string, ts timestamp, v int, result double"), "unordered_sum", "update")
    assert sorted(r.result for r in total.collect()) == [float(n) for n in range(1, 501)]


def test_topics_restart_and_repeat(spark, folder):
    """Offsets are kept in the checkpoint; a batch that is written again counts once."""
    from weirflow.sources import topics

    provider, servers = topics.register(spark), f"{folder}/bus"
    send = lambda *v: sinks.to_kafka(spark.createDataFrame([("k", x) for x in v], "key string, value int"), "in", servers, provider=provider)

    def copy():
        df = readers.kafka(spark, "in", servers, provider=provider, group_prefix="g")
        body = df.select(F.col("key").cast("string").alias("key"), F.get_json_object(F.col("value").cast("string"), "$.value").cast("int").alias("value"), "headers")
        query = sinks.to_kafka(body, "out", servers, f"{folder}/state", provider, availableNow=True)
        query.awaitTermination()
        assert query.exception() is None

    def there():
        df = readers.kafka(spark, "out", servers, stream=False, provider=provider)
        return sorted(int(bytes(r.value).split(b":")[1].rstrip(b"}")) for r in df.collect())

    assert readers.kafka(spark, "none", servers, stream=False, provider=provider).count() == 0
    send(1, 2)
    send(3)
    copy()
    assert there() == [1, 2, 3]
    send(4)
    copy()
    copy()
    assert there() == [1, 2, 3, 4]
    topic = topics.Topic({"topic": "out", "kafka.bootstrap.servers": servers})
    first = topic.entries()[0].rsplit("/", 1)[1][13:-5]
    topic.commit(["/nowhere"], first)
    assert there() == [1, 2, 3, 4]


def test_recovery_of_a_failed_job(spark, folder):
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 1)])
    write(spark, path, 1, [("b", 2, 0)])
    jobs = Jobs(spark, f"{folder}/jobs")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    job = jobs.submit("divide", stream(spark, path).selectExpr("k", "4 div v as q"), "parquet", path=f"{folder}/out")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|terminated"):
        job.query.awaitTermination()
    assert job.status == "FAILED" and jobs.histogram()["FAILED"] == 1 and jobs.checkpoints_of("divide") == [0]
    again = jobs.recover("divide", stream(spark, path).selectExpr("k", "try_divide(4, v) as q").selectExpr("k", "cast(q as bigint) as q"), sink="parquet", path=f"{folder}/out")
    again.query.awaitTermination()
    assert again.status == "FINISHED" and jobs.checkpoints_of("divide")[0] >= 1
    assert sorted((r.k, r.q) for r in spark.read.parquet(f"{folder}/out").collect()) == [("a", 4), ("b", None)]


def test_meter():
    from weirflow.streaming.jobs import CHECKPOINT_BOUNDS, LATENCY_BOUNDS, Meter

    meter = Meter()
    spent = [(3, 200), (700, 50), (9000, 70_000)]
    for n, (batch, commit) in enumerate(spent):
        meter.tell({
            "name": "q", "numInputRows": 10, "durationMs": {"triggerExecution": batch, "walCommit": commit}, "stateOperators": [{"numRowsTotal": 1, "memoryUsedBytes": 100 * n, "numRowsDroppedByWatermark": 2}],
            "eventTime": {"max": "2024-01-01T00:00:09.500Z", "watermark": "2024-01-01T00:00:04.000Z"} if n == 1 else {},
        })
    assert (meter.records, meter.batches) == (30, 3) and meter.smoothed_ms == pytest.approx(0.1 * 9000 + 0.9 * (0.1 * 700 + 0.9 * 0.1 * 3))
    assert sum(meter.latencies) == sum(meter.checkpoints) == 3 and meter.latencies[1] == meter.latencies[8] == meter.latencies[len(LATENCY_BOUNDS)] == 1
    assert meter.checkpoints[1] == meter.checkpoints[0] == meter.checkpoints[len(CHECKPOINT_BOUNDS)] == 1
    assert meter.watermark_lag_ms == {"q": 5500} and meter.state_bytes == {"q": 200} and meter.late_rows == {"q": 6}


def test_expired_keys_leave_the_store(spark, folder):
    path = f"{folder}/in"
    for n in range(5):
        write(spark, path, n, [(f"k{n}{i}", 100 * n, 1) for i in range(20)])
    query = processors.deduplicate(stream(spark, path), ["k"], 5000).writeStream.format("memory").queryName("expiry").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [progress_metrics(p)["state_rows"] for p in query.recentProgress]
    assert spark.table("expiry").count() == 100 and max(held) <= 40


def test_fluent_job(spark):
    env = Environment(spark, "words").set_parallelism(4)
    lines = spark.createDataFrame([("b a b", START), ("b c", START + timedelta(seconds=3)), ("a", START + timedelta(seconds=70))], "value string, ts timestamp_ntz")
    seen = []
    counted = (
        env.add_source(lines)
        .flat_map("split(value, ' ')")
        .map("1", "n")
        .key_by("value")
        .window(windows.Tumbling(60_000))
        .reduce("sum", value="n")
        .filter("value > 1")
    )
    counted.add_sink(lambda df: seen.extend((r.key, r.value) for r in df.collect()))
    env.execute()
    assert seen == [("b", 3)]
    stats = env.graph.statistics()
    assert stats["vertices"] == 7 and stats["sources"] == 1 and stats["sinks"] == 1 and stats["chains"] == 3
    assert env.graph.order()[0] == 0


def test_fluent_keyed_operators(spark):
    env = Environment(spark)
    df = spark.createDataFrame([("a", START + timedelta(seconds=s), v) for s, v in ((0, 1.0), (0.4, 3.0), (5, 9.0))], "key string, ts timestamp_ntz, value double")
    keyed = env.add_source(df).key_by("key")
    assert sorted(r.value for r in keyed.reduce(lambda a, b: a + b).df.collect()) == [4.0, 9.0]
    assert [list(r.value) for r in keyed.window(windows.Tumbling(60_000)).reduce().df.collect()] == [[1.0, 3.0, 9.0]]
    assert sorted(r.result for r in keyed.running("sum", "value").df.collect()) == [1.0, 4.0, 13.0]
    assert keyed.join(keyed, 1000).df.count() == 5
    assert keyed.distinct([]).df.count() == 1
    assert keyed.union(env.add_source(df)).df.count() == 6
    assert keyed.rebalance().transform(lambda d: d.limit(1)).df.count() == 1
    assert sorted(r.value for r in keyed.reduce(lambda a, b: a + b, returns="double").df.collect()) == [4.0, 9.0]
    assert keyed.fold(1.0, lambda a, v: a * v, lambda a: -a, "double").df.first().value == -27.0
    joined = keyed.join(keyed, 1000, lambda a, b: a["value"] - b["value"] if a["value"] < 9 else 1 / 0, "double").df
    assert sorted(r.value for r in joined.collect()) == [-2.0, 0.0, 0.0, 2.0]
    assert sum(env.failures().values()) == 1
    made = keyed.process(lambda k, row, s: ([(k, (s or 0) + 1)], (s or 0) + 1), "key string, n bigint").df
    assert sorted(r.n for r in made.collect()) == [1, 2, 3]


def test_graph_rules():
    g = graph.Graph()
    a, b = g.add_vertex("a"), g.add_vertex("b")
    g.add_edge(a, b)
    with pytest.raises(ValueError):
        g.add_edge(a, 9)
    with pytest.raises(ValueError):
        g.add_edge(a, b, "SIDEWAYS")
    g.add_edge(b, a)
    with pytest.raises(ValueError):
        g.order()


def test_one_read_feeds_several_sinks(spark, folder):
    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 1), ("b", 2, 2)])
    seen = []

    def both(rows, _):
        seen.append(rows.count())
        seen.append(rows.where("v > 1").count())

    query = sinks.each_batch(stream(spark, path), both)
    query.processAllAvailable()
    query.stop()
    assert seen == [2, 1]


def test_settings_reach_the_job(spark, folder):
    from weirflow.session import Settings
    from weirflow.sources import topics

    settings = Settings(job_name="told", kafka_servers=f"{folder}/bus", kafka_group_prefix="p", watermark_delay_ms=7000, watermark_interval_ms=150, max_records_per_trigger=1, checkpoint_interval_ms=400)
    env = Environment.of(settings)
    assert env.checkpoint_interval_ms == env.interval_ms == 400 and env.watermarks() == WatermarkStrategy(7000, 150)
    provider = topics.register(spark)
    for k in range(2):
        sinks.to_kafka(spark.createDataFrame([("a", k)], "key string, value int"), "t", settings.kafka_servers, provider=provider)
    source = env.from_topic("t", provider=provider)
    assert "7 seconds" in source.df._jdf.queryExecution().analyzed().toString() or "7000" in source.df._jdf.queryExecution().analyzed().toString()
    assert env.watermark_interval_ms == 150
    source.map("cast(value as string)").transform(lambda d: d.select("value")).add_sink("memory", name="told_rows")
    (job,) = env.execute()
    try:
        job.query.processAllAvailable()
        assert job.status == "RUNNING" and spark.table("told_rows").count() == 2
        assert [p.numInputRows for p in job.query.recentProgress if p.numInputRows][:2] == [1, 1]
    finally:
        env.jobs.cancel("told_rows")
    plain = Environment(spark)
    plain.add_source(readers.collection_stream(spark, ["x"], "value string"), WatermarkStrategy(1000, 300))
    assert plain.interval_ms is None and plain.run_forever().interval_ms == 300


def test_watermarks_on_a_clock_of_ones_own(spark, folder):
    """The clock runs an hour ahead of the rows' times, so all but the newest are late at once."""
    path = f"{folder}/in"
    for n, rows in enumerate([[("a", 1, 1)], [("a", 9, 1)], [("a", 4000, 1)]]):
        write(spark, path, n, rows)
    ahead = WatermarkStrategy.custom(F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    df = ahead.apply(stream(spark, path))
    out = drain(windows.aggregate(df, ["k"], windows.Tumbling(10_000), F.count("*").alias("n"), ts="clock"), "ahead")
    found = sorted((int((r.window_start - START).total_seconds()), r.n) for r in out.collect())
    assert found == [(3600, 2)]


def test_replay_keeps_batches_apart(spark):
    seen = []
    df = readers.replay(spark.range(10).withColumnRenamed("id", "n"), F.expr("n div 4"), spark.range(99, 100).withColumnRenamed("id", "n"), rows_per_file=2)
    query = sinks.each_batch(df, lambda rows, _: seen.append(sorted(r.n for r in rows.collect())))
    query.processAllAvailable()
    query.stop()
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, *([99] if seen[2][-1] == 99 else [])], *([[99]] if len(seen) == 4 else [])]


@pytest.mark.parametrize("keys", [["k"], []])
def test_native_running_over_batches(spark, folder, keys):
    from weirflow.streaming import native

    path = f"{folder}/in"
    batches = [[("a", 3, 5), ("b", 2, 1), ("a", 1, None)], [("a", 4, 7), (None, 5, 2)], [("b", 6, 3), (None, 7, None), ("a", 8, 1)]]
    for n, rows in enumerate(batches):
        write(spark, path, n, rows)
    functions = {"total": ("sum", F.col("v")), "mean": ("avg", F.col("v")), "n": ("count", F.lit(1)), "low": ("min", F.col("v")), "top": ("max", F.col("v"))}
    for block in (None, F.expr("second(ts) div 2")):
        out = native.running(stream(spark, path), keys, ["ts"], functions, block=block)
        got = {int((r.ts - START).total_seconds()): (r.total, r.mean, r.n, r.low, r.top) for r in out.collect()}
        state = {}
        for rows in batches:
            for k, s, v in sorted(rows, key=lambda r: r[1]):
                held = state.setdefault(k if keys else 0, [])
                held.append(v)
                known = [x for x in held if x is not None]
                want = (sum(known), sum(known) / len(held), len(held), min(known), max(known)) if known else (None, None, len(held), None, None)
                assert got[s] == want
        assert len(got) == 8


class Opened:
    """A process function that only works once opened."""

    def __init__(self):
        self.base = None

    def open(self):
        self.base = 100

    def close(self):
        self.base = None

    def __call__(self, key, row, n):
        n = (n or 0) + 1
        return [(key, self.base + n)], n


def test_functions_are_opened_and_state_expires(spark, folder):
    from weirflow.operators import state

    path = f"{folder}/in"
    write(spark, path, 0, [("a", 1, 1), ("a", 2, 1), ("b", 3, 1)])
    out = drain(processors.keyed_process(stream(spark, path), ["k"], ["ts"], Opened(), "k string, n bigint"), "opened", "update")
    assert sorted(map(tuple, out.collect())) == [("a", 101), ("a", 102), ("b", 101)]
    assert sorted(map(tuple, state.keyed_process(stream_table(spark, path), ["k"], ["ts"], Opened(), "k string, n bigint").collect())) == [("a", 101), ("a", 102), ("b", 101)]
    made = []
    df = processors.keyed_process(stream(spark, path), ["k"], ["ts"], Opened(), "k string, n bigint", ttl_ms=6000)
    query = sinks.each_batch(df, lambda rows, _: made.extend(r.n for r in rows.where("k = 'a'").collect()), mode="update")
    try:
        for number, wait in ((1, 0), (2, 10)):
            until(lambda: len(made) > number)
            time.sleep(wait)
            write(spark, path, number, [("a", 9, 1)])
        until(lambda: len(made) > 3)
    finally:
        query.stop()
    assert made == [101, 102, 103, 101]  # forgotten while nothing came


def until(done, seconds=40):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.1)


def stream_table(spark, path):
    return spark.read.schema("k string, ts timestamp, v int").parquet(f"{path}/batch=*")


def test_windows_keep_their_state_in_either_store(spark, folder):
    from weirflow.session import ROCKSDB

    path = f"{folder}/in"
    for n, rows in enumerate([[("a", 1, 1)], [("a", 2, 1)], [("a", 60, 1)], [("a", 61, 1)]]):
        write(spark, path, n, rows)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        for store in (ROCKSDB, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
            spark.conf.set(name, store)
            df = WatermarkStrategy.bounded_out_of_orderness(5000).apply(stream(spark, path))
            out = drain(windows.aggregate(df, ["k"], windows.Tumbling(10_000), F.count("*").alias("n")), "store")
            assert [r.n for r in out.collect()] == [2]
    finally:
        spark.conf.set(name, before)


def test_a_join_goes_on_after_a_restart(spark, folder):
    """Both sides' rows are kept in the checkpoint; the join's clock is the slower side's."""
    from weirflow.operators import joins

    left, right = f"{folder}/left", f"{folder}/right"
    write(spark, left, 0, [("a", 10, 1), ("b", 10, 2)])
    write(spark, right, 0, [("c", 1, 3)])

    def run():
        side = lambda p: WatermarkStrategy.bounded_out_of_orderness(5000).apply(stream(spark, p))
        pairs = joins.interval_join(side(left), side(right), "k", 20_000).select("l_k", "l_v", "r_v")
        query = pairs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    write(spark, right, 1, [("a", 15, 4), ("b", 50, 5)])
    write(spark, left, 1, [("c", 2000, 6)])
    run()
    write(spark, right, 2, [("b", 12, 7)])  # the left side is far ahead, the right is not: not late
    run()
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    assert got[0] == ("a", 1, 4) and len(got) <= 2


def test_a_trigger_reads_no_more_than_it_may(spark, folder):
    df = spark.range(4).withColumn("ts", F.current_timestamp())
    for n in range(4):
        df.where(F.col("id") == n).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    seen = []
    query = sinks.each_batch(readers.table_stream(spark, folder, "t", files_per_trigger=1), lambda rows, _: seen.append(rows.count()))
    query.processAllAvailable()
    query.stop()
    assert seen == [1, 1, 1, 1]
