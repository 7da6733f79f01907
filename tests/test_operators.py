import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.functions import codecs
from weirflow.functions import expressions as x
from weirflow.operators import aggregates, datafiles, joins, rows, state, times, windows

EPOCH = datetime(1970, 1, 1)


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_map_keeps_nulls_and_drops_failures(spark):
    df = frame(spark, [(1, 4), (2, 0), (3, None)], "id int, value int")
    assert got(rows.map_rows(df, "value + 1"), "id", "value") == [(1, 5), (2, 1), (3, None)]
    failed = spark.sparkContext.accumulator(0)
    out = rows.map_rows(df, lambda v: None if v is None else 8 // v, returns="int", failed=failed)
    assert sorted((r.id, r.value) for r in out.collect() if r.value is not None) == [(1, 2)]
    assert out.where("id = 3").count() == 1 and out.where("id = 2").count() == 0
    assert failed.value >= 1


def test_filter_and_flat_map(spark):
    df = frame(spark, [(1, "a b"), (2, ""), (3, None)], "id int, value string")
    assert got(rows.filter_rows(df, "value <> ''"), "id") == [(1,)]
    assert got(rows.filter_rows(df, lambda v: v.strip()), "id") == [(1,)]
    assert got(rows.flat_map(df, x.words("value")), "id", "value") == [(1, "a"), (1, "b")]

    def midway(v):
        yield v.split()[0]
        yield v.split()[1]

    assert got(rows.flat_map(df, midway), "id", "value") == [(1, "a"), (1, "b")]


def test_key_by_merge_and_latest(spark):
    df = frame(spark, [(1, "a"), (2, "b")], "id int, value string")
    assert got(rows.key_by(df, F.upper("value")), "key") == [("A",), ("B",)]
    assert rows.merge(df, df.select("id")).count() == 4
    assert got(rows.latest(df, 1, F.desc("id")), "id") == [(2,)]
    assert tuple(rows.counts_by_state(df, "value", ["a", "c"]).first()) == (2, 1, 0)


@pytest.mark.parametrize("seed", range(3))
def test_windows_against_a_model(spark, seed):
    r = random.Random(seed)
    slide = r.choice([2, 5, 10])
    size = slide * r.randint(1, 4)
    odd = size + r.randint(1, slide - 1)
    moments = [r.randint(-100, 100) for _ in range(40)] + [3, 7, 12, 17, -4]
    df = frame(spark, [(at(s),) for s in moments], "ts timestamp_ntz")

    def counted(assigner):
        out = windows.aggregate(df, [], assigner, F.count("*").alias("n"))
        return {int((row.window_start - EPOCH).total_seconds()): row.n for row in out.collect()}

    def model(starts):
        out = {}
        for s in moments:
            for w in starts(s):
                out[w] = out.get(w, 0) + 1
        return out

    assert counted(windows.Tumbling(size * 1000)) == model(lambda s: [s // size * size])
    aligned = model(lambda s: [w for w in range(s // slide * slide - size + slide, s // slide * slide + 1, slide) if w <= s < w + size])
    assert counted(windows.Sliding(size * 1000, slide * 1000)) == aligned
    legacy = model(lambda s: [w for w in range(s // slide * slide - odd + slide, s // slide * slide + 1, slide) if w <= s < w + odd])
    assert counted(windows.Sliding(odd * 1000, slide * 1000, legacy=True)) == legacy


def test_window_arguments():
    for bad in (lambda: windows.Tumbling(0), lambda: windows.Sliding(5, 6), lambda: windows.Sliding(5, 0), lambda: windows.Session(-1)):
        with pytest.raises(ValueError):
            bad()


def test_session_window(spark):
    df = frame(spark, [("a", at(s)) for s in (0, 5, 14, 24, 35)] + [(None, at(1))], "k string, ts timestamp_ntz")
    out = windows.aggregate(df, ["k"], windows.Session(10_000), F.count("*").alias("n"))
    assert sorted((r.k or "", r.n) for r in out.collect()) == [("", 1), ("a", 1), ("a", 4)]  # exactly a gap apart: together


def test_halving_fold_is_not_a_mean(spark):
    df = frame(spark, [("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 40.0), ("b", 1, 7.0)], "k string, seq int, value double")
    out = df.groupBy("k").agg(aggregates.halving(["seq"], "value").alias("v"), aggregates.smoothed(["seq"], "value").alias("e"))
    assert {r.k: r.v for r in out.collect()} == {"a": 27.5, "b": 7.0}
    ema = 0.0
    for v in (10.0, 20.0, 40.0):
        ema = 0.1 * v + 0.9 * ema
    assert {r.k: r.e for r in out.collect()}["a"] == ema
    linear = aggregates.linear_fold(df, ["k"], ["seq"], "value", 0.9, 0.1, F.expr("seq div 2"))
    assert abs({r.k: r.folded for r in linear.collect()}["a"] - ema) < 1e-12


def test_job_metrics_over_tasks(spark):
    """Mean over tasks of each task's smoothed latency; the largest of the tasks' last back-pressures, not the largest ever."""
    values = [(k, i % 3, i, i % 7, float(i * 37 % 101) / 8, i * 13 % 17 / 16) for k in ("a", "b", None) for i in range(90 if k == "a" else 5)]
    df = frame(spark, values, "k string, task int, seq long, records long, latency_ms double, backpressure double").repartition(5)
    for block in (F.expr("seq div 8"), None):
        out = aggregates.job_metrics(df, ["k"], "task", ["seq"], block)
        rows = {r.k: r for r in out.collect()}
        assert set(rows) == {"a", "b", None}
        for k, r in rows.items():
            emas, last = {}, {}
            for v in values:
                if v[0] == k:
                    emas[v[1]] = 0.3 * v[4] + 0.7 * emas.get(v[1], 0.0)
                    last[v[1]] = v[5]
            assert r.mean_latency_ms == pytest.approx(sum(emas.values()) / len(emas)) and r.max_backpressure == max(last.values())
            assert r.records == sum(v[3] for v in values if v[0] == k) and r.tasks == 3
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert max(v[5] for v in values if v[0] == "b") > rows["b"].max_backpressure


def test_waits_are_not_rounded(spark):
    values = [("a", n, 0.004 if n % 3 else 1.001) for n in range(400)] + [("b", n, 10.0**17 + n) for n in range(3)]
    df = frame(spark, values, "k string, seq int, wait double")
    whole = aggregates.backpressure(df, ["k"], ["seq"], "wait", samples=10, block=None)
    rows = {(r.k, r.seq): r for r in whole.collect()}
    assert rows["a", 1].mean_wait == pytest.approx((1.001 + 0.004) / 2) and rows["a", 1].backpressure_ratio == 0.5 and rows["b", 2].mean_wait == pytest.approx(1e17)
    for slice_rows in (10, 17, 1000):
        sliced = aggregates.backpressure(df, ["k"], ["seq"], "wait", samples=10, block=F.expr("seq div 50"), slice_rows=slice_rows)
        got_rows = {(r.k, r.seq): r for r in sliced.collect()}
        assert len(got_rows) == 403 and all(got_rows[k].mean_wait == pytest.approx(r.mean_wait) and got_rows[k].backpressure_ratio == r.backpressure_ratio for k, r in rows.items())


def test_amounts_are_not_rounded(spark):
    df = frame(spark, [(1, "0.001"), (2, "0.002"), (3, "x"), (4, "123456789012345678")], "id int, v string")
    sums = lambda **how: [r.result for r in aggregates.grouped_running(df, None, "sum", "v", ["id"], **how).orderBy("id").collect()]
    assert sums() == pytest.approx([0.001, 0.003, 0.003, 123456789012345678.0])
    assert sums(scale=3)[:3] == [0.001, 0.003, 0.003] and sums(scale=3)[3] == pytest.approx(123456789012345678.0)
    assert [r.result for r in aggregates.grouped_running(df, "none such", "avg", "v", ["id"]).orderBy("id").limit(2).collect()] == [0.001, 0.0015]


@pytest.mark.parametrize("kind", ["int", "timestamp_ntz", "double", "string"])
def test_blocks_are_chosen(spark, kind, monkeypatch):
    """With one key holding nine tenths of the rows, blocks keep every task's share small."""
    monkeypatch.setattr(aggregates, "BLOCK_ROWS", 100)
    value = {"int": "cast(id as int)", "timestamp_ntz": "cast(timestamp_seconds(id) as timestamp_ntz)", "double": "id / 3", "string": "lpad(id, 9, '0')"}[kind]
    df = spark.range(3000).selectExpr(f"{value} as at", "if(id % 10 > 0, 'hot', 'cold') as k", "cast(id % 5 as int) as v", "1 as _block", "2 as _in_r_sum", "3 as _k_k")
    out = aggregates.running(df, ["k"], ["at"], {"r": ("sum", F.col("v"))})
    whole = aggregates.running(df, ["k"], ["at"], {"r": ("sum", F.col("v"))}, None)
    assert out.columns == whole.columns and out.exceptAll(whole).count() == 0 and out.count() == 3000
    block = aggregates.blocks(df, "at")
    if kind == "string":
        assert block is None
    else:
        largest = df.groupBy("k", block.alias("b")).count().agg(F.max("count")).first()[0]
        assert largest <= 110
    assert aggregates.blocks(df.limit(50), "at") is None and aggregates.blocks(df.limit(0), "at") is None


def test_tables_of_totals(spark):
    df = frame(spark, [(1, at(0), 5.0), (2, at(3), 50.0), (1, at(9), 500.0)], "k int, ts timestamp_ntz, v double")
    assert tuple(aggregates.statistics(df, F.col("v") > 20).first()) == (3, 2, 1, 200 / 3, 9000)
    assert got(aggregates.histogram(df, "v", [10, 50]), "bucket", "n") == [(0, 1), (1, 1), (2, 1)]
    assert got(rows.latest_per_key(df, ["k"], ["ts"], last="v"), "k", "last") == [(1, 500.0), (2, 50.0)]


@pytest.mark.parametrize("function", aggregates.FUNCTIONS)
def test_running_in_blocks_equals_one_frame(spark, function):
    r = random.Random(4)
    values = [(r.choice(["a", "b", None]), n, r.choice([None, *range(-5, 6)])) for n in range(200)]
    df = frame(spark, values, "k string, seq int, v int")
    what = {"result": (function, F.col("v"))}
    whole = aggregates.running(df, ["k"], ["seq"], what)
    blocks = aggregates.running(df, ["k"], ["seq"], what, F.expr("seq div 16"))
    assert whole.exceptAll(blocks).count() == 0 and blocks.count() == 200


def test_unknown_aggregates_fail_early(spark):
    df = frame(spark, [(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        aggregates.running(df, ["k"], ["v"], {"r": ("median", F.col("v"))})
    with pytest.raises(ValueError):
        aggregates.grouped_running(df, "k", "max", "v", ["v"])


@pytest.mark.parametrize("spread", [True, False])
def test_interval_join_bounds_and_null_keys(spark, spread):
    left = frame(spark, [("a", at(10)), ("a", at(400)), (None, at(0))], "key string, ts timestamp_ntz")
    right = frame(spark, [("a", at(5)), ("a", at(310)), ("a", at(310.001)), ("a", at(99.999)), ("a", at(700)), (None, at(300)), ("b", at(10))], "key string, ts timestamp_ntz")
    out = joins.interval_join(left, right, "key", 300_000, spread=spread)
    found = sorted(((r.l_ts - EPOCH).total_seconds(), (r.r_ts - EPOCH).total_seconds()) for r in out.collect())
    assert found == [(0, 300), (10, 5), (10, 99.999), (10, 310), (400, 310), (400, 310.001), (400, 700)]


def test_state_on_batches(spark):
    df = frame(spark, [("a", 1, 5), ("b", 2, 1), ("a", 3, 0), ("a", 4, 7), (None, 5, 2)], "key string, seq int, v int")

    def step(key, row, total):
        total = (total or 0) + 10 // row["v"]
        return [(key, row["seq"], total)], total

    out = state.keyed_process(df, ["key"], ["seq"], step, "key string, seq bigint, total bigint")
    assert sorted((r.seq, r.total) for r in out.collect()) == [(1, 2), (2, 10), (4, 3), (5, 5)]
    failed = rows.counter(spark)
    out = state.keyed_process(df, ["key"], ["seq"], step, "key string, seq bigint, total bigint", lambda key, total: [(key, -1, total)], failed)
    assert sorted((r.key or "", r.total) for r in out.where("seq < 0").collect()) == [("", 5), ("a", 3), ("b", 10)] and failed.value == 1
    first = state.deduplicate(frame(spark, [(1, 2, 7), (1, 1, 8), (2, 3, 9)], "k int, seq int, _n int"), ["k"], ["seq"])
    assert got(first, "k", "seq", "_n") == [(1, 1, 8), (2, 3, 9)]


def test_python_folds(spark):
    df = frame(spark, [("a", 1, 5), ("b", 2, 1), ("a", 3, 2), (None, 5, 2)], "key string, seq int, v int")
    out = state.fold(df, ["key"], ["seq"], "v", lambda a, b: a - b, "bigint")
    assert {r.key: r.value for r in out.collect()} == {"a": 3, "b": 1, None: 2}
    out = state.fold(df, ["key"], ["seq"], "v", lambda a, v: [*a, v], "string", [], lambda a: "-".join(map(str, a)))
    assert {r.key: r.value for r in out.collect()} == {"a": "5-2", "b": "1", None: "2"}
    assert state.fold(df, [], ["seq"], "v", lambda a, b: a * 10 + b, "bigint").first().value == 5122


def test_helper_columns_do_not_clash(spark):
    df = frame(spark, [(1, 4), (2, 0)], "_try int, value int")
    assert got(rows.map_rows(df, lambda v: 8 // v, returns="int"), "_try", "value") == [(1, 2)]
    assert got(rows.filter_rows(df, lambda v: v > 0), "_try") == [(1,)]
    assert got(rows.flat_map(df, lambda v: range(v - 2), returns="int"), "_try", "value") == [(1, 0), (1, 1)]


def test_states_in_blocks_equal_one_group(spark):
    r = random.Random(6)
    df = frame(spark, [(r.choice("ab"), n, r.randint(1, 9)) for n in range(60)], "k string, seq int, v int")
    first = lambda a, b: a
    whole, blocks = (got(state.reducing(df, ["k"], ["seq"], "v", first, b), "k", "state") for b in (None, F.expr("seq div 7")))
    assert whole == blocks
    start = F.lit("").cast("string")
    add = lambda acc, v: F.concat(acc, v.cast("string"))
    for block in (None, F.expr("seq div 7")):
        out = state.aggregating(df, ["k"], ["seq"], "v", start, add, lambda acc: F.upper(acc), lambda a, b: F.concat(a, b), block)
        model = {k: "".join(str(x.v) for x in df.orderBy("seq").collect() if x.k == k) for k in "ab"}
        assert {x.k: x.state for x in out.collect()} == model


def test_lookup_checks_the_size(spark):
    df, small = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, "x")], "k int, name string")
    for most in (5, 0):
        assert sorted(((r.k, r.name) for r in joins.lookup(df, small, ["k"], max_rows=most).collect())) == [(1, "x"), (2, None)]
    hinted = lambda **how: "broadcast" in joins.lookup(df, small, ["k"], **how)._jdf.queryExecution().analyzed().toString()
    assert hinted() and not hinted(max_rows=0) and not hinted(max_bytes=5)


def test_watermarks_as_data(spark):
    df = frame(spark, [(n, at(s)) for n, s in enumerate([10, 3, 20, 14, 16, 15])], "seq int, ts timestamp_ntz")
    for block in (None, F.expr("seq div 2")):
        assert [int((r.monotone_ts - EPOCH).total_seconds()) for r in times.monotone(df, ["seq"], block=block).orderBy("seq").collect()] == [10, 10, 20, 20, 20, 20]
        assert got(times.late(df, ["seq"], 5000, block=block), "seq") == [(1,), (3,)]
    assert times.WatermarkStrategy.no_watermarks().delay_ms is None


def test_generated_watermarks(spark):
    class Even(times.WatermarkGenerator):
        def see(self, ms):
            return ms if ms // 1000 % 2 == 0 else None

    df = frame(spark, [("a", n, at(s)) for n, s in enumerate([3, 10, 7, 4, 12])] + [("b", 9, at(5))], "k string, seq int, ts timestamp_ntz")
    marks = lambda **how: [r.watermark_ms for r in times.generated(df, ["seq"], keys=["k"], **how).orderBy("k", "seq").collect()]
    assert marks(generator=Even) == [None, 10_000, 10_000, 10_000, 12_000, None]
    assert marks(generator=times.BoundedOutOfOrderness, every=2) == [None, 5000, 5000, 5000, 5000, None]


def test_numbers(spark):
    texts = ["1.5", " 12 ", "1_000", "nan", "inf", "abc", "", "1e3", "0x10", "1.5f", "2d", None]
    df = frame(spark, [(t,) for t in texts], "t string").select(x.number("t").alias("n"))
    values = [r.n for r in df.collect()]
    assert values[:3] == [1.5, 12.0, 1000.0] and values[3] != values[3] and values[4] == float("inf")
    assert values[5:7] == [None, None] and values[7] == 1000.0 and values[8:] == [None] * 4


def test_data_files(spark):
    df = frame(spark, [("1", "Ann", "5"), ("2", "ANNA", "x"), ("3", None, "20")], "id string, name string, v string")
    ids = lambda d: got(d.select("record.id"), "id")
    assert ids(datafiles.filtered(df, "name", "equals", "ann")) == [("1",)]
    assert ids(datafiles.filtered(df, "name", "contains", "NN")) == [("1",), ("2",)]
    assert ids(datafiles.filtered(df, "v", "greater_than", "4")) == [("1",), ("3",)]
    assert ids(datafiles.filtered(df, "v", "less_than", "6")) == [("1",)]
    assert ids(datafiles.filtered(df, "missing", "equals", "")) == [("1",), ("2",), ("3",)]
    with pytest.raises(ValueError):
        datafiles.filtered(df, "v", "between", "6")
    assert datafiles.filtered(df, "v", "between", "6", strict=False).count() == 3
    made = datafiles.transformed(df, "F.CSV").select("result.*")
    assert {r.name for r in made.collect()} == {"ANN", "ANNA", None} and {r._source for r in made.collect()} == {"f.csv"}
    odd = {r.record.id: (r.status, r.error is None) for r in datafiles.anomalies(df, "v", "10").collect()}
    assert odd == {"1": ("NORMAL", True), "2": (None, False), "3": ("ANOMALY", True)}
    run = {r.result for r in datafiles.process(df, "aggregate", order=["id"], function="avg", value="v").collect()}
    assert run == {5.0, 2.5, 8.33}
    counted = datafiles.process(df, "aggregate", order=["id"], function="median", value="v", strict=False)
    assert {(r.function, r.result, r.record.id) for r in counted.collect()} == {("median", 1.0, "1"), ("median", 2.0, "2"), ("median", 3.0, "3")}
    clash = frame(spark, [("1", "g", "2.5", "x")], "id string, group string, result string, record string")
    (row,) = datafiles.process(clash, "aggregate", order=["id"], group="group", function="sum", value="result").collect()
    assert (row["group"], row.result, row.record.record, row.record.result) == ("g", 2.5, "x", "2.5")
    assert datafiles.process(df, "unknown").first().operation == "passthrough"


def test_words_between_any_white_space(spark):
    df = frame(spark, [("a\u00a0b\u3000c\x1cd\x85e  f\t\n g",), ("",), ("  ",)], "t string")
    assert [r.w for r in df.select(x.words("t").alias("w")).collect()] == [v.t.split() for v in df.collect()]


def test_codecs(spark):
    df = frame(spark, [("k", "v"), ("", None)], "k string, v string")
    codec = codecs.STRING
    wire = df.select(codec.encode_key(F.col("k")).alias("k"), codec.encode_value(F.col("v")).alias("v"))
    assert [tuple(map(bytes, r)) for r in wire.collect()] == [(b"k", b"v"), (b"", b"")]
    back = wire.select(codec.decode_key(F.col("k")).alias("k"), codec.decode_value(F.col("v")).alias("v"))
    assert [tuple(r) for r in back.collect()] == [("k", "v"), (None, None)]
    broken = frame(spark, [(b"{oops",), (b'{"a": 3}',)], "v binary").select(codecs.bytes_json(F.col("v"), "a int").alias("j"))
    assert [r.j.a if r.j else None for r in broken.collect()] == [None, 3]
