from pyspark.sql import functions as F

from weirflow.session import Settings
from weirflow.sources import generators, readers, sinks


def test_csv_is_all_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,fips,name\n2020-01-01,06,"a, b"\n2020-01-02,10,c\n')
    df = readers.csv_file(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("date", "string"), ("fips", "string"), ("name", "string")]
    assert sorted(r.fips for r in df.collect()) == ["06", "10"] and df.where("name = 'a, b'").count() == 1
    assert readers.csv_file(spark, str(tmp_path / "a.csv"), limit=1).count() == 1
    (tmp_path / "q.csv").write_text('a,b\n"say ""x""",1\n"two\nlines",2\n')
    assert [r.a for r in readers.csv_file(spark, str(tmp_path / "q.csv"), multiline=True).collect()] == ['say "x"', "two\nlines"]


def test_json_shapes(spark, tmp_path):
    for name, text in {"list": '[{"a": 1}, {"a": 2}]', "data": '{"data": [{"a": 1}, {"a": 2}], "x": 1}', "one": '{"a": 1}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    count = lambda n: [r.a for r in readers.json_file(spark, str(tmp_path / f"{n}.json")).collect()]
    assert count("list") == [1, 2] and count("data") == [1, 2] and count("one") == [1]


def test_collection_keeps_order_and_time(spark):
    df = readers.collection(spark, ["x", "y"], "value string")
    assert [r.value for r in df.orderBy("seq").collect()] == ["x", "y"] and "ts" in df.columns
    assert sinks.collect_values(df.orderBy("seq")) == ["x", "y"]


def test_messages_in_and_out(spark):
    from datetime import datetime

    rows = [(b"k", b"v", datetime(2024, 1, 1), [("h", b"1"), ("h", b"2")]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "key binary, value binary, timestamp timestamp, headers array<struct<key:string,value:binary>>")
    first, second = readers.from_messages(df).collect()
    assert bytes(first.key) == b"k" and first.headers == {"h": "2"} and second.ts is not None and second.headers == {}
    out = sinks.messages(spark.createDataFrame([("", 1), ("a", 2)], "key string, n int")).collect()
    assert [(r.key, r.value) for r in out] == [(None, '{"n":1}'), ("a", '{"n":2}')]


def test_print_lines(spark):
    df = spark.createDataFrame([("k", "v"), ("", "w"), (None, None)], "key string, value string")
    assert [r.line for r in sinks.print_lines(df, "> ").collect()] == ["> [k] v", "> w", "> None"]
    shown = []
    sinks.to_console(df, out=shown.append)
    assert shown == ["[k] v", "w", "None"]


def test_console_shows_every_row(spark, folder):
    df = spark.range(2500).select(F.col("id").cast("string").alias("value")).repartition(3)
    shown, some = [], []
    sinks.to_console(df, out=shown.append)
    sinks.to_console(df, out=some.append, rows=10)
    assert sorted(shown, key=int) == [str(i) for i in range(2500)] and len(some) == 10
    df.coalesce(1).write.parquet(f"{folder}/in")
    batches = []
    query = sinks.to_console(spark.readStream.schema("value string").parquet(f"{folder}/in"), out=batches.append)
    query.processAllAvailable()
    query.stop()
    assert sorted(batches) == sorted(shown)


def test_generators_hold_their_promises(spark):
    s = generators.sensors(spark, 2000, anomaly_rate=0.1)
    assert s.groupBy("sensor_id").agg(F.countDistinct("device_type").alias("kinds"), F.countDistinct("location").alias("places")).where("kinds = 1 and places = 1").count() == 20
    assert 100 < s.where("is_anomaly").count() < 300
    assert s.where("not is_anomaly and (temperature < 15 or temperature > 30)").count() == 0
    assert s.where("is_anomaly and not (temperature between 40 and 60 and humidity between 10 and 30 or temperature between -10 and 5 and humidity between 80 and 95 or temperature = -999.9 and humidity = -999.9)").count() == 0
    assert s.exceptAll(generators.sensors(spark, 2000, anomaly_rate=0.1).repartition(3)).count() == 0
    low = generators.market(spark, 8000, symbols=["TSLA"], seed=1)
    assert low.where("price < 1").count() == 0
    ticks = generators.market(spark, 8000)
    assert ticks.where("daily_low > price or daily_high < price or bid > ask").count() == 0
    assert ticks.groupBy("symbol").agg(F.max("daily_volume") == F.sum("volume")).count() == 8
    assert ticks.where("volume > 1000").count() > 500 and ticks.where("volume > 10000 or volume < 100").count() == 0


def test_a_walk_with_a_floor_equals_one_step_at_a_time(spark, monkeypatch):
    monkeypatch.setitem(generators.SYMBOLS, "LOW", (1.5, 0.05, -0.02))
    rows = generators.market(spark, 600, symbols=["LOW"], seed=9).orderBy("timestamp").collect()
    steps = spark.range(600).select("id", generators.gauss("step", F.col("id"), 9).alias("z")).orderBy("id").collect()
    price, high, low, at_floor = 1.5, 1.5, 1.5, 0
    for row, step in zip(rows, steps):
        price = max(1.0, price - 0.02 * price + 0.05 * price * step.z)
        high, low, at_floor = max(high, price), min(low, price), at_floor + (price == 1.0)
        assert abs(row.price - price) <= 0.0051 and abs(row.daily_high - high) <= 0.0051 and abs(row.daily_low - low) <= 0.0051
    assert at_floor > 20


def test_shoppers_equal_a_simulation(spark):
    rows = generators.shop(spark, 3000, users=7).orderBy("timestamp", "event_id").collect()
    carts = {}
    kinds = set()
    price = {f"prod_{k}": p for k, (_, p, _) in enumerate(generators.PRODUCTS, 1)}
    for r in rows:
        cart = carts.setdefault(r.user_id, set())
        if r.event_type == "add_to_cart":
            cart.add(r.product_id)
        elif r.event_type == "remove_from_cart":
            cart.remove(r.product_id)
        elif r.event_type == "purchase":
            assert cart and r.total_value == round(sum(price[p] for p in cart), 2) and r.quantity == len(cart)
            cart.clear()
        assert r.cart_size == len(cart) and (r.total_value is None) == (r.event_type != "purchase") and price[r.product_id] == r.price
        kinds.add(r.event_type)
    assert kinds == set(generators.SHOP_EVENTS) and len(rows) == 3000


def test_upsert_keeps_the_newest_row(spark, folder):
    path = f"{folder}/table"
    frame = lambda rows: spark.createDataFrame(rows, "id int, at int, status string")
    sinks.upsert(frame([(1, 1, "a"), (2, 1, "b")]), path, ["id"], ["at"])
    out = sinks.upsert(frame([(1, 2, "c"), (2, 0, "old"), (3, 1, "d")]), path, ["id"], ["at"])
    assert sorted(map(tuple, out.collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")] and sinks.current_version(spark, path) == 1


def test_first_rows_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "\n".join(str(k) for k in range(500)) + "\n")
    assert [r.n for r in readers.csv_file(spark, str(tmp_path / "a.csv"), limit=3).collect()] == ["0", "1", "2"]
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"n": {k}}}' for k in range(50)) + "]")
    assert [r.n for r in readers.json_file(spark, str(tmp_path / "a.json"), limit=2).collect()] == [0, 1]


def test_a_shared_folder_is_asked_for_on_clusters(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from weirflow import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    unset = SimpleNamespace(sparkContext=Context(), conf={})
    with pytest.raises(RuntimeError):
        session.shared_dir(unset)


def test_settings():
    conf = Settings(parallelism=3).update({"state_backend": "memory"}).conf()
    assert conf["spark.sql.shuffle.partitions"] == "3" and "spark.sql.streaming.stateStore.providerClass" not in conf
    for bad in ({"nope": 1}, {"state_backend": "disk"}):
        try:
            Settings().update(bad).conf()
        except ValueError:
            continue
        raise AssertionError(bad)


def test_batteries_are_rounded_as_in_the_sql(spark):
    """Differences that lie on or next to a half, and below zero, where nothing rounds to -0.0."""
    import duckdb

    steps = 30_000
    made = generators.sensors(spark, steps, count=1).select("timestamp", "battery_level").orderBy("timestamp").collect()
    want = duckdb.sql(f"SELECT round(100 - step / 10000::double * 100, 1) FROM range(1, {steps + 1}) t(step) ORDER BY step").fetchall()
    assert [repr(r.battery_level) for r in made] == [repr(w) for (w,) in want]
