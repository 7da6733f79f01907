import pytest
from oracle import SMALL, check

from weirflow.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, SMALL, QUERIES[name], ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_data_files_cover_the_whole_table(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    for name in ("df_transform_upper", "df_aggregate_avg", "df_anomaly", "df_passthrough"):
        assert QUERIES[name](spark, SMALL).count() == events


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["filter_pred"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(value), IsNotNull(event_type), GreaterThan(value,50.0)" in plan
    assert "props" not in plan.split("ReadSchema")[-1]


def test_entry_without_the_training_data_packages(tmp_path):
    """Where a package that those operators need is missing, the other queries are still there."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'map_project' in q and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_misaligned_windows_are_those_of_the_sql_at_bounds_and_before_1970(spark, folder, kind):
    """Times on both sides of the epoch and of windows' bounds, with and without zone."""
    import duckdb
    from oracle import rows

    e = spark.range(4001).selectExpr("id AS event_id", f"timestamp_micros((id - 2000) * 300000000 + (id * 7919 % 7 - 3) * 500)::{kind} AS ts", "if(id % 41 = 3, null, 'k' || id % 2) AS event_type")
    e.write.parquet(f"{folder}/events.parquet")
    got = QUERIES["sliding_misaligned"](spark, folder)
    assert dict(got.dtypes)["window_start"] == dict(got.dtypes)["window_end"] == "timestamp_ntz"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder.removeprefix('file://')}/events.parquet/*.parquet'")
    want, columns = con.execute(ORACLES["sliding_misaligned"]).df(), ["event_type", "window_start", "window_end", "n"]
    assert rows(got.toPandas(), columns) == rows(want, columns)


def _some_events(spark, folder, **columns):
    """Some days of events with large ids; ``columns`` replaces some."""
    plain = {"event_id": "id + 9007199254740993", "ts": "timestamp_micros(1704067200000000 + id * 7200000000)::timestamp_ntz", "user_id": "id * 7 % 5", "event_type": "'k' || id % 3", "value": "id * 37 % 101 / 4d"}
    spark.range(300).selectExpr(*(f"{sql} AS {c}" for c, sql in {**plain, **columns}.items())).write.parquet(f"{folder}/events.parquet")


def test_state_kinds_keep_every_row_beside_nulls(spark, folder):
    import duckdb
    from oracle import rows

    null = lambda n, sql: f"if(id % {n} = 3, null, {sql})"
    _some_events(
        spark, folder, event_id=null(17, "id + 9007199254740993"), ts=null(97, "timestamp_micros(1704067200000000 + id * 7200000000)::timestamp_ntz"), user_id=null(13, "id * 7 % 5"),
        event_type=null(19, "'k' || id % 3"), value="if(id < 40 or id % 5 = 0, null, id * 37 % 101 / 4d)",
    )
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder.removeprefix('file://')}/events.parquet/*.parquet'")
    columns = ["user_id", "event_id", "n", "previous", "kinds", "top", "total"]
    text = [f"cast({c} as string) {c}" for c in columns]
    want = con.execute(f"SELECT {', '.join(text)} FROM ({ORACLES['stream_state_kinds']})").df()
    assert len(want) == 300
    assert rows(QUERIES["stream_state_kinds"](spark, folder).selectExpr(*text).toPandas(), columns) == rows(want, columns)


def test_state_kinds_do_not_pass_a_failure_for_a_result(spark, folder, monkeypatch):
    from weirflow.plans import catalogue

    _some_events(spark, f"{folder}/a")
    inner = catalogue._kinds
    monkeypatch.setattr(catalogue, "_kinds", lambda key, row, states: inner(key, row, states) if row["event_id"] % 100 else 1 // 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        QUERIES["stream_state_kinds"](spark, f"{folder}/a").collect()
    monkeypatch.undo()
    _some_events(spark, f"{folder}/b", value="if(id = 77, double('nan'), 1d)")
    with pytest.raises(Exception, match="no amount"):
        QUERIES["stream_state_kinds"](spark, f"{folder}/b").collect()
