"""Compare a query's rows with what its SQL gives on the same tables."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame, columns):
    frame = frame[columns].copy()
    for c in columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]")
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def check(spark, folder, function, sql):
    got, want = function(spark, folder).toPandas(), connection(folder).execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
