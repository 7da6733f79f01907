"""Sinks: message topics, console lines, collections and files, batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.session import shared_path


def messages(df: DataFrame, key: str | None = "key", value: Column | None = None) -> DataFrame:
    """Rows as messages: an empty or null key becomes null; the value is JSON of all columns but key, time and headers unless given."""
    body = [c for c in df.columns if c not in (key, "ts", "headers")]
    out = [F.nullif(F.col(key).cast("string"), F.lit("")).alias("key")] if key and key in df.columns else []
    out.append((value if value is not None else F.to_json(F.struct(*body))).cast("string").alias("value"))
    if "headers" in df.columns:
        entries = F.map_entries("headers")
        out.append(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value"))).alias("headers"))
    return df.select(*out)


def to_kafka(df: DataFrame, topic: str, servers: str = "localhost:9092", checkpoint: str | None = None, provider: str = "kafka", **trigger):
    """Write messages at least once: on a stream a repeated batch may send again. Needs Spark's Kafka package, or another ``provider`` of the same shape.

    ``trigger`` goes to the stream's trigger.
    """
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3", "kafka.max.in.flight.requests.per.connection": "1"}
    if not df.isStreaming:
        return messages(df).write.format(provider).options(**options).mode("append").save()
    writer = messages(df).writeStream.format(provider).options(**options).option("checkpointLocation", checkpoint or shared_path(df.sparkSession, "kafka"))
    return (writer.trigger(**trigger) if trigger else writer).start()


def print_lines(df: DataFrame, prefix: str = "", key: str = "key", value: str = "value") -> DataFrame:
    """The lines that a print sink shows: prefix, the key in brackets where there is one, the value."""
    text = F.coalesce(F.col(value).cast("string"), F.lit("None"))
    if key not in df.columns:
        return df.select(F.concat(F.lit(prefix), text).alias("line"))
    name = F.nullif(F.col(key).cast("string"), F.lit(""))
    return df.select(F.concat(F.lit(prefix), F.coalesce(F.concat(F.lit("["), name, F.lit("] ")), F.lit("")), text).alias("line"))


def to_console(df: DataFrame, prefix: str = "", out: Callable[[str], None] = print, rows: int | None = None, **names):
    """Print every line, partition by partition; ``rows`` limits it to a preview (of each batch, on a stream)."""

    def show(lines: DataFrame, *_):
        for row in (lines if rows is None else lines.limit(rows)).toLocalIterator():
            out(row["line"])

    lines = print_lines(df, prefix, **names)
    return each_batch(lines, show) if df.isStreaming else show(lines)


def collect_values(df: DataFrame, value: str = "value") -> list:
    """Values only, as a list; for small results."""
    return [r[0] for r in df.select(value).collect()]


def each_batch(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Call ``function(rows, batch id)``; several outputs share one read of the source there."""
    writer = df.writeStream.foreachBatch(function).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint or shared_path(df.sparkSession, "each")).start()


def to_files(df: DataFrame, path: str, checkpoint: str | None = None, kind: str = "parquet"):
    """Files in a folder; a stream writes each row once."""
    if not df.isStreaming:
        return df.write.format(kind).mode("append").save(path)
    return df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint or shared_path(df.sparkSession, "files")).start()


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Keep a table of the latest row of each key: rows already there are replaced by newer ones. Returns the table.

    Every call writes a new version beside the last one and names it current only
    once it is whole. One writer at a time.
    """
    spark = df.sparkSession
    current = current_version(spark, path)
    rows = df if current < 0 else spark.read.parquet(f"{path}/version={current}").unionByName(df, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last")).select(*keys, "last.*")
    last.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/version={current + 1}")
    return spark.read.parquet(f"{path}/version={current + 1}")


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the last version of an ``upsert`` table that was written whole; -1 if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return -1
    names = [s.getPath() for s in fs.listStatus(base)]
    whole = [int(n.getName()[8:]) for n in names if n.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return max(whole, default=-1)
