"""Sources: tables, collections, data files and message topics, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.expressions import free
from weirflow.session import shared_path
from weirflow.sources.schemas import RECORD


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, ts: str | None = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream of files; ``ts`` without zone becomes UTC, as watermarks need."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(f"{folder}/{name}*.parquet")
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def collection(spark: SparkSession, rows: list, schema: str | T.StructType, ts: str | None = None) -> DataFrame:
    """Rows in memory, with their position in ``seq``; without a time column the current time is taken."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    numbered = T.StructType([T.StructField("seq", T.LongType()), *kind.fields])
    rows = [(n, *(r if isinstance(r, (tuple, list)) else (r,))) for n, r in enumerate(rows)]
    df = spark.createDataFrame(rows, numbered)
    return df if ts or "ts" in df.columns else df.withColumn("ts", F.current_timestamp())


def collection_stream(spark: SparkSession, rows: list, schema: str | T.StructType, per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream, in order of files of ``per_trigger`` rows in the shared folder."""
    df = collection(spark, rows, schema)
    path = shared_path(spark, "collection")
    step = per_trigger or max(1, len(rows))
    for k in range(0, max(1, len(rows)), step):
        df.where((F.col("seq") >= k) & (F.col("seq") < k + step)).coalesce(1).write.parquet(f"{path}/batch={k:012d}")
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{path}/batch=*")


def replay(df: DataFrame, batch: Column, end: DataFrame | None = None, rows_per_file: int = 5_000_000) -> DataFrame:
    """A table as a stream of micro-batches: rows of equal ``batch`` (a small number) come together, in its order, ``end`` after all.

    Each batch is written to the shared folder as equally many files, as many as the
    largest asks for, and so many are read at a time.
    """
    spark = df.sparkSession
    path, number = shared_path(spark, "replay"), free("_batch", *df.columns)
    dealt = df.withColumn(number, batch.cast("int"))
    counts = {r[number]: r["count"] for r in dealt.groupBy(number).count().collect()}
    files = max([1, *(-(-n // rows_per_file) for n in counts.values())])
    for k in sorted(counts):
        rows = dealt.where(F.col(number) == k).drop(number)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.parquet(f"{path}/batch={k:012d}")
    if end is not None:
        end.select(*df.columns).repartition(files).write.parquet(f"{path}/batch={999_999_999_999}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/batch=*")


def csv_file(spark: SparkSession, path: str, limit: int | None = None, multiline: bool = False) -> DataFrame:
    """A CSV file with a header, all columns as text; quotes within quotes are doubled. ``limit`` takes the first rows only (a preview).

    ``multiline`` allows line breaks within quotes; a file is then one task's.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("escape", '"').option("multiLine", multiline)
    return _first(reader.csv(path), limit)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in order of the file; all without a limit."""
    if not limit:
        return df
    at = free("_at", *df.columns)
    return df.withColumn(at, F.monotonically_increasing_id()).orderBy(at).limit(limit).drop(at)


def json_file(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON file: a list, one object, or an object whose ``data`` is a list. ``limit`` takes the first rows only."""
    df = spark.read.option("multiLine", True).json(path)
    kind = df.schema["data"].dataType if "data" in df.columns else None
    if isinstance(kind, T.ArrayType):
        df = df.select(F.explode("data").alias("record"))
        df = df.select("record.*") if isinstance(kind.elementType, T.StructType) else df
    return _first(df, limit)


def json_lines_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def kafka(spark: SparkSession, topic: str, servers: str = "localhost:9092", group_prefix: str | None = None, max_per_trigger: int | None = None, stream: bool = True, provider: str = "kafka") -> DataFrame:
    """A topic from its beginning: key, value, ts, headers. Needs Spark's Kafka package; ``provider`` names another of the same shape
    (``topics.register`` gives one that keeps topics in a folder, named by ``servers``).

    Offsets are kept in the query's checkpoint, and committed with each batch.
    """
    reader = (spark.readStream if stream else spark.read).format(provider)
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("includeHeaders", True)
    if group_prefix:
        reader = reader.option("groupIdPrefix", group_prefix)
    if max_per_trigger and stream:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return from_messages(reader.load())


def from_messages(df: DataFrame) -> DataFrame:
    """Messages as records; a missing time becomes the current one, headers become a map (the last of a name counts)."""
    headers = F.create_map().cast("map<string,string>")
    if "headers" in df.columns:
        pairs = F.transform(F.coalesce("headers", F.array().cast(df.schema["headers"].dataType)), lambda h: F.struct(h["key"].alias("k"), F.decode(h["value"], "UTF-8").alias("v")))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        headers = F.map_from_entries(last)
    time = F.coalesce(F.col("timestamp"), F.current_timestamp())
    return df.select("key", "value", time.alias("ts"), headers.alias("headers")).to(RECORD)
