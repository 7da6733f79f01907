"""Message topics in a shared folder: a Spark data source of the shape of Spark's Kafka source and sink.

For tests, replays and places without a message bus. A topic is a folder of Arrow
files; each commit adds one numbered entry that names the files it wrote, and a
reader's offset is a number of entries, kept in the query's checkpoint. A stream
that repeats a batch after a failure finds the batch's entry there, so each batch
counts once. One writer of a topic at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from weirflow.session import ship

NAME = "topics"
SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, headers array<struct<key:string,value:binary>>"
_ARROW = pa.schema(
    [
        ("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()),
        ("timestamp", pa.timestamp("us", tz="UTC")), ("headers", pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))),
    ]
)
ROWS = 10_000


class Topic:
    """The entries and files of one topic."""

    def __init__(self, options: dict):
        names = {k.lower(): v for k, v in options.items()}
        self.name = names.get("subscribe") or names["topic"]
        self.fs, base = pa.fs.FileSystem.from_uri(names["kafka.bootstrap.servers"])
        self.path = f"{base}/{self.name}"
        self.limit = int(names["maxoffsetspertrigger"]) if "maxoffsetspertrigger" in names else None

    def entries(self) -> list[str]:
        found = self.fs.get_file_info(pa.fs.FileSelector(f"{self.path}/log", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def files(self, start: int, end: int | None) -> list[Part]:
        out = []
        for number, entry in enumerate(self.entries()[start:end], start):
            with self.fs.open_input_stream(entry) as f:
                out += [Part(self.fs.normalize_path(p), number, k) for k, p in enumerate(json.loads(f.read()))]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(part.path) as f, pa.ipc.open_stream(f) as reader:
            at = 0
            for batch in reader:
                n = batch.num_rows
                numbers = pa.array(range((part.entry << 40) + at, (part.entry << 40) + at + n), pa.int64())
                columns = {**dict(zip(batch.schema.names, batch.columns)), "topic": pa.array([self.name] * n), "partition": pa.array([part.number] * n, pa.int32()), "offset": numbers}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)
                at += n

    def write(self, rows: Iterator) -> Written:
        """One task's rows as one file, under a name of its own."""
        path, now = f"{self.path}/data/{uuid.uuid4().hex}.arrow", int(time.time() * 1_000_000)
        self.fs.create_dir(f"{self.path}/data", recursive=True)
        schema = pa.schema([_ARROW.field(n) for n in ("key", "value", "timestamp", "headers")])
        raw = lambda v: v.encode() if isinstance(v, str) else None if v is None else bytes(v)
        with self.fs.open_output_stream(path) as f, pa.ipc.new_stream(f, schema) as out:
            held = []

            def flush():
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)] if held else [pa.array([], t.type) for t in schema], schema=schema))
                held.clear()

            for row in rows:
                r = row.asDict(recursive=True)
                held.append((raw(r.get("key")), raw(r.get("value")), now, r.get("headers")))
                if len(held) >= ROWS:
                    flush()
            flush()
        return Written(path)

    def commit(self, files: list[str], name: str) -> None:
        """Add an entry, unless one of that name is there; it is moved into place whole."""
        there = self.entries()
        if any(e.endswith(f"-{name}.json") for e in there):
            return
        self.fs.create_dir(f"{self.path}/log", recursive=True)
        draft = f"{self.path}/log/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(files).encode())
        self.fs.move(draft, f"{self.path}/log/{len(there):012d}-{name}.json")


class Part(InputPartition):
    def __init__(self, path: str, entry: int, number: int):
        self.path, self.entry, self.number = path, entry, number


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return Topic(self.options).files(0, None) or [Part("", 0, 0)]

    def read(self, partition):
        return Topic(self.options).read(partition) if partition.path else iter([])


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of entries. Where a limit is set, a batch takes so many entries at most.

    A stream that takes what is there and ends (``availableNow``) ends after its
    first batch, so leave the limit out there.
    """

    def __init__(self, options):
        self.options, self.seen = dict(options), None

    def initialOffset(self):
        return {"entries": 0}

    def latestOffset(self):
        topic = Topic(self.options)
        there = len(topic.entries())
        if topic.limit is not None and self.seen is not None:
            there = min(there, self.seen + topic.limit)
        elif topic.limit is not None:
            there = min(there, topic.limit)
        self.seen = there
        return {"entries": there}

    def partitions(self, start, end):
        self.seen = max(self.seen or 0, end["entries"])
        return Topic(self.options).files(start["entries"], end["entries"])

    def read(self, partition):
        return Topic(self.options).read(partition)

    def commit(self, end):
        self.seen = max(self.seen or 0, end["entries"])


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.options = dict(options)

    def write(self, iterator):
        return Topic(self.options).write(iterator)

    def commit(self, messages):
        Topic(self.options).commit([m.path for m in messages if m], uuid.uuid4().hex)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.options = dict(options)

    def write(self, iterator):
        return Topic(self.options).write(iterator)

    def commit(self, messages, batchId):
        writer = {k.lower(): v for k, v in self.options.items()}["checkpointlocation"]
        Topic(self.options).commit([m.path for m in messages if m], f"{uuid.uuid5(uuid.NAMESPACE_URL, writer).hex}-{batchId:012d}")

    def abort(self, messages, batchId):
        """Files of a failed batch stay unnamed."""


class Topics(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema: T.StructType):
        return _Reader(self.options)

    def streamReader(self, schema: T.StructType):
        return _StreamReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool):
        return _Writer(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool):
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> str:
    """Make the source known to a session; returns the name to give as ``provider``."""
    ship(spark)
    spark.dataSource.register(Topics)
    return NAME
