"""Fluent jobs over DataFrames, batch or stream.

Streams carry ``value`` (and whatever columns the source has), ``key`` once keyed,
``ts`` and ``headers``. Operators take Columns, SQL expressions or Python functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.expressions import epoch_ms
from weirflow.operators import aggregates, joins, rows, state, windows
from weirflow.operators.times import WatermarkStrategy
from weirflow.plans import graph as g
from weirflow.session import Settings, session
from weirflow.sources import readers, sinks
from weirflow.streaming import processors
from weirflow.streaming.jobs import Jobs


class Environment:
    """Builds and runs one job. ``settings`` gives intervals, the default watermark and the message bus.

    Every Python function gets a counter of the rows that made it raise; see ``failures``.
    """

    def __init__(self, spark: SparkSession, job_name: str = "job", settings: Settings | None = None):
        self.spark, self.graph, self.settings = spark, g.Graph(job_name), settings or Settings()
        self.parallelism = self.settings.parallelism or 1
        self.checkpoint_interval_ms: int | None = None
        self.watermark_interval_ms: int | None = None
        self.sinks: list[Callable[[], object]] = []
        self.counters: dict[str, object] = {}
        self._jobs: Jobs | None = None

    @classmethod
    def of(cls, settings: Settings) -> Environment:
        """An environment and its session, with all that the settings say: micro-batches take their checkpoint interval."""
        env = cls(session(settings), settings.job_name, settings)
        return env.enable_checkpointing(settings.checkpoint_interval_ms)

    def failures(self) -> dict[str, int]:
        """Rows that each Python function was left out for so far, by vertex (a task that is run again counts again)."""
        return {name: c.value for name, c in self.counters.items()}

    def counter(self, label: str):
        name = f"{len(self.graph.vertices)}:{label}"
        return self.counters.setdefault(name, rows.counter(self.spark))

    def set_parallelism(self, n: int) -> Environment:
        """For vertices added from now on, and for Spark's shuffles."""
        if n < 1:
            raise ValueError("parallelism must be at least 1")
        self.parallelism = n
        self.spark.conf.set("spark.sql.shuffle.partitions", n)
        return self

    def enable_checkpointing(self, interval_ms: int) -> Environment:
        """Micro-batches of this interval; each is committed to the checkpoint folder."""
        self.checkpoint_interval_ms = interval_ms
        return self

    def add_source(self, df: DataFrame, watermarks: WatermarkStrategy | None = None, label: str = "source") -> Stream:
        """``watermarks`` says how late rows of a stream may come, and how often the clock moves on."""
        vertex = self.graph.add_vertex(label, self.parallelism, "source")
        if watermarks and df.isStreaming:
            df = watermarks.apply(df)
            shortest = min(x for x in (self.watermark_interval_ms, watermarks.interval_ms) if x is not None)
            self.watermark_interval_ms = shortest
        return Stream(self, vertex, df)

    def watermarks(self) -> WatermarkStrategy:
        """The strategy of the settings."""
        return WatermarkStrategy(self.settings.watermark_delay_ms, self.settings.watermark_interval_ms)

    def from_topic(self, topic: str, watermarks: WatermarkStrategy | None = None, stream: bool = True, provider: str = "kafka") -> Stream:
        """A topic of the settings' message bus; on streams with the settings' watermark unless another is given."""
        df = readers.kafka(self.spark, topic, stream=stream, provider=provider, **self.settings.kafka())
        return self.add_source(df, watermarks or self.watermarks(), f"topic {topic}")

    @property
    def interval_ms(self) -> int | None:
        """Time between micro-batches: of checkpoints if enabled, else of watermarks. None: one run over what is there."""
        return self.checkpoint_interval_ms if self.checkpoint_interval_ms is not None else self.watermark_interval_ms if self.live else None

    live = False

    def run_forever(self) -> Environment:
        """Streams go on until they are canceled, also where no checkpoint interval is set: then at the watermarks' interval."""
        self.live = True
        return self

    @property
    def jobs(self) -> Jobs:
        if self._jobs is None:
            self._jobs = Jobs(self.spark)
        return self._jobs

    def execute(self) -> list:
        """Run all sinks: batch results are written, streams are started as jobs."""
        self.graph.order()
        return [sink() for sink in self.sinks]


class Stream:
    def __init__(self, env: Environment, vertex: int, df: DataFrame):
        self.env, self.vertex, self.df = env, vertex, df

    def _next(self, label: str, df: DataFrame, edge: str = g.FORWARD, kind: type | None = None, **more) -> Stream:
        vertex = self.env.graph.add_vertex(label, self.env.parallelism)
        self.env.graph.add_edge(self.vertex, vertex, edge)
        return (kind or Stream)(self.env, vertex, df, **more)

    def _counter(self, label: str, f):
        return self.env.counter(label) if callable(f) and not isinstance(f, Column) else None

    def map(self, f, out: str = "value", inputs=None, returns="string") -> Stream:
        return self._next("map", rows.map_rows(self.df, f, out, inputs, returns, self._counter("map", f)))

    def filter(self, f, inputs=None) -> Stream:
        return self._next("filter", rows.filter_rows(self.df, f, inputs, self._counter("filter", f)))

    def flat_map(self, f, out: str = "value", inputs=None, returns="string") -> Stream:
        return self._next("flat_map", rows.flat_map(self.df, f, out, inputs, returns, self._counter("flat_map", f)))

    def key_by(self, f, inputs=None, returns="string") -> KeyedStream:
        return self._next("key_by", rows.key_by(self.df, f, inputs, returns, self._counter("key_by", f)), g.SHUFFLE, KeyedStream)

    def transform(self, f: Callable[[DataFrame], DataFrame], label: str = "transform") -> Stream:
        """Any operator of one's own."""
        return self._next(label, f(self.df))

    def union(self, *others: Stream) -> Stream:
        out = self._next("union", rows.merge(self.df, *(o.df for o in others)))
        for o in others:
            self.env.graph.add_edge(o.vertex, out.vertex)
        return out

    def rebalance(self) -> Stream:
        return self._next("rebalance", rows.rebalance(self.df, self.env.parallelism), g.REBALANCE)

    def add_sink(self, sink: str | Callable[[DataFrame], object], mode: str = "append", name: str | None = None, **options) -> None:
        """End here: a function of the DataFrame, or the name of a Spark sink. May be called again for further sinks."""
        vertex = self.env.graph.add_vertex(name or str(sink), self.env.parallelism, "sink")
        self.env.graph.add_edge(self.vertex, vertex)
        df, env = self.df, self.env
        if callable(sink):
            env.sinks.append(lambda: sink(df))
        elif df.isStreaming:
            env.sinks.append(lambda: env.jobs.submit(name or f"{env.graph.name}_{vertex}", df, sink, mode, env.interval_ms, **options))
        else:
            env.sinks.append(lambda: df.write.format(sink).mode(mode).options(**options).save())


    def to_topic(self, topic: str, provider: str = "kafka", checkpoint: str | None = None) -> None:
        """End here: messages to a topic of the settings' message bus."""
        vertex = self.env.graph.add_vertex(f"topic {topic}", self.env.parallelism, "sink")
        self.env.graph.add_edge(self.vertex, vertex)
        df, env = self.df, self.env
        trigger = {} if not df.isStreaming else {"processingTime": f"{env.interval_ms} milliseconds"} if env.interval_ms else {"availableNow": True}
        env.sinks.append(lambda: sinks.to_kafka(df, topic, env.settings.kafka_servers, checkpoint, provider, **trigger))


class KeyedStream(Stream):
    def window(self, assigner) -> WindowedStream:
        """Adds no vertex of its own."""
        return WindowedStream(self, assigner)

    def reduce(self, f, order: list[str] | None = None, value: str = "value", returns: str | None = None) -> Stream:
        """A fold of one-second windows (not a running one; see ``running``); for ``f`` and ``returns`` see ``WindowedStream.reduce``."""
        return self.window(windows.Tumbling(1000)).reduce(f, order, value, returns)

    def fold(self, start, add: Callable, get: Callable, returns: str, order: list[str] | None = None, value: str = "value") -> Stream:
        """Final state of each key by Python functions: ``get`` of what ``add(state, value)`` made of ``start``, in order (batch)."""
        counted = self.env.counter("fold")
        return self._next("fold", state.fold(self.df, ["key"], order or ["ts"], value, add, returns, start, get, counted), g.SHUFFLE)

    def running(self, function: str, value: Column | str, order: list[str] | None = None, block: Column | str | None = aggregates.AUTO) -> Stream:
        """The aggregate so far at every row, in ``result``. On streams rows of a batch are taken in order."""
        if self.df.isStreaming:
            from pyspark.sql import types as T

            if not isinstance(value, str):
                raise ValueError("on streams the value is named by its column")
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T.StructType([*self.df.schema.fields, T.StructField("result", T.DoubleType())]))
            return self._next(f"running {function}", processors.running(self.df, "key", order or ["ts"], value, function, schema), g.SHUFFLE)
        column = F.col(value) if isinstance(value, str) else value
        return self._next(f"running {function}", aggregates.running(self.df, ["key"], order or ["ts"], {"result": (function, column)}, block), g.SHUFFLE)

    def process(self, f, schema: str, order: list[str] | None = None, ttl_ms: int | None = None, descriptors: tuple = ()) -> Stream:
        """``f(key, row, state) -> (rows, new state)``; on streams ``descriptors`` make the state a dict of states of several kinds."""
        counted = self.env.counter("process")
        if self.df.isStreaming:
            df = processors.keyed_process(self.df, ["key"], order or ["ts"], f, schema, ttl_ms, descriptors, counted)
        elif descriptors:
            raise ValueError("states of several kinds are kept on streams only")
        else:
            df = state.keyed_process(self.df, ["key"], order or ["ts"], f, schema, failed=counted)
        return self._next("process", df, g.SHUFFLE)

    def distinct(self, columns: list[str], order: list[str] | None = None, delay_ms: int | None = None) -> Stream:
        """First row of each key and ``columns``."""
        keys = ["key", *columns]
        df = processors.deduplicate(self.df, keys, delay_ms) if self.df.isStreaming else state.deduplicate(self.df, keys, order or ["ts"])
        return self._next("distinct", df, g.SHUFFLE)

    def join(self, other: KeyedStream, bound_ms: int, function: dict[str, Column] | Callable | None = None, returns: str = "string") -> Stream:
        """Pairs of equal keys at most ``bound_ms`` apart; time and key are the left row's.

        ``function`` names output columns over ``l_...`` and ``r_...``, or is a Python
        function of both rows (dicts) whose result, a ``returns``, becomes ``value``;
        pairs that make it raise are left out and counted.
        """
        pairs = joins.interval_join(self.df, other.df, "key", bound_ms)
        if callable(function):
            sides = [(f"l_{c}", c) for c in self.df.columns], [(f"r_{c}", c) for c in other.df.columns]
            left, right = (F.struct(*(F.col(n).alias(c) for n, c in side)) for side in sides)
            both = pairs.select(F.col("l_key").alias("key"), F.col("l_ts").alias("ts"), left.alias("left"), right.alias("right"))
            plain = lambda a, b: function(a if isinstance(a, dict) else a.asDict(), b if isinstance(b, dict) else b.asDict())
            out = rows.map_rows(both, plain, "value", ["left", "right"], returns, self.env.counter("join")).drop("left", "right")
        else:
            out = pairs.select(F.col("l_key").alias("key"), F.col("l_ts").alias("ts"), *(c.alias(n) for n, c in function.items())) if function else pairs
        joined = self._next("join", out, g.SHUFFLE)
        self.env.graph.add_edge(other.vertex, joined.vertex, g.SHUFFLE)
        return joined


class WindowedStream:
    def __init__(self, keyed: KeyedStream, assigner):
        self.keyed, self.assigner = keyed, assigner

    def aggregate(self, *columns: Column) -> Stream:
        """Native aggregates per key and window; ``ts`` is the window's end."""
        out = windows.aggregate(self.keyed.df, ["key"], self.assigner, *columns).withColumn("ts", F.col("window_end"))
        return self.keyed._next("window", out, g.SHUFFLE)

    def reduce(self, f: Callable | str | None = None, order: list[str] | None = None, value: str = "value", returns: str | None = None) -> Stream:
        """Fold of each key and window in order: ``f(so far, next)`` over Columns, the name of a native aggregate
        (sum, min, max, combined before the shuffle), or none for the list of values.

        With ``returns`` (a type) ``f`` is a Python function of values (batch): each window's
        rows are streamed through it, and values that make it raise are left out and counted.
        """
        if returns is not None:
            assigned = self.assigner.assign(self.keyed.df) if hasattr(self.assigner, "assign") else None
            if assigned is None or self.keyed.df.isStreaming:
                raise ValueError("Python reducers fold tumbling and sliding windows of batches; use process() on streams")
            each = assigned.select("*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))
            out = state.fold(each, ["key", "window_start", "window_end"], order or ["ts"], value, f, returns, failed=self.keyed.env.counter("reduce"))
            return self.keyed._next("window", out.withColumn("ts", F.col("window_end")), g.SHUFFLE)
        if f is None:
            column = aggregates.ordered_list(order or ["ts"], value)
        elif isinstance(f, str):
            column = getattr(F, f)(value)
        else:
            column = aggregates.ordered_reduce(order or ["ts"], value, f)
        return self.aggregate(column.alias("value"))


def event_time(df: DataFrame, ms: str) -> DataFrame:
    """Set ``ts`` from a column of epoch milliseconds."""
    return df.withColumn("ts", F.timestamp_millis(ms))


def to_ms(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, epoch_ms(ts))
