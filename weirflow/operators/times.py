"""Watermarks as data, on batches: what a stream's clock would have been at each row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.expressions import epoch_ms
from weirflow.operators.aggregates import AUTO, running
from weirflow.operators.state import keyed_process


@dataclass(frozen=True)
class WatermarkStrategy:
    """How late rows may come, and how often the clock moves on. ``delay_ms`` None: no watermark at all.

    ``interval_ms`` is the time between micro-batches of streams with this strategy
    (see ``Environment.execute``). ``clock`` is a rule of one's own: the time that a
    row tells, as a column; the watermark then runs on it instead of on the row's time.
    """

    delay_ms: int | None = 5000
    interval_ms: int = 200
    clock: Column | None = None

    @classmethod
    def bounded_out_of_orderness(cls, delay_ms: int) -> WatermarkStrategy:
        return cls(delay_ms)

    @classmethod
    def no_watermarks(cls) -> WatermarkStrategy:
        return cls(None)

    @classmethod
    def monotonous(cls) -> WatermarkStrategy:
        return cls(0)

    @classmethod
    def custom(cls, clock: Column, delay_ms: int = 0, interval_ms: int = 200) -> WatermarkStrategy:
        return cls(delay_ms, interval_ms, clock)

    def apply(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        """Attach the watermark to a stream; times without zone are taken as UTC."""
        if self.delay_ms is None:
            return df
        if self.clock is not None:
            df, ts = df.withColumn("clock", self.clock), "clock"
        if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        return df.withWatermark(ts, f"{self.delay_ms} milliseconds")


def monotone(df: DataFrame, arrival: list[str], ts: str = "ts", keys: list[str] | None = None, block: Column | str | None = AUTO, out: str = "monotone_ts") -> DataFrame:
    """The largest time so far, in order of arrival (per key, if given); in blocks of that order, as ``running``."""
    return running(df, keys or [], arrival, {out: ("max", F.col(ts))}, block)


def trace(df: DataFrame, arrival: list[str], delay_ms: int, ts: str = "ts", keys: list[str] | None = None, block: Column | str | None = AUTO) -> DataFrame:
    """``watermark`` after each row: the largest time so far less the delay."""
    delay = F.expr(f"INTERVAL '{delay_ms / 1000:.3f}' SECOND")
    return monotone(df, arrival, ts, keys, block, "watermark").withColumn("watermark", F.col("watermark") - delay)


def late(df: DataFrame, arrival: list[str], delay_ms: int, ts: str = "ts", keys: list[str] | None = None, block: Column | str | None = AUTO) -> DataFrame:
    """Rows before the watermark that the rows ahead of them had set (a row's own time never makes it late)."""
    return trace(df, arrival, delay_ms, ts, keys, block).where(F.col(ts) < F.col("watermark"))


class WatermarkGenerator:
    """A clock of one's own in Python, for ``generated``: one for each key, told of every row in order."""

    def see(self, ms: int) -> int | None:
        """A row of this time; the new watermark, if there is one."""

    def ask(self) -> int | None:
        """Asked after every so many rows; the new watermark, if there is one."""


class BoundedOutOfOrderness(WatermarkGenerator):
    def __init__(self, delay_ms: int = 5000):
        self.delay_ms, self.top = delay_ms, None

    def see(self, ms: int) -> None:
        self.top = ms if self.top is None else max(self.top, ms)

    def ask(self) -> int | None:
        return None if self.top is None else self.top - self.delay_ms


def generated(df: DataFrame, arrival: list[str], generator: Callable[[], WatermarkGenerator], keys: list[str], every: int = 1, ts: str = "ts") -> DataFrame:
    """(keys, arrival, watermark_ms): the watermark after each row by a Python generator, which sees a key's rows one by one.

    ``every`` is how many rows pass before the generator is asked. A watermark never
    goes back. A key's rows are streamed through one task, as such a clock has to.
    """
    rows = df.select(*keys, *arrival, epoch_ms(ts).alias("_ms"))

    def step(key, row, state):
        clock, n, mark = state or (generator(), 0, None)
        told = [clock.see(row["_ms"])]
        if (n + 1) % every == 0:
            told.append(clock.ask())
        mark = max((m for m in (mark, *told) if m is not None), default=None)
        return [(*(row[c] for c in (*keys, *arrival)), mark)], (clock, n + 1, mark)

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in (*keys, *arrival)) + ", watermark_ms bigint"
    return keyed_process(rows, keys, arrival, step, schema)
