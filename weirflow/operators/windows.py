"""Event-time windows: tumbling, sliding and session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.expressions import bucket_ms, epoch_ms


def _length(ms: int) -> str:
    return f"{ms} milliseconds"


@dataclass(frozen=True)
class Tumbling:
    """[k size, (k + 1) size), aligned with the epoch."""

    size_ms: int

    def __post_init__(self):
        if self.size_ms <= 0:
            raise ValueError("a window's size must be positive")

    def assign(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        return df.withColumn("window", self.column(ts))

    def column(self, ts: str = "ts") -> Column:
        return F.window(F.col(ts), _length(self.size_ms))


@dataclass(frozen=True)
class Sliding:
    """All windows of a size, one each slide, that hold a row.

    Aligned with the epoch. With ``legacy``, windows of a size that is no multiple
    of the slide start at multiples of the slide less the size, as many as fit
    wholly into it; otherwise both are the same. With ``truncated`` as well, a time
    before the epoch is rounded towards it, as SQL's ``%`` does, and windows are
    counted back from there, so that some that hold the row are left out.
    """

    size_ms: int
    slide_ms: int
    legacy: bool = False
    truncated: bool = False

    def __post_init__(self):
        if not 0 < self.slide_ms <= self.size_ms:
            raise ValueError("a slide must be positive and no longer than the window, or rows would be lost")
        if self.truncated and not self.legacy:
            raise ValueError("only legacy windows can be those of truncated times")

    def column(self, ts: str = "ts") -> Column:
        if self.legacy:
            raise ValueError("legacy windows are assigned row by row; use assign()")
        return F.window(F.col(ts), _length(self.size_ms), _length(self.slide_ms))

    def assign(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        if not self.legacy:
            return df.withColumn("window", self.column(ts))
        kind = df.schema[ts].dataType.simpleString()
        at = epoch_ms(ts)
        last = at - at % self.slide_ms if self.truncated else bucket_ms(at, self.slide_ms)
        starts = F.sequence(last - self.size_ms + self.slide_ms, last, F.lit(self.slide_ms).cast("bigint"))
        starts = F.filter(starts, lambda s: (s <= at) & (at < s + self.size_ms))
        moment = lambda ms: F.timestamp_millis(ms).cast(kind)
        rows = df.withColumn("_start", F.explode(starts))
        return rows.withColumn("window", F.struct(moment(F.col("_start")).alias("start"), moment(F.col("_start") + self.size_ms).alias("end"))).drop("_start")


@dataclass(frozen=True)
class Session:
    """Rows of a key no more than a gap apart; ends a gap after the last row."""

    gap_ms: int

    def __post_init__(self):
        if self.gap_ms <= 0:
            raise ValueError("a gap must be positive")

    def column(self, ts: str = "ts") -> Column:
        return F.session_window(F.col(ts), _length(self.gap_ms))


def aggregate(df: DataFrame, keys: list[str], window: Tumbling | Sliding | Session, *aggregates: Column, ts: str = "ts") -> DataFrame:
    """``keys``, ``window_start``, ``window_end`` and the aggregates; sums are combined before the shuffle.

    No key groups all rows of a window; null keys are one group.
    """
    if isinstance(window, Sliding) and window.legacy:
        grouped = window.assign(df, ts).groupBy(*keys, "window")
    else:
        grouped = df.groupBy(*keys, window.column(ts).alias("window"))
    names = [F.col(k) for k in keys]
    out = grouped.agg(*aggregates)
    others = [c for c in out.columns if c not in (*keys, "window")]
    return out.select(*names, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *others)


def rewindow_time(df: DataFrame) -> Column:
    """Time of a fired window's row: its end, so that it lies in the next window of the same size (batch)."""
    return F.col("window_end")
