"""Example jobs, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.expressions import words
from weirflow.operators import aggregates, windows
from weirflow.operators.joins import attribution
from weirflow.operators.rows import passthrough
from weirflow.operators.state import deduplicate
from weirflow.streaming import processors


def word_count(lines: DataFrame, text: str = "text", window_ms: int | None = None, above: int = 5, ts: str = "ts") -> DataFrame:
    """Words in lower case that come more than ``above`` times (per window, if given)."""
    found = lines.select(F.explode(words(F.lower(text))).alias("word"), *([ts] if window_ms else []))
    counted = windows.aggregate(found, ["word"], windows.Tumbling(window_ms), F.count("*").alias("cnt"), ts=ts) if window_ms else found.groupBy("word").agg(F.count("*").alias("cnt"))
    return counted.where(F.col("cnt") > above)


def sensor_windows(readings: DataFrame, key: str = "sensor_id", value: str = "temperature", size_ms: int = 30_000, slide_ms: int = 10_000, order: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Halving fold and count per sensor and sliding window, with the true mean beside it."""
    order = order or [ts]
    return windows.aggregate(readings, [key], windows.Sliding(size_ms, slide_ms), aggregates.halving(order, value).alias(value), F.count("*").alias("count"), F.avg(value).alias("mean"), ts=ts)


def first_events(events: DataFrame, keys: list[str], order: list[str], delay_ms: int | None = None) -> DataFrame:
    """Each event once."""
    return processors.deduplicate(events, keys, delay_ms) if events.isStreaming else deduplicate(events, keys, order)


click_attribution = attribution
simple_pipeline = passthrough
