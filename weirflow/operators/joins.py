"""Interval join: equal keys, and times at most a bound apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.expressions import epoch_ms


def interval_join(left: DataFrame, right: DataFrame, key: str, bound_ms: int, left_ts: str = "ts", right_ts: str = "ts", how: str = "inner", spread: bool | None = None) -> DataFrame:
    """Pairs with the same key (null equals null) and |left time - right time| <= bound, both ends included.

    Columns come out as ``l_...`` and ``r_...``. The condition is written as a range,
    from which a stream's state is evicted. On batches (``spread``) rows are also
    matched by time bucket, so that a key with very many rows is dealt over many
    tasks and each row meets three buckets instead of its key's whole history.
    """
    if bound_ms < 0:
        raise ValueError("the bound must not be negative")
    streaming = left.isStreaming or right.isStreaming
    spread = not streaming and how == "inner" and bound_ms > 0 if spread is None else spread
    l = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    bound = F.expr(f"INTERVAL '{bound_ms / 1000:.3f}' SECOND")
    lt, rt = F.col(f"l_{left_ts}"), F.col(f"r_{right_ts}")
    on = F.col(f"l_{key}").eqNullSafe(F.col(f"r_{key}")) & (rt >= lt - bound) & (rt <= lt + bound)
    if not spread:
        return l.join(r, on, how)
    bucket = lambda ms: F.floor(ms / F.lit(bound_ms)).cast("bigint")
    at = epoch_ms(lt)
    l = l.withColumn("_lb", F.explode(F.sequence(bucket(at - bound_ms), bucket(at + bound_ms))))
    r = r.withColumn("_rb", bucket(epoch_ms(rt)))
    return l.join(r, on & (F.col("_lb") == F.col("_rb"))).drop("_lb", "_rb")


def attribution(clicks: DataFrame, impressions: DataFrame, key: str = "ad_id", bound_ms: int = 300_000, ts: str = "ts") -> DataFrame:
    """Clicks with the impressions of the same ad within the bound: who, what, when and how long between."""
    pairs = interval_join(clicks, impressions, key, bound_ms, ts, ts)
    c, i = epoch_ms(f"l_{ts}"), epoch_ms(f"r_{ts}")
    return pairs.select(
        F.col("l_user_id").alias("user_id"), F.col(f"l_{key}").alias(key), c.alias("click_timestamp"), i.alias("impression_timestamp"), (c - i).alias("time_to_click_ms")
    )


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Join a table by key; it is sent to all tasks only if it has at most ``max_rows`` rows and, written as JSON, ``max_bytes`` bytes, and shuffled otherwise."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, measured = table.limit(max_rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    small = rows <= max_rows and measured <= max_bytes
    return df.join(F.broadcast(table) if small else table, keys, how)
