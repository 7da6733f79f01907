"""Keyed state on batches: process functions, reducing and aggregating state, deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.expressions import free
from weirflow.operators.aggregates import AUTO, _block, ordered_fold, ordered_reduce
from weirflow.session import ship


#: Rows that a process function may hold back before they are handed on.
OUT_ROWS = 10_000


def keyed_process(df: DataFrame, keys: list[str], order: list[str], function: Callable, schema: str, finish: Callable | None = None, failed=None) -> DataFrame:
    """``function(key, row, state) -> (rows, new state)`` over each key's rows in order.

    The state begins as None, is what the last call returned, and belongs to one key.
    ``finish(key, state) -> rows`` is called after a key's last row. Rows that make a
    function raise are left out, leave the state alone and are counted by ``failed``
    (an accumulator). A key's rows are streamed in batches, never held together, so
    a key of any size takes no more memory than its state. A function object may have
    ``open()`` and ``close()``, called around each task.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    columns = df.columns
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = object(), None, []
        started = False
        if hasattr(function, "open"):
            function.open()

        def attempt(call):
            nonlocal state
            try:
                rows, after = call()
                out.extend(rows)
                state = after
            except Exception:  # the row is left out, as on streams
                if failed is not None:
                    failed.add(1)

        def end():
            if started and finish is not None:
                attempt(lambda: (list(finish(_plain(current), state)), None))

        def _plain(key):
            return key[0] if len(keys) == 1 else key

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                record = dict(zip(columns, row))
                key = tuple(None if pd.isna(record[k]) else record[k] for k in keys)
                if key != current:
                    end()
                    current, state, started = key, None, True
                attempt(lambda: function(_plain(key), record, state))
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        end()
        if hasattr(function, "close"):
            function.close()
        yield pd.DataFrame(out, columns=names)

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def deduplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order. Later rows are dropped before the shuffle as well."""
    number = free("_n", *df.columns)
    rows = df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where(F.col(number) == 1).drop(number)


def reducing(df: DataFrame, keys: list[str], order: list[str], value: str, step: Callable[[Column, Column], Column], block: Column | str | None = AUTO) -> DataFrame:
    """Final reducing state of each key: the first value, then ``step(current, next)``.

    In blocks (a coarser value of the order, chosen unless given) an associative step
    is applied within blocks first and then over the blocks' states, so that no task
    holds all values of a key. Steps that are not associative need ``block`` None.
    """
    block = _block(df, order, block)
    if block is None:
        return df.groupBy(*keys).agg(ordered_reduce(order, value, step).alias("state"))
    own = free("_block", *df.columns)
    parts = df.withColumn(own, block).groupBy(*keys, own).agg(ordered_reduce(order, value, step).alias("_state"))
    return parts.groupBy(*keys).agg(ordered_reduce([own], "_state", step).alias("state"))


def aggregating(df: DataFrame, keys: list[str], order: list[str], value: str, start: Column, add: Callable, get: Callable, merge: Callable | None = None, block: Column | str | None = AUTO) -> DataFrame:
    """Final aggregating state of each key: ``get`` of what ``add`` made of ``start``.

    With ``merge`` accumulators are made within blocks and merged in order.
    """
    block = None if merge is None else _block(df, order, block)
    if block is None:
        return df.groupBy(*keys).agg(ordered_fold(order, value, start, add, get).alias("state"))
    own = free("_block", *df.columns)
    parts = df.withColumn(own, block).groupBy(*keys, own).agg(ordered_fold(order, value, start, add).alias("_state"))
    return parts.groupBy(*keys).agg(ordered_fold([own], "_state", start, merge, get).alias("state"))


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, step: Callable, returns: str, start=None, get: Callable | None = None, failed=None) -> DataFrame:
    """(keys, value): a Python fold of each key's values in order, streamed through one task a key.

    Without ``start`` the first value is the accumulator; ``get`` is applied at the end.
    """
    def each(key, row, state):
        held = state or (start is not None, start)
        return [], (True, step(held[1], row[value]) if held[0] else row[value])

    def finish(key, state):
        held = state or (False, start)
        key = key if len(keys) != 1 else (key,)
        return [(*key, get(held[1]) if get else held[1])]

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"value {returns}"])
    return keyed_process(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, each, schema, finish, failed)
