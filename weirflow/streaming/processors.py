"""Keyed state on streams: process functions, running aggregates and deduplication with expiry."""

from __future__ import annotations

import bisect
import pickle
import sys
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirflow.session import keyed_store, ship


def _by_value(function: Callable) -> None:
    """Pickle processors and the function by value: Spark's runner for state set-up imports nothing that was sent with ``addPyFile``."""
    for name in (__name__, getattr(function, "__module__", None)):
        module = sys.modules.get(name or "")
        if module is not None and name not in ("__main__", "builtins") and "site-packages" not in (getattr(module, "__file__", None) or "site-packages"):
            cloudpickle.register_pickle_by_value(module)


_EXACT = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes, T.BooleanType: bool}


def _checked(schema: T.StructType) -> Callable:
    """``(values) -> tuple`` of plain Python values that the schema takes; others are an error where they are given, not when they are written."""
    kinds = [_EXACT.get(type(f.dataType)) for f in schema.fields]
    verify = T._make_type_verifier(schema)

    def plain(values) -> tuple:
        if len(values) == len(kinds):
            for v, kind in zip(values, kinds):
                if type(v) is not kind or (kind is int and not -(1 << 63) <= v < 1 << 63):
                    break
            else:  # as nearly always; the rest takes far longer
                return tuple(values)
        row = tuple(v.item() if isinstance(v, np.generic) else bytes(v) if isinstance(v, bytearray) else v for v in values)
        row = tuple(float(v) if kind is float and type(v) is int else v for v, kind in zip(row, kinds)) if len(row) == len(kinds) else row
        verify(row)
        return row

    return plain


def _copied(schema: T.StructType) -> Callable:
    """Copies values that can be changed in place, as a round trip to the store does."""
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in schema.fields):
        return lambda row: pickle.loads(pickle.dumps(row))
    return lambda row: row


#: What is not read from the store yet.
_UNREAD = object()


class HeldValue:
    """A value state that is read and written once for all of a key's rows of a micro-batch.

    Each call to Spark's store is a round trip from Python to the executor and back.
    ``flush`` writes what has changed and forgets it, before the next key's rows.
    ``undo`` takes back what has changed since ``mark``.
    """

    def __init__(self, cell, schema: T.StructType):
        self.cell, self.plain, self.copy = cell, _checked(schema), _copied(schema)
        self.value, self.changed = _UNREAD, False

    def get(self):
        if self.value is _UNREAD:
            self.value = self.cell.get()
        return self.copy(self.value)

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, values: tuple) -> None:
        self.value, self.changed = self.copy(self.plain(values)), True

    def clear(self) -> None:
        self.value, self.changed = None, True

    def mark(self) -> None:
        self.before = self.value, self.changed

    def undo(self) -> None:
        self.value, self.changed = self.before

    def load(self, content) -> None:
        self.value, self.changed = content, False

    def content(self):
        """All of it, None if empty, for ``load``."""
        return self.value

    def flush(self) -> None:
        if self.changed:
            self.cell.clear() if self.value is None else self.cell.update(self.value)
        self.value, self.changed = _UNREAD, False


class HeldList:
    """The same for a list state. Entries that are only appended are not read, and entries that were there are not written again."""

    def __init__(self, cell, schema: T.StructType):
        self.cell, self.plain, self.copy = cell, _checked(schema), _copied(schema)
        self.stored, self.added, self.fresh = _UNREAD, [], False

    def _stored(self) -> list:
        if self.stored is _UNREAD:
            self.stored = list(self.cell.get())
        return self.stored

    def exists(self) -> bool:
        return bool(self.added or self._stored())

    def get(self) -> Iterator[tuple]:
        return iter([self.copy(r) for r in (*self._stored(), *self.added)])

    def put(self, rows: list[tuple]) -> None:
        self.added, self.stored, self.fresh = [self.copy(self.plain(r)) for r in rows], [], True

    def append_value(self, row: tuple) -> None:
        self.append_list([row])

    def append_list(self, rows: list[tuple]) -> None:
        self.added += [self.copy(self.plain(r)) for r in rows]

    appendValue, appendList = append_value, append_list

    def clear(self) -> None:
        self.added, self.stored, self.fresh = [], [], True

    @property
    def changed(self) -> bool:
        return bool(self.fresh or self.added)

    def mark(self) -> None:
        self.before = self.stored, self.added, len(self.added), self.fresh

    def undo(self) -> None:
        self.stored, self.added, n, self.fresh = self.before
        del self.added[n:]

    def load(self, content) -> None:
        self.stored, self.added, self.fresh = content or [], [], False

    def content(self):
        return [*self.stored, *self.added] or None

    def flush(self) -> None:
        if self.fresh:
            self.cell.put(self.added) if self.added else self.cell.clear()
        elif self.added:
            self.cell.appendList(self.added)
        self.stored, self.added, self.fresh = _UNREAD, [], False


class HeldMap:
    """The same for a map state, entry by entry: an entry is read where it is asked for, all are where they are gone through, and only those that changed are written."""

    def __init__(self, cell, key_schema: T.StructType, schema: T.StructType):
        self.cell, self.plain_key, self.plain, self.copy = cell, _checked(key_schema), _checked(schema), _copied(schema)
        self.log = []
        self._forget()

    def _forget(self) -> None:
        self.known, self.touched, self.whole, self.fresh = {}, set(), False, False

    def _set(self, key: tuple, value) -> None:
        self.log.append((self.known, self.touched, key, self.known.get(key, _UNREAD), key in self.touched))
        self.known[key] = value
        self.touched.add(key)

    def _at(self, key: tuple):
        key = self.plain_key(key)
        if key not in self.known:
            self.known[key] = None if self.whole else self.cell.getValue(key)
        return self.known[key]

    def _all(self) -> dict:
        if not self.whole:
            self.known, self.whole = {tuple(k): tuple(v) for k, v in self.cell.iterator()} | self.known, True
        return self.known if None not in self.known.values() else {k: v for k, v in self.known.items() if v is not None}

    def exists(self) -> bool:
        return any(self.known[k] is not None for k in self.touched) or bool(self._all())

    def getValue(self, key: tuple):
        return self.copy(self._at(key))

    def containsKey(self, key: tuple) -> bool:
        return self._at(key) is not None

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._set(self.plain_key(key), self.copy(self.plain(value)))

    def removeKey(self, key: tuple) -> None:
        self._set(self.plain_key(key), None)

    def iterator(self) -> Iterator[tuple]:
        return iter([(k, self.copy(v)) for k, v in self._all().items()])

    def keys(self) -> Iterator[tuple]:
        return iter(list(self._all()))

    def values(self) -> Iterator[tuple]:
        return iter([self.copy(v) for v in self._all().values()])

    def clear(self) -> None:
        self._forget()
        self.whole = self.fresh = True

    @property
    def changed(self) -> bool:
        return bool(self.fresh or self.touched)

    def mark(self) -> None:
        self.before, self.log = (self.known, self.touched, self.whole, self.fresh), []

    def undo(self) -> None:
        for known, touched, key, value, was in reversed(self.log):
            if value is _UNREAD:
                known.pop(key, None)
            else:
                known[key] = value
            if not was:
                touched.discard(key)
        (self.known, self.touched, self.whole, self.fresh), self.log = self.before, []

    def load(self, content) -> None:
        self._forget()
        self.known, self.whole = dict(content or ()), True

    def content(self):
        return dict(self._all()) or None

    def flush(self) -> None:
        if self.fresh:
            self.cell.clear()
        for key in self.touched:
            if self.known[key] is not None:
                self.cell.updateValue(key, self.known[key])
            elif not self.fresh:
                self.cell.removeKey(key)
        self._forget()


class ReducingState:
    """First value, then ``step(current, next)``; a stored None counts as empty."""

    def __init__(self, cell, step: Callable):
        self.cell, self.step = cell, step

    def get(self):
        return pickle.loads(self.cell.get()[0]) if self.cell.exists() else None

    def add(self, value) -> None:
        now = self.get()
        self.cell.update((pickle.dumps(value if now is None else self.step(now, value)),))

    def clear(self) -> None:
        self.cell.clear()


class AggregatingState:
    """``get`` of what ``add`` made of the start; also of the bare start while empty."""

    def __init__(self, cell, add: Callable, get: Callable, start):
        self.cell, self.adder, self.getter, self.start = cell, add, get, start

    def _now(self):
        return pickle.loads(self.cell.get()[0]) if self.cell.exists() else self.start

    def get(self):
        return self.getter(self._now())

    def add(self, value) -> None:
        self.cell.update((pickle.dumps(self.adder(self._now(), value)),))

    def clear(self) -> None:
        self.cell.clear()


class Descriptor:
    """A named state of one kind; names keep states of one key apart. ``schema`` is that of a value, list entry or map value."""

    KINDS = ("value", "list", "map", "reducing", "aggregating")

    def __init__(self, name: str, kind: str = "value", ttl_ms: int | None = None, schema: str = "value binary", key_schema: str = "key string"):
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind of state {kind!r}; one of {', '.join(self.KINDS)}")
        self.name, self.kind, self.ttl_ms, self.schema, self.key_schema = name, kind, ttl_ms, schema, key_schema
        self.step = self.adder = self.getter = self.start = self.parsed = self.parsed_key = None

    def with_reduce_function(self, step: Callable) -> Descriptor:
        self.step = step
        return self

    def with_aggregator(self, add: Callable, get: Callable, start) -> Descriptor:
        self.adder, self.getter, self.start = add, get, start
        return self

    def parse(self) -> Descriptor:
        """Called on the driver, which alone can parse schemas."""
        self.parsed = T._parse_datatype_string(self.schema if self.kind in ("value", "list", "map") else "value binary")
        self.parsed_key = T._parse_datatype_string(self.key_schema)
        return self

    def create(self, handle: StatefulProcessorHandle | None = None):
        """(what is held, the state) in a processor's ``init``; Spark's own list and map states for those kinds, or none without a handle."""
        if self.kind == "list":
            held = HeldList(handle and handle.getListState(self.name, self.parsed, self.ttl_ms), self.parsed)
        elif self.kind == "map":
            held = HeldMap(handle and handle.getMapState(self.name, self.parsed_key, self.parsed, self.ttl_ms), self.parsed_key, self.parsed)
        else:
            held = HeldValue(handle and handle.getValueState(self.name, self.parsed, self.ttl_ms), self.parsed)
        if self.kind == "reducing":
            return held, ReducingState(held, self.step)
        return held, AggregatingState(held, self.adder, self.getter, self.start) if self.kind == "aggregating" else held


#: Rows that a processor may hold back before they are handed on.
OUT_ROWS = 10_000


def _ready(spark, *functions: Callable) -> None:
    ship(spark)
    keyed_store(spark)
    for function in functions:
        _by_value(function)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str] | None) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch: sorted, or without an order chunk by chunk as they come, none held."""
    if not order:
        return rows
    return iter([pd.concat(list(rows)).sort_values(order)])


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    columns = list(frame.columns)
    return (dict(zip(columns, row)) for row in frame.itertuples(index=False, name=None))


def _frame(out: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows to hand on; whole numbers beside nulls stay whole, where pandas would make doubles of them."""
    frame = pd.DataFrame(out, columns=names)
    for k, kind in enumerate(frame.dtypes):
        if kind == float and frame.iloc[:, k].hasnans:
            values = [row[k] for row in out]
            if all(v is None or type(v) is int for v in values):
                frame.isetitem(k, pd.Series(values, dtype=object))
    return frame


class KeyedProcess(StatefulProcessor):
    """``function(key, row, state) -> (rows, new state)``; rows that raise are left out and counted, or with ``strict`` fail the query.

    With ``descriptors`` the state is a dict of states by name, each of its own kind,
    kept by Spark's store, and what the function returns as new state does not matter.
    They are read and written once for all of a key's rows of a micro-batch, and what
    a row that is left out has changed in them is taken back.
    A function object may have ``open()`` and ``close()``, called around its use.
    """

    def __init__(self, function: Callable, order: list[str] | None, names: list[str], ttl_ms: int | None = None, descriptors: tuple[Descriptor, ...] = (), failed=None, strict: bool = False):
        self.function, self.order, self.names, self.ttl_ms, self.descriptors, self.failed, self.strict = function, order, names, ttl_ms, descriptors, failed, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        made = {d.name: d.create(handle) for d in self.descriptors}
        self.held, self.states = [h for h, _ in made.values()], {n: s for n, (_, s) in made.items()}
        self.cell = None if self.states else handle.getValueState("state", "value binary", self.ttl_ms)
        if hasattr(self.function, "open"):
            self.function.open()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.states or (pickle.loads(self.cell.get()[0]) if self.cell.exists() else None)
        key, out = key[0] if len(key) == 1 else key, []
        for frame in _in_order(rows, self.order):
            for record in _records(frame):
                for held in self.held:
                    held.mark()
                try:
                    made, after = self.function(key, record, state)
                    out += list(made)
                    state = state if self.states else after
                except Exception:  # the row is left out, as on batches
                    if self.strict:
                        raise
                    for held in self.held:
                        held.undo()
                    if self.failed is not None:
                        self.failed.add(1)
                if len(out) >= OUT_ROWS:
                    yield _frame(out, self.names)
                    out = []
        for held in self.held:
            held.flush()
        if self.cell is not None:
            if state is None:
                self.cell.clear()
            else:
                self.cell.update((pickle.dumps(state),))
        yield _frame(out, self.names)

    def close(self) -> None:
        if hasattr(self.function, "close"):
            self.function.close()


#: Groups that keys with packed states are dealt over; a group's rows of a micro-batch are held together.
BUCKETS = 512


class PackedProcess(StatefulProcessor):
    """``KeyedProcess`` with descriptors for many keys: all states of a key are one entry of a map state.

    Keys come in buckets. A bucket's rows are one call of Spark's, and each key that
    has rows is read once and, if anything changed, written once; a row costs no
    round trip. ``gaps`` names a text with a 1 for each column that is null in a row.
    """

    def __init__(self, function: Callable, bucket: str, marks: list[str], order: list[str] | None, names: list[str], descriptors: tuple[Descriptor, ...], failed=None, strict: bool = False, gaps: str | None = None, beside: tuple[str, ...] = ()):
        self.function, self.bucket, self.marks, self.order, self.names, self.descriptors, self.failed = function, bucket, marks, order, names, descriptors, failed
        self.strict, self.gaps, self.beside = strict, gaps, {bucket, *marks, *beside, *([gaps] if gaps else [])}

    def init(self, handle: StatefulProcessorHandle) -> None:
        made = {d.name: d.create() for d in self.descriptors}
        self.held, self.states = {n: h for n, (h, _) in made.items()}, {n: s for n, (_, s) in made.items()}
        self.store = handle.getMapState("states", "key binary", "value binary")
        if hasattr(self.function, "open"):
            self.function.open()

    def _read(self, key: bytes) -> None:
        found = self.store.getValue((key,))
        contents = pickle.loads(found[0]) if found is not None else {}
        for name, held in self.held.items():
            held.load(contents.get(name))

    def _write(self, key: bytes) -> None:
        if not any(held.changed for held in self.held.values()):
            return
        contents = {n: c for n, held in self.held.items() if (c := held.content()) is not None}
        if contents:
            self.store.updateValue((key,), (pickle.dumps(contents),))
        else:
            self.store.removeKey((key,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, n = [], len(self.marks) // 2
        frames = rows if not self.order else iter([pd.concat(list(rows))])
        for frame in frames:
            frame = frame.sort_values([*self.marks, *(self.order or [])], kind="stable")
            columns = [c for c in frame.columns if c not in self.beside]
            marks, gaps = frame[self.marks].itertuples(index=False, name=None), frame[self.gaps] if self.gaps else repeat(None)
            current = None
            for mark, gap, row in zip(marks, gaps, frame[columns].itertuples(index=False, name=None)):
                if isinstance(gap, str):
                    row = tuple(None if null == "1" else v for v, null in zip(row, gap))
                values = tuple(None if null else v for v, null in zip(mark[:n], mark[n:]))
                packed = pickle.dumps(values)
                if packed != current:
                    if current is not None:
                        self._write(current)
                    self._read(packed)
                    current = packed
                    own = values[0] if n == 1 else values
                for held in self.held.values():
                    held.mark()
                try:
                    made, _ = self.function(own, dict(zip(columns, row)), self.states)
                    out += list(made)
                except Exception:  # the row is left out, as on batches
                    if self.strict:
                        raise
                    for held in self.held.values():
                        held.undo()
                    if self.failed is not None:
                        self.failed.add(1)
                if len(out) >= OUT_ROWS:
                    yield _frame(out, self.names)
                    out = []
            if current is not None:
                self._write(current)
        yield _frame(out, self.names)

    def close(self) -> None:
        if hasattr(self.function, "close"):
            self.function.close()


def _packed(df: DataFrame, keys: list[str], order: list[str] | None, function: Callable, schema: str, descriptors: tuple[Descriptor, ...], failed, strict: bool) -> DataFrame:
    """Whole numbers go without nulls, which would make them doubles, and nulls are told beside: for keys in marks, for all columns of a row
    in one text, null where none is, and for the order, in which nulls are last, in columns before each of its own."""
    kinds = dict(df.dtypes)
    own = "own"  # Spark renames what begins with an underscore
    while any(c.lower().startswith(own) for c in df.columns):
        own += "s"
    bucket, gaps, values, nulls = f"{own}bucket", f"{own}gaps", [f"{own}key{k}" for k in range(len(keys))], [f"{own}null{k}" for k in range(len(keys))]
    whole, real = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    filled = lambda c: F.coalesce(column(c), F.lit(0).cast(kinds[c]))
    value = lambda k: filled(k) + F.lit(0).cast(kinds[k]) if kinds[k] in whole + real else column(k)
    last = {c: f"{own}last{k}" for k, c in enumerate(order or []) if kinds[c] in whole}
    flags = [column(c).isNull() for c in df.columns]
    cells = {**{v: value(k) for v, k in zip(values, keys)}, **{n: column(k).isNull() for n, k in zip(nulls, keys)}, **{n: column(c).isNull() for c, n in last.items()}}
    cells[gaps] = F.when(reduce(lambda a, b: a | b, flags), F.concat(*(F.when(f, "1").otherwise("0") for f in flags)))
    dealt = df.withColumns({**cells, **{c: filled(c) for c in df.columns if kinds[c] in whole}}).withColumn(bucket, F.pmod(F.hash(*values, *nulls), F.lit(BUCKETS)))
    sorted_by = [n for c in order for n in ([last[c], c] if c in last else [c])] if order else order
    processor = PackedProcess(function, bucket, [*values, *nulls], sorted_by, _names(schema), descriptors, failed, strict, gaps, tuple(last.values()))
    return dealt.groupBy(bucket).transformWithStateInPandas(processor, schema, "Update", "None")


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def keyed_process(df: DataFrame, keys: list[str], order: list[str] | None, function: Callable, schema: str, ttl_ms: int | None = None, descriptors: tuple[Descriptor, ...] = (), failed=None, packed: bool = True, strict: bool = False) -> DataFrame:
    """The streaming twin of the batch operator of that name.

    Rows that make the function raise are left out, leave states of descriptors alone
    and are counted by ``failed`` (an accumulator). With ``strict`` the first fails
    the query instead, where a row that is missing would pass for a result.

    A key's rows of a micro-batch are taken in ``order``, for which they are held
    together (limit what a trigger reads); without an order they are taken as they
    come, a chunk at a time. With a time to live (``ttl_ms``) Spark goes on making
    micro-batches while nothing comes, so such a stream never ends by itself: do not
    run it with ``availableNow`` or wait for all that is available.

    States of ``descriptors`` without a time to live are packed: all of a key are one
    entry of the store, and an order holds a bucket's rows of a micro-batch together.
    Their function gets whole numbers whole and None for every null.
    Unless ``packed``, each is a state of Spark's of its own, for keys with long lists or
    maps of which a micro-batch changes little; that takes several times as long.
    """
    _ready(df.sparkSession, function)
    descriptors = tuple(d.parse() for d in descriptors)
    if descriptors and packed and not ttl_ms and not any(d.ttl_ms for d in descriptors):
        return _packed(df, keys, order, function, schema, descriptors, failed, strict)
    time = "ProcessingTime" if ttl_ms or any(d.ttl_ms for d in descriptors) else "None"
    return df.groupBy(*keys).transformWithStateInPandas(KeyedProcess(function, order, _names(schema), ttl_ms, descriptors, failed, strict), schema, "Update", time)


class Running(StatefulProcessor):
    """Running aggregate of one column: a chunk at a time over arrays, with four numbers of state a key."""

    def __init__(self, function: str, order: list[str] | None, value: str, names: list[str]):
        self.function, self.order, self.value, self.names = function, order, value, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("state", "n bigint, total double, low double, high double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, low, high = self.cell.get() if self.cell.exists() else (0, 0.0, np.inf, -np.inf)
        for frame in _in_order(rows, self.order):
            x = pd.to_numeric(frame[self.value]).to_numpy(float)
            known = ~np.isnan(x)
            count = n + np.arange(1, len(x) + 1)
            sums = np.cumsum(np.concatenate([[total], np.where(known, x, 0.0)]))[1:]
            lows = np.minimum.accumulate(np.concatenate([[low], np.where(known, x, np.inf)]))[1:]
            highs = np.maximum.accumulate(np.concatenate([[high], np.where(known, x, -np.inf)]))[1:]
            if len(x):
                n, total, low, high = int(count[-1]), float(sums[-1]), float(lows[-1]), float(highs[-1])
            result = {"sum": sums, "count": count.astype(float), "avg": sums / count, "min": np.where(np.isinf(lows), np.nan, lows), "max": np.where(np.isinf(highs), np.nan, highs)}
            yield frame.assign(result=result[self.function])[self.names]
        self.cell.update((n, total, low, high))

    def close(self) -> None:
        pass


def running(df: DataFrame, key: str, order: list[str] | None, value: str, function: str, schema: str) -> DataFrame:
    """One row per input row with the running aggregate of its key; ``schema`` is the input's with ``result double``. For ``order`` see ``keyed_process``."""
    if function not in ("sum", "count", "avg", "min", "max"):
        raise ValueError(f"unknown aggregate {function!r}")
    _ready(df.sparkSession)
    return df.groupBy(key).transformWithStateInPandas(Running(function, order, value, _names(schema)), schema, "Update", "None")


class RefiringWindows(StatefulProcessor):
    """Tumbling windows whose late rows are not dropped but fire their window again.

    The clock is the largest time of the key less the delay. A window fires once it
    has ended by that clock, with the fold of the rows that came since it last fired.
    Open windows are entries of a map state, one for each window.
    """

    def __init__(self, size_ms: int, delay_ms: int, step: Callable, value: str, ts: str, order: list[str] | None, names: list[str]):
        self.size_ms, self.delay_ms, self.step, self.value, self.ts, self.order, self.names = size_ms, delay_ms, step, value, ts, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "ms bigint")
        self.open = handle.getMapState("windows", "start bigint", "value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()[0] if self.clock.exists() else None
        ends = sorted(start + self.size_ms for (start,) in self.open.keys())
        out = []
        for frame in _in_order(rows, self.order):
            for at, value in zip(frame[self.ts].map(lambda t: t.value // 1_000_000), frame[self.value].tolist()):
                start = at // self.size_ms * self.size_ms
                if self.open.containsKey((start,)):
                    value = self.step(pickle.loads(self.open.getValue((start,))[0]), value)
                else:
                    bisect.insort(ends, start + self.size_ms)
                self.open.updateValue((start,), (pickle.dumps(value),))
                clock = at - self.delay_ms if clock is None else max(clock, at - self.delay_ms)
                while ends and ends[0] <= clock:
                    first = ends.pop(0) - self.size_ms
                    out.append((*key, first, first + self.size_ms, pickle.loads(self.open.getValue((first,))[0])))
                    self.open.removeKey((first,))
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=self.names)
                    out = []
        if clock is not None:
            self.clock.update((clock,))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def refiring_windows(df: DataFrame, key: str, size_ms: int, delay_ms: int, step: Callable, value: str, schema: str, ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Windows per key with late rows kept; ``schema`` names key, start_ms, end_ms and value. For ``order`` see ``keyed_process``."""
    _ready(df.sparkSession, step)
    processor = RefiringWindows(size_ms, delay_ms, step, value, ts, order, _names(schema))
    return df.withColumnRenamed(key, "key").groupBy("key").transformWithStateInPandas(processor, schema, "Update", "None")


def deduplicate(df: DataFrame, keys: list[str], delay_ms: int | None = None, ts: str = "ts") -> DataFrame:
    """First row of each key. With a delay, keys are forgotten once the watermark is past them by that much."""
    if delay_ms is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(ts, f"{delay_ms} milliseconds").dropDuplicatesWithinWatermark(keys)
