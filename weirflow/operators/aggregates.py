"""Running aggregates, ordered folds and metric smoothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.expressions import epoch_ms, free, histogram_bucket, number

FUNCTIONS = ("sum", "count", "avg", "min", "max")


def check(name: str) -> str:
    if name not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {name!r}; one of {', '.join(FUNCTIONS)}")
    return name


#: Rows for each block of the order, about, where blocks are chosen; and most blocks.
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 4096
AUTO = "auto"


def blocks(df: DataFrame, order: str, rows: int | None = None) -> Column | None:
    """A coarser value of a number or time: equal parts of its range, as many as the table's rows ask for.

    None where the table is small, or the column is of another kind, or all its
    values are alike. One pass over a single column.
    """
    kind = df.schema[order].dataType.simpleString()
    if kind.startswith("timestamp") or kind == "date":
        value = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.col(order).cast("double")
    else:
        return None
    low, high, n = df.agg(F.min(value), F.max(value), F.count("*")).first()
    parts = min(MOST_BLOCKS, -(-n // (rows or BLOCK_ROWS)))
    if parts < 2 or low is None or not low < high < float("inf"):
        return None
    return F.coalesce(F.floor((value - F.lit(low)) * F.lit(parts / (high - low))), F.lit(-1))


def _block(df: DataFrame, order: list[str], block: Column | str | None) -> Column | None:
    if not isinstance(block, str):
        return block
    if block != AUTO:
        raise ValueError(f"block must be a column, None or {AUTO!r}")
    return None if df.isStreaming else blocks(df, order[0])


def running(df: DataFrame, keys: list[str], order: list[str], functions: dict[str, tuple[str, Column]], block: Column | str | None = AUTO) -> DataFrame:
    """Add one running aggregate per name: {name: (function, value)}, a row each row, in the given order.

    ``count`` counts every row, ``avg`` is the sum over that count. Rows of a key
    with the same order take any order among them; nulls of the order come first. A
    column that has a name of the aggregates' is replaced.

    A key's rows are not all brought to one task: each block of a key (``block``, a
    coarser value of the order, such as the day; chosen by ``blocks`` unless given)
    is summed first, what comes before a block is taken from those sums, and rows
    run within blocks. With ``block`` None each key is one task's.
    """
    for name, (function, _) in functions.items():
        check(function)
    block = _block(df, order, block)
    columns = [c for c in df.columns if c not in functions]
    if block is None:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*columns, *(whole(f, _parts(f, v, over)).alias(n) for n, (f, v) in functions.items()))
    names = {(n, p): (free(f"_{n}_{p}", *df.columns), free(f"_in_{n}_{p}", *df.columns)) for n, (f, v) in functions.items() for p in _partial(f, v)}
    own = free("_block", *df.columns)
    rows = df.withColumn(own, block)
    at = [*keys, own]
    sums = rows.groupBy(*at).agg(*(c.alias(names[n, p][0]) for n, (f, v) in functions.items() for p, c in _partial(f, v).items()))
    before = Window.partitionBy(*keys).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    keyed = {c: free(f"_k_{c}", *rows.columns) for c in at}
    carried = sums.select(*(F.col(c).alias(keyed[c]) for c in at), *(combine(p)(out).over(before).alias(out) for (n, p), (out, _) in names.items()))
    over = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", *(c.over(over).alias(names[n, p][1]) for n, (f, v) in functions.items() for p, c in _partial(f, v).items()))
    both = inner.join(carried, [F.col(c).eqNullSafe(F.col(keyed[c])) for c in at])
    joined = {n: {p: join_parts(p, F.col(names[n, p][1]), F.col(names[n, p][0])) for p in _partial(f, v)} for n, (f, v) in functions.items()}
    return both.select(*columns, *(whole(f, joined[n]).alias(n) for n, (f, _) in functions.items()))


def _partial(function: str, value: Column) -> dict[str, Column]:
    if function == "count":
        return {"count": F.count(F.lit(1))}
    if function == "sum":
        return {"sum": F.sum(value)}
    if function == "avg":
        return {"sum": F.sum(value), "count": F.count(F.lit(1))}
    return {function: getattr(F, function)(value)}


def parts_of(functions: dict[str, tuple[str, Column]]) -> list[tuple[str, str]]:
    """(name, part) of all that running aggregates are made of."""
    return [(n, p) for n, (f, v) in functions.items() for p in _partial(f, v)]


def part_column(part: str, value: Column) -> Column:
    return _partial(part, value)[part]


def combine(part: str) -> Callable:
    """The aggregate that puts partial ones together."""
    return F.sum if part in ("sum", "count") else getattr(F, part)


def _parts(function: str, value: Column, over) -> dict[str, Column]:
    return {p: c.over(over) for p, c in _partial(function, value).items()}


def join_parts(part: str, inner: Column, carried: Column) -> Column:
    """A partial aggregate after what was there before; null: nothing."""
    if part in ("sum", "count"):
        return F.when(inner.isNull(), carried).when(carried.isNull(), inner).otherwise(inner + carried)
    return F.greatest(inner, carried) if part == "max" else F.least(inner, carried)


def whole(function: str, parts: dict[str, Column]) -> Column:
    """The aggregate from its parts."""
    if function == "avg":
        return parts["sum"].cast("double") / parts["count"]
    return parts[function]


def ordered_list(order: list[str], value: Column | str) -> Column:
    """Aggregate: the values of a group as an array in the given order (nulls kept)."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.sort_array(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.transform(rows, lambda r: r["_value"])


def ordered_reduce(order: list[str], value: Column | str, step: Callable[[Column, Column], Column]) -> Column:
    """Aggregate: left fold in order, ``step(so far, next)``; a single value comes out as it is.

    For steps that depend on order, a group's values are brought together; use it
    on groups that a window bounds. Where the step is associative and commutative,
    use the aggregate of that name instead, which is combined before the shuffle.
    """
    values = ordered_list(order, value)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), step)


def ordered_fold(order: list[str], value: Column | str, start: Column, step: Callable, finish: Callable | None = None) -> Column:
    """Aggregate: left fold in order from ``start``; ``finish`` is applied even to empty groups' start."""
    values = ordered_list(order, value)
    return F.aggregate(values, start, step, finish) if finish else F.aggregate(values, start, step)


def halving(order: list[str], value: Column | str) -> Column:
    """(a + b) / 2 from the left: not a mean, as later values weigh more."""
    return ordered_reduce(order, value, lambda a, b: (a + b) / 2)


def smoothed(order: list[str], value: Column | str, share: float = 0.1) -> Column:
    """Exponential moving average from 0: share x + (1 - share) before."""
    rest = 1 - share
    return ordered_fold(order, value, F.lit(0.0), lambda acc, x: F.lit(share) * x + F.lit(rest) * acc)


def linear_fold(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float, take: float, block: Column | str | None = AUTO, out: str = "folded") -> DataFrame:
    """(keys, ``out``): acc = keep acc + take x over each key's rows in order, from 0.

    The fold is a weighted sum, so no group is collected: rows are weighted within
    blocks (a coarser value of the order, chosen unless given), and blocks by how
    many rows of the key come after them. Equal to the fold up to rounding.
    """
    block = _block(df, order, block)
    names = [free(f"_{n}", *df.columns) for n in ("block", "n", "part", "rows")]
    own, number, part, rows = names
    at = [*keys, own]
    back = Window.partitionBy(*at).orderBy(*[F.desc(c) for c in order])
    weighed = df.withColumn(own, F.lit(0) if block is None else block).withColumn(number, F.row_number().over(back))
    parts = weighed.groupBy(*at).agg(F.sum(F.col(value) * F.lit(take) * F.pow(F.lit(keep), F.col(number) - 1)).alias(part), F.count("*").alias(rows))
    later = Window.partitionBy(*keys).orderBy(F.desc(own)).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum(rows).over(later), F.lit(0))
    return parts.withColumn(part, F.col(part) * F.pow(F.lit(keep), after)).groupBy(*keys).agg(F.sum(part).alias(out))


def backpressure(df: DataFrame, keys: list[str], order: list[str], wait: str, samples: int = 100, limit_ms: float = 1.0, block: Column | str | None = AUTO, slice_rows: int = 100_000) -> DataFrame:
    """Share of the last ``samples`` waits above the limit, and their mean, at every row; ``wait`` is taken as it is.

    Where the table has blocks (see ``running``), each key's rows are numbered in
    order and dealt in slices; a slice is told the last rows of the one before it,
    so that no task has all rows of a key.
    """
    block = _block(df, order, block)

    def measured(rows: DataFrame, at: list[str]) -> DataFrame:
        over = Window.partitionBy(*at).orderBy(*order).rowsBetween(1 - samples, 0)
        n = F.count(F.lit(1)).over(over)
        slow = F.sum((F.col(wait) > limit_ms).cast("int")).over(over)
        return rows.select("*", (slow / n).alias("backpressure_ratio"), (F.sum(F.col(wait)).over(over).cast("double") / n).alias("mean_wait"))

    if block is None:
        return measured(df, keys)
    number, part, told = (free(f"_{n}", *df.columns) for n in ("number", "slice", "told"))
    rows = running(df, keys, order, {number: ("count", F.lit(1))}, block)
    mine = F.floor((F.col(number) - 1) / slice_rows)
    last = (F.col(number) - 1) % slice_rows >= slice_rows - samples + 1
    rows = rows.withColumn(part, F.explode(F.when(last, F.array(mine, mine + 1)).otherwise(F.array(mine)))).withColumn(told, F.col(part) > mine)
    return measured(rows, [*keys, part]).where(~F.col(told)).select(*df.columns, "backpressure_ratio", "mean_wait")


def job_metrics(reports: DataFrame, keys: list[str], task: str, order: list[str], block: Column | str | None = AUTO) -> DataFrame:
    """Totals of jobs over their tasks' reports (records, latency_ms, backpressure).

    Records are added up. Each task's latency is smoothed over its reports in order
    (share 0.3) and its back-pressure is that of its last report; a job has the mean
    of the one and the largest of the other. No task's reports are collected.
    """
    each = [*keys, task]
    totals = reports.groupBy(*each).agg(F.sum("records").alias("_records"), F.max_by("backpressure", F.struct(*order)).alias("_backpressure"))
    folded = linear_fold(reports, each, order, "latency_ms", 0.7, 0.3, block, "_latency")
    folded = folded.select(*(F.col(c).alias(f"_k_{c}") for c in each), "_latency")
    both = totals.join(folded, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in each])
    return both.groupBy(*keys).agg(F.sum("_records").alias("records"), F.avg("_latency").alias("mean_latency_ms"), F.max("_backpressure").alias("max_backpressure"), F.count("*").alias("tasks"))


def grouped_running(df: DataFrame, group: str | None, function: str, value: str | None, order: list[str], block: Column | str | None = AUTO, scale: int | None = None) -> DataFrame:
    """Running count, sum or avg of a text column per group (null or no group: ALL); unreadable values add nothing but are counted.

    Amounts are doubles; with ``scale`` they are decimals of so many places, whose
    sums do not depend on the order of adding.
    """
    if function not in ("count", "sum", "avg"):
        raise ValueError(f"unknown aggregate {function!r}; one of count, sum, avg")
    key = F.coalesce(F.col(group).cast("string"), F.lit("ALL")) if group and group in df.columns else F.lit("ALL")
    amount = F.lit(0.0)
    if value and value in df.columns:
        amount = F.coalesce(number(value), F.lit(0.0))
        amount = amount if scale is None else amount.try_cast(f"decimal(38,{scale})")
    rows = df.withColumn("group", key)
    out = running(rows, ["group"], order, {"result": (function, amount)}, block)
    return out.withColumn("result", F.col("result").cast("double"))


def statistics(df: DataFrame, odd: Column, ts: str = "ts") -> DataFrame:
    """One row: how many rows there are, how many are odd and how many not, the share of odd ones in percent, and the time between first and last."""
    n, found = F.count("*"), F.count_if(odd)
    return df.agg(
        n.alias("total"), found.alias("anomalies"), F.count_if(~odd).alias("normal"),
        (found * F.lit(100.0) / n).alias("anomaly_percent"), (epoch_ms(F.max(ts)) - epoch_ms(F.min(ts))).alias("elapsed_ms"),
    )


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, n): how many values lie in each bucket, numbered by the first bound that they do not exceed."""
    return df.groupBy(histogram_bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))
