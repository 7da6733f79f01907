"""Row by row: map, filter, flat-map, key-by and passthrough.

Each takes a Column or SQL expression, which stays in generated code, or a Python
function. A Python function runs over Arrow batches; rows where it raises are left
out, and ``failed`` (an accumulator, see ``counter``) counts them. Without one they
are not counted; the fluent environment always has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.expressions import free
from weirflow.session import ship

Expression = Column | str | Callable


def counter(spark: SparkSession):
    """A count that tasks add to. A task that is run again counts again, so it is at least what was left out."""
    return spark.sparkContext.accumulator(0)


def _column(expression: Column | str) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression


def _attempt(df: DataFrame, function: Callable, inputs: list[str], returns: T.DataType | str, failed=None) -> Column:
    """struct(ok, value) of a Python function of the input columns."""
    ship(df.sparkSession)
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    out = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", kind)])

    def call(*values):
        try:
            return True, function(*values)
        except Exception:
            if failed is not None:
                failed.add(1)
            return False, None

    return F.udf(call, out, useArrow=True)(*inputs)


def map_rows(df: DataFrame, expression: Expression, out: str = "value", inputs: list[str] | None = None, returns: T.DataType | str = "string", failed=None) -> DataFrame:
    """One row out per row in; a null result is a value like any other."""
    if not callable(expression) or isinstance(expression, Column):
        return df.withColumn(out, _column(expression))
    own = free("_try", *df.columns)
    tried = df.withColumn(own, _attempt(df, expression, inputs or [out], returns, failed)).where(F.col(own)["ok"])
    return tried.withColumn(out, F.col(own)["value"]).drop(own)


def filter_rows(df: DataFrame, condition: Expression, inputs: list[str] | None = None, failed=None) -> DataFrame:
    """Rows where the condition holds; null and (for Python functions) a failure count as no, any truthy result as yes."""
    if not callable(condition) or isinstance(condition, Column):
        return df.where(_column(condition))
    own = free("_try", *df.columns)
    tried = df.withColumn(own, _attempt(df, lambda *v: bool(condition(*v)), inputs or ["value"], "boolean", failed))
    return tried.where(F.col(own)["ok"] & F.col(own)["value"]).drop(own)


def flat_map(df: DataFrame, expression: Expression, out: str = "value", inputs: list[str] | None = None, returns: str = "string", failed=None) -> DataFrame:
    """A row per element, in order; null, empty and failing inputs give none."""
    if not callable(expression) or isinstance(expression, Column):
        return df.withColumn(out, F.explode(_column(expression)))
    own = free("_try", *df.columns)
    tried = df.withColumn(own, _attempt(df, lambda *v: list(expression(*v)), inputs or [out], f"array<{returns}>", failed)).where(F.col(own)["ok"])
    return tried.withColumn(out, F.explode(F.col(own)["value"])).drop(own)


def key_by(df: DataFrame, selector: Expression, inputs: list[str] | None = None, returns: str = "string", failed=None) -> DataFrame:
    """Set ``key``; nothing is shuffled before an operator needs it."""
    return map_rows(df, selector, "key", inputs or ["value"], returns, failed)


def with_value(df: DataFrame, expression: Column | str) -> DataFrame:
    return df.withColumn("value", _column(expression))


def with_key(df: DataFrame, expression: Column | str) -> DataFrame:
    return df.withColumn("key", _column(expression))


def with_timestamp(df: DataFrame, expression: Column | str) -> DataFrame:
    return df.withColumn("ts", _column(expression))


def passthrough(df: DataFrame) -> DataFrame:
    return df.select("*")


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of several inputs, by column name; columns that one lacks are null there."""
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def rebalance(df: DataFrame, partitions: int) -> DataFrame:
    """Round robin over partitions."""
    return df.repartition(partitions)


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by the given order (a top-k, without a full sort)."""
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], **columns: str) -> DataFrame:
    """(keys, columns): of each key's last row in order; combined before the shuffle."""
    return df.groupBy(*keys).agg(*(F.max_by(c, F.struct(*order)).alias(out) for out, c in columns.items()))


def counts_by_state(df: DataFrame, column: str, states: list[str]) -> DataFrame:
    """One row: how many rows have each state, and how many there are."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == s).alias(f"n_{s}") for s in states))
