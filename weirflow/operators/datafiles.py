"""Operations on data files (columns of texts): filter, transform, aggregate, anomaly and passthrough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.expressions import free, now_iso, number
from weirflow.operators.aggregates import AUTO, grouped_running

OPERATORS = ("equals", "contains", "greater_than", "less_than")
OPERATIONS = ("filter", "transform", "aggregate", "anomaly", "passthrough")


def _record(df: DataFrame) -> Column:
    return F.struct(*(F.col(c) for c in df.columns)).alias("record")


def _text(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit("")


def matches(df: DataFrame, column: str, operator: str, value: str, strict: bool = True) -> DataFrame:
    """Rows that pass: texts are compared without case, numbers as doubles; a value that is no number does not pass.

    A missing column is empty. An unknown operator is an error, or passes all if not ``strict``.
    """
    text = _text(df, column)
    if operator == "equals":
        return df.where(F.lower(text) == F.lower(F.lit(value)))
    if operator == "contains":
        return df.where(F.contains(F.lower(text), F.lower(F.lit(value))))
    if operator == "greater_than":
        return df.where(number(text) > number(F.lit(value)))
    if operator == "less_than":
        return df.where(number(text) < number(F.lit(value)))
    if strict:
        raise ValueError(f"unknown operator {operator!r}; one of {', '.join(OPERATORS)}")
    return df


def filtered(df: DataFrame, column: str, operator: str, value: str, strict: bool = True) -> DataFrame:
    rows = matches(df, column, operator, value, strict)
    return rows.select(F.lit("filter").alias("operation"), F.lit("PASS").alias("result"), _record(df))


def upper_case(df: DataFrame) -> DataFrame:
    """All text columns in upper case."""
    return df.select(*(F.upper(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


def transformed(df: DataFrame, source: str) -> DataFrame:
    """Upper case, with when and from what file (in lower case) it was made."""
    rows = upper_case(df).withColumn("_processed_at", now_iso()).withColumn("_source", F.lit(source.lower()))
    return rows.select(F.lit("transform").alias("operation"), F.struct("*").alias("result"))


def aggregated(df: DataFrame, group: str | None, function: str, value: str | None, order: list[str], block: Column | str | None = AUTO, scale: int | None = None, strict: bool = True) -> DataFrame:
    """The running aggregate after each row, rounded to two digits, halves to even.

    An unknown function is an error, or counts if not ``strict``. For ``block`` and
    ``scale`` see ``grouped_running``. ``record`` is the row.
    """
    known = function if strict or function in ("count", "sum", "avg") else "count"
    whole = free("_whole", *df.columns)
    rows = grouped_running(df.withColumn(whole, _record(df)), group, known, value, order, block, scale)
    return rows.select(F.lit("aggregate").alias("operation"), "group", F.lit(function).alias("function"), F.bround("result", 2).alias("result"), F.col(whole).alias("record"))


def anomalies(df: DataFrame, column: str, threshold: str = "100") -> DataFrame:
    """Whether each value lies above the threshold; unreadable values are kept with an error. A missing column is 0."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("0")) if column in df.columns else F.lit("0")
    value, limit = number(text), number(F.lit(threshold))
    bad = value.isNull() | limit.isNull()
    return df.select(
        F.lit("anomaly").alias("operation"),
        F.lit(column).alias("column"),
        value.alias("value"),
        limit.alias("threshold"),
        F.when(~bad, value > limit).alias("is_anomaly"),
        F.when(~bad, F.when(value > limit, "ANOMALY").otherwise("NORMAL")).alias("status"),
        F.when(bad, F.concat(F.lit("could not convert to a number: "), text)).alias("error"),
        _record(df),
    )


def passed(df: DataFrame) -> DataFrame:
    return df.select(F.lit("passthrough").alias("operation"), F.lit("PASS").alias("result"), _record(df))


def process(df: DataFrame, operation: str, source: str = "", order: list[str] | None = None, **options) -> DataFrame:
    """One operation by name, with its own options; an unknown name passes rows through."""
    if operation == "filter":
        return filtered(df, options["column"], options["operator"], options["value"], options.get("strict", True))
    if operation == "transform":
        return transformed(df, source)
    if operation == "aggregate":
        more = {k: options[k] for k in ("block", "scale") if k in options}
        return aggregated(df, options.get("group"), options.get("function", "count"), options.get("value"), order or [df.columns[0]], strict=options.get("strict", True), **more)
    if operation == "anomaly":
        return anomalies(df, options["column"], options.get("threshold", "100"))
    return passed(df)
