"""Plumbing shared by the training-data operators.

Nothing here decides results: it reads tables, runs Arrow batch functions and
ranks rows within keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.session import cut, shared_path, ship

__all__ = ["arrow_schema", "cut", "map_arrow", "map_batches", "ranked", "read", "shared_path", "shuffle_partitions"]

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<float>": pa.list_(pa.float32()),
    "array<double>": pa.list_(pa.float64()),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, through Spark's reader (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(ddl: str) -> pa.Schema:
    """``"a long, b string"`` as an Arrow schema."""
    fields = [part.strip().split(" ", 1) for part in ddl.split(",")]
    return pa.schema([(name, ARROW[kind.strip()]) for name, kind in fields])


def map_batches(df: DataFrame, ddl: str, make: Callable[[], Callable]) -> DataFrame:
    """Run a function over Arrow batches.

    ``make()`` runs once per task and returns ``work(*columns)``, which gets the
    batch's Arrow columns and returns the output columns (lists or Arrow arrays).
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = work(*batch.columns)
            arrays = [(c if isinstance(c, pa.Array) else pa.array(c, type=f.type)).cast(f.type) for c, f in zip(out, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return map_arrow(df, run, ddl)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: About the most rows of one key that a task ranks.
CELL_ROWS = 100_000


def ranked(rows: DataFrame, key: str, sizes: dict[int, int], order: list[str], most: int | None = None) -> DataFrame:
    """Add ``rank``, from 0, of each row among those of its ``key``, by native functions alone.

    ``rows`` is cut and has ``_row``, a number of its own for each row; ``sizes`` has
    the rows of each key, of which there are boundedly many. Keys with more than
    ``most`` rows are dealt over cells by that number, as many as their count asks
    for, so that neither a hot key nor repeated rows meet in one task: rows are
    ranked within cells in the given order, and each cell goes on where those before
    it end.
    """
    most = most or CELL_ROWS
    cells = [(k, -(-n // most)) for k, n in sizes.items() if n > most]
    if cells:  # at most one row for each key, which are boundedly many
        hot = rows.sparkSession.createDataFrame(cells, f"{key} {dict(rows.dtypes)[key]}, _cells int")
        rows = rows.join(F.broadcast(hot), key, "left").withColumn("_cell", F.pmod(F.xxhash64("_row"), F.coalesce("_cells", F.lit(1)))).drop("_cells")
    else:
        rows = rows.withColumn("_cell", F.lit(0).cast("long"))
    at = [key, "_cell"]
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*at).count().select(*at, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*order, "_row"))
    return rows.withColumn("rank", own).join(ahead.hint("merge"), at).withColumn("rank", F.col("rank") - 1 + F.col("_ahead")).drop("_cell", "_ahead")
