"""Running aggregates on streams without Python: each micro-batch is run by the batch operator.

What a key has so far is a table of partial aggregates beside the output, one
version for each micro-batch; a batch's rows run in blocks as on batches, so a hot
key is many tasks' work, and take up where the last version ended. A batch that is
repeated after a failure reads the same version and writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.expressions import free
from weirflow.operators import aggregates
from weirflow.session import shared_path
from weirflow.streaming.jobs import fitted


def running(df: DataFrame, keys: list[str], order: list[str], functions: dict[str, tuple[str, Column]], name: str = "running", block: Column | str | None = aggregates.AUTO, trigger: dict | None = None) -> DataFrame:
    """Run a stream over all that is there and return its rows with the running aggregates (see ``aggregates.running``).

    Rows of a micro-batch are taken in order, after all rows of earlier ones. Null
    keys are one key. Versions of the state older than the last two are removed.
    """
    columns = df.columns
    if not keys:  # all rows are one key
        keys = [free("_all", *columns)]
        df = df.withColumn(keys[0], F.lit(0))
    spark, out, held = df.sparkSession, shared_path(df.sparkSession, name), shared_path(df.sparkSession, f"{name}-state")
    parts = aggregates.parts_of(functions)
    for function, _ in functions.values():
        aggregates.check(function)
    names = {part: free(f"_{k}", *df.columns) for k, part in enumerate(parts)}
    before = {k: free(f"_before_{k}", *df.columns) for k in keys}

    def step(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        inner = aggregates.running(rows, keys, order, {names[p]: (p[1], functions[p[0]][1]) for p in parts}, block)
        sums = rows.groupBy(*keys).agg(*(aggregates.part_column(p[1], functions[p[0]][1]).alias(names[p]) for p in parts))
        if number:
            state = session.read.parquet(f"{held}/batch={number - 1}")
            mine = state.select(*(F.col(k).alias(before[k]) for k in keys), *(F.col(n).alias(f"{n}_so_far") for n in names.values()))
            on = [F.col(k).eqNullSafe(F.col(before[k])) for k in keys]
            told = inner.join(mine, on, "left")
            combined = {p: aggregates.join_parts(p[1], F.col(n), F.col(f"{n}_so_far")) for p, n in names.items()}
            sums = state.unionByName(sums).groupBy(*keys).agg(*(aggregates.combine(p[1])(n).alias(n) for p, n in names.items()))
        else:
            told, combined = inner, {p: F.col(n) for p, n in names.items()}
        results = (aggregates.whole(f, {part: combined[n, part] for m, part in parts if m == n}).alias(n) for n, (f, _) in functions.items())
        told.select(*columns, *results).write.mode("overwrite").parquet(f"{out}/batch={number}")
        sums.write.mode("overwrite").parquet(f"{held}/batch={number}")
        path = session._jvm.org.apache.hadoop.fs.Path(f"{held}/batch={number - 2}")
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    with fitted(spark):
        query = df.writeStream.foreachBatch(step).option("checkpointLocation", shared_path(spark, f"{name}-log")).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
