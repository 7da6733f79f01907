"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are dealt into lists by their nearest centroid (fitted on a bounded
sample; every vector is indexed). A query probes its nearest lists, as many as a
sample's true neighbours ask for. Within a list vectors are rotated at random and
looked at in blocks of dimensions: after each block a partial distance estimates
the whole one, and a candidate that a hypothesis test finds too far is abandoned
early. Survivors are measured exactly on their original components.

The test needs a distance to beat. A first round scans each query's nearest lists
and gives it the distance of its ``k``-th neighbour there; that limit goes with the
query to all other lists, wherever they are scanned. In the first round the
``k`` + 1 candidates that look nearest after one block are measured in full and
set the limit for the rest of the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import arrow_schema, cut, map_arrow, map_batches, read, shuffle_partitions
from weirflow.session import ship

#: Bounds of the sample that centroids are fitted on: rows, and components in all.
SAMPLE_ROWS, SAMPLE_COMPONENTS = 20_000, 8_000_000
MAX_LISTS = 4096
#: Probes are as many as hold this share of the true neighbours of this many sampled vectors.
TARGET, CALIBRATION = 0.985, 96
#: Largest block of rows (of some lists) and of queries that meet in one task's memory.
LIST_BLOCK, QUERY_BLOCK = 8192, 1024
#: Pairs of queries and candidates that are looked at together, and that are measured in full together.
PAIRS, MEASURED = 1 << 20, 1 << 16
#: Smallest block that rows of smaller tables are dealt in, so that all tasks get some.
LEAST_BLOCK = 256
DIMENSIONS = 16
#: Chance that one test abandons a candidate that is just as near as the limit.
ALPHA = 0.001
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of vectors that can be compared.

    Null and zero vectors, those with null or non-finite components, null ids, and
    vectors not of the most frequent dimension (ties: the smaller) take no part.
    Repeated rows count once; other columns are left out, whatever their names.
    Components stay as they are: doubles are not rounded to floats.
    """
    v = F.col("vector")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size(v) == (size["size"] if size else 0))


def grouped(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): each distinct vector once, with its ``keep`` smallest ids, which are all that can be among nearest."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.groupBy("vector", "id").agg(F.lit(1).alias("one")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def centroids(sample: np.ndarray, lists: int, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    """Lloyd's iterations on the sample; empty lists keep their centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        nearest = np.concatenate([_to_centres(part, centres).argmin(1) for part in np.array_split(sample, 1 + len(sample) // 2048)])
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros(centres.shape)
        np.add.at(sums, nearest, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres.astype(np.float32) ** 2).sum(1) - 2 * x.astype(np.float32) @ centres.T


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def critical(seen: int, dims: int, alpha: float = ALPHA) -> float:
    """Share of a squared distance that ``seen`` of ``dims`` dimensions exceed with chance ``alpha``.

    After a random rotation that share has a beta distribution of half the seen and
    half the other dimensions, whatever the vectors.
    """
    x = (np.arange(100_000) + 0.5) / 100_000
    density = (seen / 2 - 1) * np.log(x) + ((dims - seen) / 2 - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(density - density.max()))
    return float(x[min(np.searchsorted(mass, (1 - alpha) * mass[-1]), len(x) - 1)])


class Scan:
    """Candidates of some lists against some queries, list by list.

    ``found`` has the pairs that were measured and may be among the ``k`` nearest;
    ``limit`` is each query's distance to beat. ``scanned`` and ``abandoned`` count
    candidates by query: all, and those given up before their last block.
    """

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int, limit: np.ndarray | None = None, alpha: float = ALPHA):
        self.queries, self.vectors, self.k = queries.astype(np.float64), vectors, k
        turned, asked = (x.astype(np.float32) @ turn for x in (vectors, queries))
        self.blocks = [(np.ascontiguousarray(turned[:, a : a + DIMENSIONS]), np.ascontiguousarray(asked[:, a : a + DIMENSIONS])) for a in range(0, turn.shape[1], DIMENSIONS)]
        self.dims = dims = turn.shape[1]
        self.bounds = [critical(seen, dims, alpha) if seen < dims else math.inf for seen in range(DIMENSIONS, dims + DIMENSIONS, DIMENSIONS)]
        n = len(queries)
        self.limit = np.full(n, np.inf) if limit is None else limit.astype(np.float64)
        self.top = np.full((n, k), np.inf)  # of distinct vectors, so the query's own may be one
        self.scanned, self.abandoned = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(self, who: np.ndarray, start: int, end: int) -> None:
        """Rows ``start`` to ``end`` for the queries ``who``."""
        step = max(1, PAIRS // (end - start))
        for at in range(0, len(who), step):
            self._look(who[at : at + step], start, end)

    def _look(self, who: np.ndarray, start: int, end: int) -> None:
        x, q = self.blocks[0]
        x, q = x[start:end], q[who]
        norms = (q**2).sum(1)[:, None] + (x**2).sum(1)
        partial, slack = norms - 2 * q @ x.T, 1e-5 * norms  # single precision
        self.scanned[who] += end - start
        seeded = np.zeros(partial.shape, bool)
        new = np.flatnonzero(np.isinf(self.limit[who]))
        if len(new):  # nothing to beat yet: measure those that look nearest
            some = min(self.k + 1, end - start)
            nearest = np.argpartition(partial[new], some - 1, axis=1)[:, :some]
            seeded[new[:, None], nearest] = True
            self._measure(np.repeat(who[new], some), start + nearest.ravel())
        i, j = np.nonzero((partial - slack <= self.limit[who, None] ** 2 * self.bounds[0]) & ~seeded)
        partial, i, j = np.maximum(partial[i, j], 0), who[i], start + j
        for (x, q), bound in zip(self.blocks[1:], self.bounds[1:]):
            partial = partial + ((x[j] - q[i]) ** 2).sum(1)
            good = partial <= self.limit[i] ** 2 * bound + 1e-9
            partial, i, j = partial[good], i[good], j[good]
        self.abandoned[who] += end - start - seeded.sum(1)
        self.abandoned -= np.bincount(i, minlength=len(self.abandoned))
        self._measure(i, j)

    def _measure(self, i: np.ndarray, j: np.ndarray) -> None:
        """Exact distances of pairs of queries and rows; queries come in order."""
        for at in range(0, len(i), MEASURED):
            a, b = i[at : at + MEASURED], j[at : at + MEASURED]
            d = np.sqrt(((self.vectors[b].astype(np.float64) - self.queries[a]) ** 2).sum(1))
            order = np.lexsort((d, a))
            who, first, n = np.unique(a[order], return_index=True, return_counts=True)
            place = np.arange(len(a)) - np.repeat(first, n)
            few = place < self.k
            merged = np.full((len(who), 2 * self.k), np.inf)
            merged[:, : self.k] = self.top[who]
            merged[np.repeat(np.arange(len(who)), n)[few], self.k + place[few]] = d[order][few]
            merged.sort(axis=1)
            self.top[who] = merged[:, : self.k]
            self.limit[who] = np.minimum(self.limit[who], self.top[who, self.k - 1])
            near = d <= self.limit[a]
            self.found.append((a[near], b[near], d[near]))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of all that is not beyond the limit, ties included."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, d = (np.concatenate(c) for c in zip(*self.found))
        near = d <= self.limit[i]
        return i[near], j[near], d[near]


def probes_needed(indexed: DataFrame, centres: np.ndarray, some: np.ndarray, k: int, target: float = TARGET) -> int:
    """How many nearest lists hold ``target`` of the true ``k`` nearest of ``some`` vectors (at most ``CALIBRATION``), by brute force over all rows."""
    shared = indexed.sparkSession.sparkContext.broadcast(some)
    ddl = "asked int, list int, score double"
    schema = arrow_schema(ddl)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0), np.zeros(0, np.int32)]
        best = [held] * len(shared.value)
        for batch in batches:
            if batch.num_rows:
                x, lists = _matrix(batch.column(0)).astype(np.float64), batch.column(1).to_numpy()
                for i, q in enumerate(shared.value):
                    d = np.concatenate([best[i][0], np.sqrt(((x - q) ** 2).sum(1))])
                    w = np.concatenate([best[i][1], lists])
                    top = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                    best[i] = [d[top], w[top]]
        for i, (d, w) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(w), pa.array(d)], schema=schema)

    order = Window.partitionBy("asked").orderBy("score", "list")
    found = map_arrow(indexed.select("vector", "list"), nearest, ddl).withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= k + 1))
    place = np.argsort(np.argsort(_to_centres(some, centres), axis=1, kind="stable"), axis=1)
    ranks = sorted(int(place[r["asked"], r["list"]]) for r in found.collect())
    return ranks[max(0, math.ceil(target * len(ranks)) - 1)] + 1 if ranks else 1


def blocks_of_lists(held: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """list: (shard, row blocks). Lists are put together in shards of at most ``size`` rows; a larger one is a shard of its own, in blocks."""
    out, shard, room = {}, -1, 0
    for x, n in sorted(held.items()):
        if n > size:
            shard, room = shard + 1, 0
            out[x] = shard, -(-n // size)
        else:
            if n > room:
                shard, room = shard + 1, size
            room -= n
            out[x] = shard, 1
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, lists: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, n_scanned, n_abandoned): the ``k`` nearest found of all other rows, by Euclidean distance.

    ``vectors`` and ``queries`` come from ``usable``: null, zero and non-finite
    vectors and null ids take no part, repeated rows count once. Ties go to the
    smaller id. Every query probes ``probes`` nearest lists (calibrated for
    ``target`` if not given), and more until they hold more than ``k`` rows, so that
    fewer than ``k`` come back only where there are fewer; no vectors or no queries
    give an empty table. The last two columns count a query's candidates in all its
    lists, and those that the test abandoned. Lists share shards, so that a query is
    sent once to each shard that it needs.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vector"]
    distinct = cut(grouped(vectors, k + 1))
    total = distinct.count()
    first = distinct.select("vector").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_scanned long, n_abandoned long")
    dims = len(first[0])
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // dims))
    sample = np.array(distinct.select("vector").orderBy(F.xxhash64("vector")).limit(rows).toPandas()["vector"].tolist(), np.float64)
    lists = lists or max(1, min(MAX_LISTS, math.isqrt(total)))
    centres = centroids(sample, lists)
    shared = spark.sparkContext.broadcast(centres)

    def assign():
        def work(vector, ids):
            return vector, ids, _to_centres(_matrix(vector), shared.value).argmin(1).astype(np.int32)

        return work

    indexed = cut(map_batches(distinct.select("vector", "ids"), f"vector {kind}, ids array<long>, list int", assign))
    if probes is None:
        probes = probes_needed(indexed, centres, sample[:CALIBRATION], k, target)
    held = {r["list"]: (r["n"], r["ids"]) for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    block = min(LIST_BLOCK, max(LEAST_BLOCK, total // (2 * shuffle_partitions(spark))))
    shards = blocks_of_lists({x: n for x, (n, _) in held.items()}, block)
    ids_in = np.array([held.get(x, (0, 0))[1] for x in range(len(centres))], np.int64)
    shard_of = np.array([shards.get(x, (-1, 0))[0] for x in range(len(centres))], np.int64)
    wide = spark.sparkContext.broadcast((ids_in, shard_of))
    ddl = f"id long, vector {kind}, shard int, lists array<int>, first boolean"
    schema = arrow_schema(ddl)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each query by shard: in the first round those nearest that hold more than ``k`` rows, later the others."""
        ids_in, shard_of = wide.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                order = np.argsort(_to_centres(_matrix(part.column(1)), shared.value), axis=1, kind="stable")
                enough = np.cumsum(ids_in[order], axis=1) > k
                need = np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1])
                out = []
                for n, own in enumerate(order):
                    for mine, first in ((own[: need[n]], True), (own[need[n] : probes], False)):
                        where = shard_of[mine]
                        out += [(n, int(s), mine[where == s].tolist(), first) for s in np.unique(where[where >= 0])]
                if out:
                    n, s, mine, first = zip(*out)
                    taken = part.take(pa.array(n, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, f.type) for c, f in zip((s, mine, first), list(schema)[2:]))], schema=schema)

    asked = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    probed = cut(map_arrow(asked, probe, ddl))
    turn = spark.sparkContext.broadcast(rotation(dims).astype(np.float32))
    nearest = cut(_visit(indexed, probed.where("first").withColumn("limit", F.lit(math.inf)), shards, turn, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = nearest.where("vec_id is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    others = probed.where("not first").join(best, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
    found = nearest.unionByName(_visit(indexed, others, shards, turn, k))
    whole, top = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.asc_nulls_last("score"), "vec_id")
    counted = found.withColumns({"n_scanned": F.sum("scanned").over(whole), "n_abandoned": F.sum("abandoned").over(whole), "rank": F.row_number().over(top)})
    return counted.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "n_scanned", "n_abandoned")


def _visit(indexed: DataFrame, probed: DataFrame, shards: dict[int, tuple[int, int]], turn, k: int) -> DataFrame:
    """(query_id, vec_id, score, scanned, abandoned) of the nearest in each block of lists and queries.

    ``probed`` has each query's lists by shard and its limit. Counts come in a row
    of their own, without vec_id, for each query and block.
    """
    spark = indexed.sparkSession
    wanted = {r["shard"]: r["count"] for r in probed.groupBy("shard").count().collect()}
    # How many blocks of rows and of queries each list's shard has: at most MAX_LISTS rows.
    grid = spark.createDataFrame([(x, s, n, -(-wanted.get(s, 0) // QUERY_BLOCK)) for x, (s, n) in shards.items()], "list int, shard int, row_blocks int, query_blocks int").where("query_blocks > 0")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = indexed.join(F.broadcast(grid), "list").select("shard", F.pmod(F.xxhash64("vector"), F.col("row_blocks")).cast("int").alias("r"), span("query_blocks").alias("q"), "list", "vector", "ids")
    per_shard = grid.groupBy("shard").agg(F.max("row_blocks").alias("row_blocks"), F.max("query_blocks").alias("query_blocks"))
    right = probed.join(F.broadcast(per_shard), "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int").alias("q"), span("row_blocks").alias("r"), "id", "vector", "lists", "limit")
    ddl = "query_id long, vec_id long, score double, scanned long, abandoned long"
    schema = arrow_schema(ddl)

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("list")
        own, ids, names = rows["list"].to_numpy(), rows["ids"].to_pylist(), asks["id"].to_numpy()
        scan = Scan(_matrix(asks["vector"]), _matrix(rows["vector"]), turn.value, k + 1, asks["limit"].to_numpy())
        wants = pa.compute.list_flatten(asks["lists"]).to_numpy()
        who = pa.compute.list_parent_indices(asks["lists"]).to_numpy()
        order = np.argsort(wants, kind="stable")
        wants, who = wants[order], who[order]
        for x in np.unique(own):
            scan.look(who[np.searchsorted(wants, x) : np.searchsorted(wants, x, side="right")], int(np.searchsorted(own, x)), int(np.searchsorted(own, x, side="right")))
        i, j, d = scan.result()
        best: dict[int, list] = {}
        for a, b, distance in zip(i.tolist(), j.tolist(), d.tolist()):
            best.setdefault(a, []).extend((distance, v) for v in ids[b] if v != names[a])
        out = [(names[a], v, distance, 0, 0) for a, near in best.items() for distance, v in sorted(near)[:k]]
        out += [(n, None, None, s, a) for n, s, a in zip(names, scan.scanned.tolist(), scan.abandoned.tolist())]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    keys = ["shard", "r", "q"]
    ship(spark)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ddl)


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a float matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("id") % 100 == 0))
