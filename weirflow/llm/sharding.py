"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is a fixed grid of cells of the key's hash. Each shard has many virtual
nodes on it; a key belongs to the next node clockwise. Loads are bounded: keys
beyond a shard's capacity go on clockwise to the next shard with room. Rows of a
cell are alike to the ring, so the walk is made once over the cells' counts (as
many as the grid has, whatever the table size) and gives ranges of ranks per cell;
rows find their shard and slot from their rank with DataFrame functions alone. A
cell with very many rows, such as that of a repeated key, is ranked in many tasks.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import cut, ranked, read

#: Cells of the ring (a power of two) and virtual nodes of each shard.
CELL_BITS = 14
REPLICAS = 64
SHARDS = 16


def ring(shards: int, replicas: int = REPLICAS, bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """Virtual nodes in clockwise order: (cell, shard). A node's place depends on its own name only."""
    nodes = [(xxhash.xxh64_intdigest(f"shard {s} node {v}") >> (64 - bits), s) for s in range(shards) for v in range(replicas)]
    return sorted(nodes)


def capacities(rows: int, shards: int, load: float = 1.0) -> list[int]:
    """Most rows of each shard. With load 1 they add up to the rows, so that counts are at most one apart."""
    if load <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load * rows / shards)] * shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int], bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, slot of the first) for all rows of all cells.

    Every shard first takes its own keys in ring order up to its capacity; what is
    left over continues clockwise to the next shard with room.
    """
    room, used = list(room), [0] * len(room)
    owner, k = {}, 0
    for cell in range(1 << bits):
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        owner[cell] = k % len(nodes)
    out, over = [], []

    def take(cell: int, at: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((cell, at, at + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return n

    for cell in sorted(counts):
        n = take(cell, 0, counts[cell], nodes[owner[cell]][1])
        if n < counts[cell]:
            over.append((cell, n, counts[cell] - n))
    for cell, at, left in over:
        k = owner[cell]
        while left:
            k = (k + 1) % len(nodes)
            n = take(cell, at, left, nodes[k][1])
            at, left = at + n, left - n
    return out


def shard(docs: DataFrame, shards: int = SHARDS, load: float = 1.0, replicas: int = REPLICAS, bits: int = CELL_BITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    The key is doc_id. With ``load`` 1 counts are at most one apart; with a larger
    one a shard has at most ``load`` times the mean and fewer keys leave their own
    place. Slots are gapless from 0 in each shard. A null text has size 1 and the
    checksum of no bytes. Null ids are one key; repeated rows get slots of their
    own. An empty table gives an empty table. Other columns are left out, whatever
    their names.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 64 - bits).cast("int").alias("cell"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    ranges = walk(counts, ring(shards, replicas, bits), capacities(sum(counts.values()), shards, load), bits)
    plan = spark.createDataFrame(ranges or [(-1, 0, 0, 0, 0)], "at int, low long, high long, shard int, base long")
    rows = ranked(rows.withColumn("place", F.xxhash64("doc_id")), "cell", counts, ["place", "doc_id", "text_crc32", "size"])
    # The plan has at most one range per cell and one more per shard that filled up on the way.
    found = rows.join(F.broadcast(plan), (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
