"""Labelled rows for models that are fitted on a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return remainder(doc_id) == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, text_hash, y), the smallest by hash of the id.

    Labels other than 0 and 1, and null ids, are left out; where a document has
    several labels the smallest counts. An id with several texts comes with each of
    them; ``one_each`` then leaves one. The chosen ids are at most ``rows``, so they
    are broadcast.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(known), "doc_id")


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each doc_id: that of the text with the smallest hash, so that fits repeat whatever the order of rows."""
    others = [c for c in rows.columns if c not in ("doc_id", "text_hash")]
    return rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", *others)).alias("row")).select("doc_id", *(F.col(f"row.{c}").alias(c) for c in others))
