"""Byte-level BPE encoding and decoding of document texts."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe
from weirflow.llm.common import map_batches, read

VOCABULARY = "byte_bpe_50k.tiktoken"


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: (id, ``ids`` binary, ``n_tokens``).

    ``ids`` holds little-endian unsigned 32-bit integers, without special tokens.
    A null text counts as empty: no ids, ``n_tokens`` 0. A null id stays null.
    Repeated rows are encoded each; other columns are left out, whatever their
    names. An empty table gives an empty table.
    """
    return _run(docs, path, id_col, text_col, "ids binary, n_tokens long", _encode)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids to the bytes they stand for: (id, ``decoded`` binary). Null ids: no bytes."""
    return _run(encoded, path, id_col, ids_col, "decoded binary", _decode)


def _encode(coder, text):
    ids = coder.encode(text or "")
    return ids, len(ids) // 4


def _decode(coder, ids):
    return (coder.decode(ids or b""),)


def _round_trip(coder, text):
    """Both in one pass, so that ids need not be written between."""
    ids = coder.encode(text or "")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


def _run(df: DataFrame, path: str | None, id_col: str, col: str, ddl: str, each) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        coder = bpe.byte_bpe(path)

        def work(ids, values):
            rows = [each(coder, v) for v in values.to_pylist()]
            return [ids, *map(list, zip(*rows))]

        return work

    return map_batches(df.select(_long(id_col).alias(id_col), F.col(col)), f"{id_col} long, {ddl}", make)


def _long(name: str) -> Column:
    return F.col(name).cast("long")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    docs = read(spark, sf_dir, "documents")
    return _run(docs, None, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", _round_trip)
