"""Best-fit packing of tokenised documents into sequences of fixed length.

Pattern packing: lengths are at most ``size``, so the whole corpus is described by
one bounded histogram. Patterns of one to three lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what remains is packed by best-fit decreasing, again
in repeated patterns. The plan (some thousand runs of equal patterns, whatever the
corpus size) is broadcast; each piece finds its place from its rank among pieces
of its length, which is counted in as many tasks as a length's pieces ask for.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe
from weirflow.llm.common import arrow_schema, cut, map_batches, ranked, read

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
#: Patterns of three lengths tried for each longest length.
TRIPLES = 2
#: Shares of the fitted repeat counts that are tried, in this order.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, ids: bool = False, special: bool = True) -> DataFrame:
    """Tokenise whole texts, end each with id 0 and cut those longer than ``size``.

    One row per piece: ``PIECES`` and, if asked, ``ids`` (little-endian unsigned
    32-bit). The strings of special tokens in a text are read as those tokens, as
    the library does, or as ordinary text if not ``special``. A null or empty text gives one piece of length 1. Repeated
    rows and null ids give pieces like any other; other columns are left out,
    whatever their names.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        import pyarrow as pa

        coder = bpe.word_bpe(path, special)
        schema = arrow_schema(PIECES + (", ids binary" if ids else ""))

        def work(doc_ids, texts):
            out = []
            for doc, text in zip(doc_ids.to_pylist(), texts.to_pylist()):
                raw = coder.encode(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *((part,) if ids else ())))
            return [pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)]

        return work

    ddl = PIECES + (", ids binary" if ids else "")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ddl, make)


@dataclass
class Run:
    """``repeat`` sequences from ``first`` on, each holding the given (length, how often) in order; ``fitted``: a pattern of the least squares."""

    parts: list[tuple[int, int]]
    repeat: int
    first: int
    fitted: bool


def patterns(histogram: np.ndarray, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the size, from lengths that occur."""
    size = len(histogram) - 1
    have = histogram > 0
    out = [(size, 0, 0)] if have[size] else []
    for a in range(size - 1, 0, -1):
        if not have[a]:
            continue
        rest = size - a
        if rest <= a and have[rest]:
            out.append((a, rest, 0))
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)  # the second; the third is rest - b <= b
        if len(b):
            supply = np.minimum(histogram[b], histogram[rest - b])
            for k in np.argsort(-supply, kind="stable")[:triples]:
                if supply[k] > 0:
                    out.append((a, int(b[k]), int(rest - b[k])))
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram (multiplicative updates)."""
    weight = (rows > 0).astype(float)
    target = histogram.astype(float)
    up = lambda v: (v[rows] * weight).sum(1)
    down = lambda x: np.bincount(rows.ravel(), (x[:, None] * weight).ravel(), len(histogram))
    x, wanted = np.full(len(rows), target.sum() / max(1, weight.sum())), up(target)
    for _ in range(rounds):
        x *= wanted / np.maximum(up(down(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, triples: int = TRIPLES, shares: tuple[float, ...] = SHARES) -> list[Run]:
    """Runs that place every piece of the histogram (index: length) exactly once.

    Fitted repeat counts are rounded down after taking one of ``shares`` of them:
    the more of the histogram patterns take, the less choice is left for the rest.
    The first share that gives the fewest sequences counts; the search ends where
    no fewer are possible.
    """
    size = len(histogram) - 1
    whole = histogram.astype(np.int64).copy()
    whole[0] = 0
    rows = patterns(whole, triples)
    fitted = nnls(rows, whole) if len(rows) else np.zeros(0)
    fewest = max(-(-int((np.arange(size + 1) * whole).sum()) // size), int(whole[size // 2 + 1 :].sum()))
    best: list[Run] = []
    for share in shares:
        runs = _place(whole, rows, fitted * share)
        if not best or _sequences(runs) < _sequences(best):
            best = runs
        if _sequences(best) <= fewest:
            break
    return best


def _sequences(runs: list[Run]) -> int:
    return runs[-1].first + runs[-1].repeat if runs else 0


def _place(whole: np.ndarray, rows: np.ndarray, x: np.ndarray) -> list[Run]:
    """Patterns as often as ``x`` rounded down (and what is left) allows, then residuals by best-fit decreasing."""
    left, first, runs = whole.copy(), 0, []
    size = len(left) - 1

    def place(parts: list[tuple[int, int]], repeat: int, fitted: bool) -> None:
        nonlocal first
        runs.append(Run(parts, repeat, first, fitted))
        first += repeat
        for length, times in parts:
            left[length] -= times * repeat

    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1 - 1e-9:
            break
        lengths, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        repeat = min(int(x[k] + 1e-9), int((left[lengths] // times).min()))
        if repeat > 0:
            place(list(zip(lengths.tolist(), times.tolist())), repeat, True)
    while True:  # the longest first, then always the longest that still fits
        present = np.flatnonzero(left).tolist()
        if not present:
            return runs
        room, parts = size, []
        for length in reversed(present):
            times = min(room // length, int(left[length]))
            if times:
                parts.append((length, times))
                room -= times * length
            if not room:
                break
        place(parts, min(int(left[length]) // times for length, times in parts), False)


class Places:
    """The plan as arrays: from (length, rank) to (sequence, offset), for many pieces at once."""

    def __init__(self, runs: list[Run], size: int):
        used = np.zeros(size + 1, np.int64)
        cells: list[list[tuple[int, int, int, int, bool]]] = [[] for _ in range(size + 1)]
        for run in runs:
            offset = 0
            for length, times in run.parts:
                cells[length].append((int(used[length]), times, run.first, offset, run.fitted))
                used[length] += times * run.repeat
                offset += times * length
        self.bounds = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
        flat = np.array([x for c in cells for x in c], np.int64).reshape(-1, 5)
        self.rank, self.times, self.first, self.offset, self.fitted = flat.T.copy()
        # One sorted key for all lengths, so that a single search serves a batch.
        self.wide = int(used.max()) + 1
        self.key = np.repeat(np.arange(size + 1), np.diff(self.bounds)) * self.wide + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, whether the sequence is of a fitted pattern) of pieces."""
        k = np.searchsorted(self.key, length * self.wide + rank, side="right") - 1
        within = rank - self.rank[k]
        return self.first[k] + within // self.times[k], self.offset[k] + within % self.times[k] * length, self.fitted[k] > 0


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``from_pattern`` (fitted, not of the residuals) to pieces (``PIECES``).

    Only a histogram of at most ``size`` counts comes to the driver. Offsets in a
    sequence are gapless from 0; no piece is cut, repeated or left out, whatever ids
    are null or repeated. An empty table gives an empty table.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]
    parts = cut(parts.select(*names, F.monotonically_increasing_id().alias("_row")))
    counted = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counted.items():
        histogram[length] = n
    shared = parts.sparkSession.sparkContext.broadcast(Places(plan(histogram), size))
    found = ranked(parts, "length", counted, ["doc_id", "piece", "start"]).select(*names, "rank")

    def make():
        def work(doc, piece, start, length, crc, rank):
            return doc, piece, start, length, crc, *shared.value.find(length.to_numpy(), rank.to_numpy())

        return work

    return map_batches(found, f"{PIECES}, sequence_id long, offset long, from_pattern boolean", make)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents")))
