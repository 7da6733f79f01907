"""Cross-entropy difference: two matched n-gram models score each document.

The target model is counted over documents labelled as good, the background model
over all documents. Both are bigram models of the same form and smoothing over one
vocabulary, every word of the corpus. A document's score is the mean over its words
of target loss less background loss (in nats): the lower, the more it is like the
target. A target document's own counts are left out of the target model, so that
all documents alike are scored by a target model that has not seen them.

Words and pairs go by 64-bit fingerprints. Documents are gathered in chunks where
they are read, which ask for the counts of their distinct pairs and words; parts of
the fingerprints' range add the counts up and answer each chunk, so that no table of
the corpus is held in one place and no text is moved.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import labelled
from weirflow.llm.common import arrow_schema, cut, map_arrow, read, shuffle_partitions
from weirflow.session import ship

#: Words that smoothing reckons with: those never seen keep their share.
VOCABULARY = 1 << 32
#: Weight of the unigram model in bigram probabilities, in counts.
PRIOR = 16.0
#: Words of a chunk, above which it is handed on, and words of the corpus for each part of the counts.
CHUNK = PART = 1 << 21


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array, compressed place by place: high bytes are mostly alike."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True)


def unpack(packed: bytes, kind: type, *shape: int) -> np.ndarray:
    width, n = np.dtype(kind).itemsize, int(np.prod(shape))
    raw = pa.Codec("zstd").decompress(packed, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(shape)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(docs: DataFrame) -> DataFrame:
    """Whole documents in chunks: their ids, numbers of words, the words as numbers within the chunk and the words' fingerprints.

    ``task`` and ``chunk`` name a chunk. Ids may be null or repeated.
    """
    ddl = "task int, chunk long, doc_ids array<long>, sizes array<long>, n_tokens long, tokens binary, n_words long, words binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0

        def fresh():
            numbers = defaultdict(None, {None: 0})  # 0 stands before the first word
            numbers.default_factory = numbers.__len__
            return numbers, array("I"), [], []

        def out():
            words = b"".join(blake2b(w, digest_size=8).digest() for w in numbers if w is not None)
            x = np.frombuffer(tokens, np.uint32)
            row = (task, chunk, doc_ids, sizes, len(x), pack(x), len(numbers) - 1, words)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        numbers, tokens, doc_ids, sizes = fresh()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                tokens.extend(map(numbers.__getitem__, words))
                doc_ids.append(doc_id)
                sizes.append(len(words))
                if len(tokens) > CHUNK or len(sizes) > CHUNK:
                    yield out()
                    chunk += 1
                    numbers, tokens, doc_ids, sizes = fresh()
        if sizes:
            yield out()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ddl)


def targets(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(task, chunk, places, n_target): where in each chunk target documents stand, and their words.

    Documents labelled 1 for quality are the target, held-out labels aside; ids with
    several labels count if any is 1, null ids never. Only ids and numbers are
    shuffled: labels grow with the corpus, so both sides are, at every size.
    """
    good = labels.where((F.col("quality") == 1) & ~labelled.held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("good_id")).where("good_id is not null").distinct()
    rows = held.select("task", "chunk", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("place", "doc"))
    rows = rows.select("task", "chunk", "place", F.col("doc.doc_ids").alias("good_id"), F.col("doc.sizes").alias("n")).where("good_id is not null")
    found = rows.join(good.hint("merge"), "good_id")
    return found.groupBy("task", "chunk").agg(F.collect_list("place").alias("places"), F.sum("n").alias("n_target"))


class Chunk:
    """What a chunk asks for: its distinct pairs (word before, word) and words, each by fingerprint; before the first word stands 0."""

    def __init__(self, row: dict, places: list[int]):
        self.sizes = np.array(row["sizes"], np.int64)
        self.target = np.zeros(len(self.sizes), bool)
        self.target[places] = True
        x = unpack(row["tokens"], np.uint32, row["n_tokens"]).astype(np.int64)
        self.words = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(row["words"], np.uint64)])
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.zeros_like(x)
        before[1:] = x[:-1]
        before[self.starts] = 0
        at, self.place, n = np.unique(before * len(self.words) + x, return_inverse=True, return_counts=True)
        self.before, self.word = at // len(self.words), at % len(self.words)
        self.pairs = mix(mix(self.words[self.before]) * np.uint64(0x9E3779B97F4A7C15) + self.words[self.word])
        marks = np.repeat(self.target, self.sizes)
        self.counts = np.stack([np.bincount(self.place[marks], minlength=len(at)), n])
        self.order = [np.argsort(k, kind="stable") for k in (self.pairs, self.words)]

    def asked(self, parts: int) -> Iterator[tuple]:
        """(part, pairs, their counts, words, their counts before words and as words), each part a range of fingerprints, target before background."""
        margins = [np.bincount(at, n, len(self.words)).astype(np.int64) for at in (self.before, self.word) for n in self.counts]
        keys = [k[o] for k, o in zip((self.pairs, self.words), self.order)]
        counts = [c[:, o] for c, o in zip((self.counts, np.stack(margins)), self.order)]
        bounds = [np.searchsorted(((k >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)) for k in keys]
        for part in range(parts):
            (a, b), (c, d) = (x[part : part + 2] for x in bounds)
            if b > a or d > c:
                yield part, keys[0][a:b], counts[0][:, a:b], keys[1][c:d], counts[1][:, c:d]

    def losses(self, pairs: np.ndarray, words: np.ndarray, total: tuple[int, int], size: int, prior: float) -> list[np.ndarray]:
        """Mean target and background loss of each document, from the corpus's counts in the order that was asked.

        A target document's own counts are taken off the target's.
        """
        n, margins = np.empty_like(pairs), np.empty_like(words)
        n[:, self.order[0]], margins[:, self.order[1]] = pairs, words
        out = []
        for k in range(2):
            each = loss(n[k], (margins[2 + k][self.word] + 1) / (total[k] + size), margins[k][self.before], prior)[self.place]
            if k == 0 and self.target.any():
                doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
                seen = self.target[doc]
                doc, at = doc[seen], self.place[seen]
                places = (at, self.word[at], self.before[at])
                pair, single, first = (have[p] - _within(doc, p) for have, p in zip((n[0], margins[2], margins[0]), places))
                each[seen] = loss(pair, (single + 1) / (total[0] - self.sizes[doc] + size), first, prior)
            means = np.zeros(len(self.sizes))
            if len(self.starts):
                means[self.sizes > 0] = np.add.reduceat(each, self.starts) / self.sizes[self.sizes > 0]
            out.append(means)
        return out


def _within(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each token's value occurs in its document."""
    if not len(doc):
        return doc
    key = doc * (int(value.max()) + 1) + value
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order], prepend=-1))
    n = np.diff(np.append(edges, len(key)))
    out = np.empty_like(key)
    out[order] = np.repeat(n, n)
    return out


def loss(n: np.ndarray, single: np.ndarray, total: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """-log p(word | word before) from a pair's count, the word's share and the count of pairs with the word before:
    bigram counts with the unigram model, itself smoothed by one, as prior."""
    return np.log(total + prior) - np.log(n + prior * single)


def dealt(held: DataFrame) -> DataFrame:
    """Chunks dealt by name: one shuffle, which asking and scoring share."""
    return held.repartition(max(held.rdd.getNumPartitions(), 1), "task", "chunk").groupBy("task", "chunk")


def requests(held: DataFrame, marked: DataFrame, parts: int) -> DataFrame:
    """Distinct pairs and words of each chunk with their counts there, cut in parts."""
    ddl = "part int, task int, chunk long, n_pairs long, pairs binary, pair_counts binary, n_words long, words binary, word_counts binary"
    schema = arrow_schema(ddl)

    def ask(chunk: pa.Table, places: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        row = chunk.to_pylist()[0]
        asked = Chunk(row, _places(places)).asked(parts)
        rows = [(part, row["task"], row["chunk"], len(p), pack(p), pack(m), len(w), pack(w), pack(n)) for part, p, m, w, n in asked]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()

    return dealt(held).cogroup(marked.groupBy("task", "chunk")).applyInArrow(ask, ddl)


def _places(table: pa.Table) -> list[int]:
    return [p for places in table["places"].to_pylist() if places is not None for p in places]


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """Counts of the corpus for every request, in its order; each part is one task's, whose size the number of parts bounds."""
    ddl = "part int, task int, chunk long, n_pairs long, pair_counts binary, n_asked long, word_counts binary"
    schema = arrow_schema(ddl)

    def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[np.ndarray]:
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(at, n).astype(np.int64) for n in np.concatenate(counts, 1)])
        ends = np.cumsum([len(k) for k in keys])
        return (sums[:, at[end - len(k) : end]] for k, end in zip(keys, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pairs, words = [], ([], []), ([], [])
        for batch in batches:
            for r in batch.to_pylist():
                names.append((r["part"], r["task"], r["chunk"]))
                for (keys, counts), n, k, c, rows in ((pairs, r["n_pairs"], r["pairs"], r["pair_counts"], 2), (words, r["n_words"], r["words"], r["word_counts"], 4)):
                    keys.append(unpack(k, np.uint64, n))
                    counts.append(unpack(c, np.int64, rows, n))
        if names:
            for name, p, w in zip(names, totals(*pairs), totals(*words)):
                row = (*name, p.shape[1], pack(p), w.shape[1], pack(w))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return map_arrow(asked.repartitionById(parts, "part"), run, ddl)


def score(held: DataFrame, marked: DataFrame, answered: DataFrame, total: tuple[int, int], size: int = VOCABULARY, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document.

    Losses are means per word; without words all are 0. Each chunk meets its answers
    and its target documents' places by name.
    """
    ddl = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    schema = arrow_schema(ddl)

    def meet(chunk: pa.Table, got: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        row, pairs, words = chunk.to_pylist()[0], [np.zeros((2, 0), np.int64)], [np.zeros((4, 0), np.int64)]
        for r in sorted(got.drop_columns("places").to_pylist(), key=lambda r: r["part"]):
            if r["part"] >= 0:
                pairs.append(unpack(r["pair_counts"], np.int64, 2, r["n_pairs"]))
                words.append(unpack(r["word_counts"], np.int64, 4, r["n_asked"]))
        made = Chunk(row, _places(got))
        t, b = made.losses(np.concatenate(pairs, 1), np.concatenate(words, 1), total, size, prior)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip((row["doc_ids"], made.sizes, t, b, t - b), schema)], schema=schema)

    told = answered.unionByName(marked.select(F.lit(-1).alias("part"), "task", "chunk", "places"), allowMissingColumns=True)
    return dealt(held).cogroup(told.groupBy("task", "chunk")).applyInArrow(meet, ddl)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by models counted over all of them.

    Null texts have no words and score 0; null ids and repeated rows are scored like
    others; columns other than doc_id and text are left out, whatever their names.
    An empty table gives an empty table; without labels the target model knows no
    words. Chunks are written once and serve counting and scoring.
    """
    ship(docs.sparkSession)
    held = cut(chunks(docs))
    marked = cut(targets(held, labels))
    total = (marked.agg(F.sum("n_target")).first()[0] or 0, held.agg(F.sum("n_tokens")).first()[0] or 0)
    parts = max(shuffle_partitions(docs.sparkSession), -(-total[1] // PART))
    return score(held, marked, answers(requests(held, marked, parts), parts), total)


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
