"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of binary tries over their bits; pairs of trie nodes
are walked together, adding up differing bits, and given up once more differ than
the error budget allows. Of six blocks of bits at least two are untouched by four
differing bits, so the join is made of fifteen tries, each with another pair of
blocks in front: there the budget is nothing, below it is the whole, and no link is
missed. The topmost levels of each trie, as many as leave some hundred fingerprints
a node, are walked by the shuffle (a pair of nodes that differ there is given up
already), the others in the task that gets the node. Each task hands on a spanning
star per group of linked fingerprints rather than all pairs, and the stars are
joined into components by alternating large and small stars.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import arrow_schema, cut, map_arrow, map_batches, read, shuffle_partitions

#: Fixed by the query's contract.
SHINGLE, SEED, BUDGET = 4, 42, 4
#: Blocks of the fingerprint that are put in front of each trie.
FRONT = 2
#: Node pairs with at most so many fingerprint pairs are leaves: these are compared whole.
LEAF = 4
#: Fingerprints under a node that a task gets, about; levels above are walked by the shuffle.
NODE = 1024
#: Larger nodes are dealt out in pairs of chunks of about this size.
CHUNK = 20_000
#: Rows joined at once in a worker, node pairs walked at once, and links held before they are joined.
ROWS, WALKED, HELD = 100_000, 1 << 17, 1 << 20
_NONE = (1 << 63) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit majority vote over the hashes of word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(raw, SEED)]
    else:
        hashes = [digest(raw[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    h = np.array(hashes, np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash) of every whole text, fp as a signed long. Null and empty texts have fp 0."""

    def make():
        def work(ids, texts, hashes):
            fp = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
            return ids, fp.view(np.int64), hashes

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(rows, "doc_id long, fp long, text_hash long", make)


def trie_links(fps: np.ndarray, group: np.ndarray, front: int = 0, skip: int = 0, budget: int = BUDGET, leaf: int = LEAF, seen: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose fingerprints differ in at most ``budget`` bits, but in none of the first ``front``.

    ``fps`` (unsigned) are distinct and sorted within each group, and groups follow
    each other: each group is one trie, whose first ``skip`` levels have one node.
    Node pairs are walked level by level, at most ``WALKED`` at once, the deepest
    first. Leaves are compared whole, so a pair that differs in front may come too
    where it is a link. ``seen`` counts node pairs: walked, pruned and leaves.
    """
    n = len(fps)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n) if n else starts
    ones: dict[int, np.ndarray] = {}
    todo = [(63 - skip, np.stack([starts, ends, starts, ends, np.zeros_like(starts)]))]
    seen = Counter() if seen is None else seen
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > WALKED:
            todo.append((bit, pairs[:, WALKED:]))
            pairs = pairs[:, :WALKED]
        a0, a1, b0, b1, differ = pairs
        seen["walked"] += len(a0)
        small = (a1 - a0) * (b1 - b0) <= leaf if bit >= 0 else np.ones(len(a0), bool)
        if small.any():
            seen["leaves"] += int(small.sum())
            yield from _compare(fps, a0[small], a1[small], b0[small], b1[small], budget)
            a0, a1, b0, b1, differ = pairs[:, ~small]
        if not len(a0):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        count, allowed = ones[bit], 0 if 63 - bit < front else budget
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = a0 == b0
        children = []
        for x0, x1, y0, y1, d, only in (
            (a0, am, b0, bm, differ, None),
            (am, a1, bm, b1, differ, None),
            (a0, am, bm, b1, differ + 1, None),
            (am, a1, b0, bm, differ + 1, ~own),
        ):
            there = (x1 > x0) & (y1 > y0) & ((x0 != y0) | (x1 - x0 > 1))  # a fingerprint alone has no pairs
            if only is not None:
                there &= only
            good = there & (d <= allowed)
            seen["pruned"] += int(there.sum() - good.sum())
            children.append(np.stack([x0, x1, y0, y1, d])[:, good])
        todo.append((bit - 1, np.concatenate(children, axis=1)))


def _compare(fps, a0, a1, b0, b1, budget, most: int = 1 << 20):
    """Links among all pairs of the given node pairs, in slices of bounded size."""
    sizes = (a1 - a0) * (b1 - b0)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        count = sizes[at:to]
        which = np.repeat(np.arange(at, to), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = (b1 - b0)[which]
        i, j = a0[which] + inner // wide, b0[which] + inner % wide
        good = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        yield i[good], j[good]
        at = to


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` places over the given links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def joined(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``roots`` over links that come bit by bit: whenever many are held they are joined, and only stars are kept."""
    held, size = [], 0

    def join() -> np.ndarray:
        return roots(n, *(np.concatenate(c) for c in zip(*held))) if held else np.arange(n)

    for i, j in links:
        held.append((i, j))
        size += len(i)
        if size > HELD + n:
            root = join()
            far = np.flatnonzero(root != np.arange(n))
            held, size = [(far, root[far])], len(far)
    return join()


STAR = "a_first long, a_fp long, b_first long, b_fp long"


def tries(budget: int = BUDGET, front: int = FRONT) -> list[tuple[list[tuple[int, int]], int]]:
    """For each trie its blocks (lowest bit, width), those in front first, and how many bits are in front."""
    blocks = budget + front
    edges = [64 * k // blocks for k in range(blocks + 1)]
    spans = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(range(blocks), front):
        first = [spans[k] for k in chosen]
        out.append((first + [s for k, s in enumerate(spans) if k not in chosen], sum(w for _, w in first)))
    return out


def turned(fps: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in the given order, from the highest bit down."""
    out, at = np.zeros_like(fps), 64
    for lo, width in blocks:
        at -= width
        out |= ((fps >> np.uint64(lo)) & np.uint64((1 << width) - 1)) << np.uint64(at)
    return out


def links(distinct: DataFrame, budget: int = BUDGET, chunk: int = CHUNK, node: int = NODE, leaf: int = LEAF, seen: dict | None = None) -> DataFrame:
    """Stars (``STAR``) that join all fingerprints linked within some node.

    ``distinct`` has (first, fp), one row per fingerprint. ``seen`` may hold
    accumulators for what ``trie_links`` counts.
    """
    plan = tries(budget)
    shallow = min(bits for _, bits in plan)
    depth = min(shallow, max(0, math.ceil(math.log2(max(1, distinct.count()) / node))))
    keys = []
    for k, (blocks, _) in enumerate(plan):
        prefix, left = F.lit(k).cast("long"), depth
        for lo, width in blocks:
            take = min(left, width)
            if take:
                prefix = F.shiftleft(prefix, take).bitwiseOR(F.shiftrightunsigned("fp", lo + width - take).bitwiseAND(F.lit((1 << take) - 1)))
            left -= take
        keys.append(prefix)
    dealt = distinct.select("first", "fp", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = dealt.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "first", "fp")
    n = shuffle_partitions(distinct.sparkSession)
    sorted_ = dealt.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    schema = arrow_schema(STAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counted = np.zeros((5, 0), np.int64), Counter()

        def stars(rows):
            trie = rows[0] >> depth
            for k in np.unique(trie):
                yield _stars(rows[:, trie == k], *plan[k], depth, budget, leaf, counted, schema)

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            if held.shape[1] >= ROWS:
                last = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(0))
                if len(last):  # the last group may go on in the next batch
                    yield from stars(held[:, : last[-1] + 1])
                    held = held[:, last[-1] + 1 :]
        if held.shape[1]:
            yield from stars(held)
        for name, total in (seen or {}).items():
            total.add(counted[name])

    return map_arrow(sorted_, run, STAR)


def _stars(rows: np.ndarray, blocks, front: int, depth: int, budget: int, leaf: int, counted: Counter, schema: pa.Schema) -> pa.RecordBatch:
    group = np.concatenate([[0], np.cumsum((rows[:3, 1:] != rows[:3, :-1]).any(0))])
    fps = turned(np.ascontiguousarray(rows[4]).view(np.uint64), blocks)
    order = np.lexsort((fps, group))
    first, signed, fps, group = rows[3][order], rows[4][order], fps[order], group[order]
    root = joined(len(fps), trie_links(fps, group, front, depth, budget, leaf, counted))
    at = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (first[at], signed[at], first[root[at]], signed[root[at]])], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root: the smallest node reachable.

    Large stars and small stars in turn until nothing changes. Minima are cut before
    they are joined back, so that a root with very many nodes can be split.
    """

    def normal(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(normal(edges))
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        edges = cut(normal(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))))
        least = cut(edges.groupBy("a").agg(F.min("b").alias("low")))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(normal(small.unionByName(least.withColumnRenamed("low", "b"))))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, budget: int, shingle: int, **how) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) per document, and (fp, first, root_fp) per fingerprint.

    ``first`` is the smallest doc_id of the fingerprint's component and ``root_fp``
    names the component, also where no document of it has an id (``first`` is then
    the largest long).
    """
    known = cut(fingerprints(docs, shingle))
    distinct = cut(known.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NONE)).alias("first")))
    stars = links(distinct, budget, **how)
    node = lambda s: F.struct(F.col(f"{s}_first").alias("first"), F.col(f"{s}_fp").alias("fp"))
    named = components(stars.select(node("a").alias("a"), node("b").alias("b")))
    named = named.select(F.col("node.fp").alias("fp"), F.col("root.first").alias("root_first"), F.col("root.fp").alias("root_fp"))
    both = distinct.join(named, "fp", "left")
    return known, cut(both.select("fp", F.coalesce("root_first", "first").alias("first"), F.coalesce("root_fp", "fp").alias("root_fp")))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, **how) -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the smallest doc_id reachable over links.

    Rows with a null doc_id are linked too but name no component: where no document
    of one has an id it is null. Repeated rows share their fingerprint; null and
    empty texts have fingerprint 0 and are linked like others. An empty table gives
    an empty table. ``how`` goes to ``links``.
    """
    known, names = _grouped(docs, budget, shingle, **how)
    return known.join(names, "fp").select("doc_id", "fp", F.nullif("first", F.lit(_NONE)).alias("component_id"))


def keep_one(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, **how) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (ties: one text of it).

    Repeated rows leave one. A component without any doc_id leaves one row too.
    """
    known, names = _grouped(docs, budget, shingle, **how)
    own = (F.coalesce("doc_id", F.lit(_NONE)) == F.col("first")) & (F.col("fp") == F.col("root_fp"))
    chosen = known.join(names, "fp").where(own).groupBy("root_fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    # Plain keys without nulls, the same for the join and for dropping repeats, so that rows are shuffled and sorted once.
    key = lambda doc, text: [F.coalesce(doc, F.lit(0)).alias("_doc"), doc.isNull().alias("_null"), text.alias("_text")]
    chosen = cut(chosen.select(*key(F.col("row.doc_id"), F.col("row.text_hash"))))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    keys = ["_doc", "_null", "_text"]
    return rows.join(chosen.hint("merge"), keys).dropDuplicates(keys).select("_row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
