import random

import numpy as np
import pytest
import xxhash
from cases import TEXTS, documents
from oracle import SMALL
from pyspark.sql import functions as F

from weirflow.llm import simhash


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, budget=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d or 0), f"{fps[i]:016x}", least[top(i)] or 0) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted(((r.doc_id or 0), f"{r.fp % (1 << 64):016x}", r.component_id or 0) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, SMALL).collect())
    assert got == brute(rows)


def test_awkward_documents(spark):
    assert result(simhash.near_duplicates(documents(spark))) == brute(TEXTS)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_the_query_prunes_node_pairs_by_the_budget(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        seen = {name: spark.sparkContext.accumulator(0) for name in ("walked", "pruned", "leaves")}
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        got = simhash.near_duplicates(docs, seen=seen)
        assert result(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
        walked, pruned, leaves = (seen[name].value for name in ("walked", "pruned", "leaves"))
        assert walked > 1000 and pruned > 1000 and 0 < leaves < walked


def far(a, b, front, budget=4):
    differ = int(a) ^ int(b)
    return differ.bit_count() > budget or differ >> (64 - front)


@pytest.mark.parametrize("walked", [simhash.WALKED, 10])
@pytest.mark.parametrize("front", [0, 7])
@pytest.mark.parametrize("leaf", [1, 4])
def test_trie_join_equals_all_pairs(monkeypatch, leaf, front, walked):
    monkeypatch.setattr(simhash, "WALKED", walked)
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 300):
        centre = r.integers(0, 1 << 63, 5, dtype=np.uint64)
        fps = centre[r.integers(0, 5, n)] if n else np.zeros(0, np.uint64)
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
        fps = np.unique(fps)
        group = np.sort(r.integers(0, 3, len(fps)))
        order = np.lexsort((fps, group))
        fps, group = fps[order], group[order]
        parts = list(simhash.trie_links(fps, group, front, leaf=leaf))
        got = [(int(a), int(b)) for i, j in parts for a, b in zip(i, j)]
        pairs = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b]}
        assert len(got) == len(set(got)) and set(got) <= {(a, b) for a, b in pairs if not far(fps[a], fps[b], 0)}
        assert set(got) >= {(a, b) for a, b in pairs if not far(fps[a], fps[b], front)}


def test_links_that_come_bit_by_bit(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", -90)
    r = np.random.default_rng(2)
    parts = [(r.integers(0, 100, 7), r.integers(0, 100, 7)) for _ in range(9)]
    assert np.array_equal(simhash.joined(100, iter(parts)), simhash.roots(100, *(np.concatenate(c) for c in zip(*parts))))


def test_blocks_in_front():
    f = np.array([0x0123456789ABCDEF, (1 << 64) - 1, 1], np.uint64)
    plans = simhash.tries()
    assert len(plans) == 15 and min(bits for _, bits in plans) == 20
    for blocks, _ in plans:
        assert sum(w for _, w in blocks) == 64
        assert [int(x).bit_count() for x in simhash.turned(f, blocks)] == [int(x).bit_count() for x in f]


@pytest.mark.parametrize("chunk,node", [(20_000, 1024), (20_000, 4), (3, 50), (3, 1)])
def test_links_lose_nothing(spark, chunk, node):
    r = random.Random(9)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame(list(enumerate(signed)), "first long, fp long")
    stars = simhash.links(distinct, chunk=chunk, node=node).select(F.struct(F.col("a_first").alias("first")).alias("a"), F.struct(F.col("b_first").alias("first")).alias("b"))
    got = {r.node.first: r.root.first for r in simhash.components(stars).collect()}
    parent = list(range(len(fps)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: top(i) for i in range(len(fps))}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n + 1, n) for n in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{n: 0 for n in range(1, 61)}, 101: 100}
