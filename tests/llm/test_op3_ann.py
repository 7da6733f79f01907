import numpy as np
import pytest
from oracle import SMALL

from weirflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, list int, r int"


def brute(ids, x, k=10):
    out = {}
    for i in np.flatnonzero(np.array(ids) % 100 == 0):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], d[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0, 1, "v", 2, 3) for i, row in zip(ids, x)], SCHEMA)


def run(spark, df, **how):
    vectors = ann.usable(df)
    return found(ann.search(vectors, vectors.where("id % 100 = 0"), **how))


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows]))
    got = found(ann.op3_adaptive_scan(spark, folder))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        for v, score in near:
            exact = dict((j, d) for j, d in want[q])
            assert v not in exact or abs(exact[v] - score) < 1e-12


def test_all_lists_probed_is_exact_but_for_the_test(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 24)).astype(np.float32)
    ids = r.permutation(600)
    got, want = run(spark, frame(spark, ids, x), probes=10_000), brute(ids, x)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))


def plain_scan(queries, x, k, alpha=ann.ALPHA, limit=None, step=500):
    scan = ann.Scan(queries, x, ann.rotation(x.shape[1]).astype(np.float32), k, limit, alpha)
    for at in range(0, len(x), step):
        scan.look(np.arange(len(queries)), at, min(at + step, len(x)))
    out = [{} for _ in queries]
    for i, j, d in zip(*scan.result()):
        out[i][int(j)] = d
    return scan, out


@pytest.mark.parametrize("measured", [ann.MEASURED, 7])
def test_scan_keeps_nearest(monkeypatch, measured):
    monkeypatch.setattr(ann, "MEASURED", measured)
    monkeypatch.setattr(ann, "PAIRS", 1 << 12)
    r = np.random.default_rng(5)
    x, queries = r.standard_normal((3000, 64)).astype(np.float32), r.standard_normal((9, 64))
    exact = np.sqrt(((x[None].astype(float) - queries[:, None]) ** 2).sum(2))
    scan, sure = plain_scan(queries, x, 10, alpha=0.0)
    assert (scan.scanned == 3000).all()
    scan, tested = plain_scan(queries, x, 10)
    hits = 0
    for q in range(9):
        want = np.argsort(exact[q])[:10]
        assert set(want) <= set(sure[q]) and all(abs(exact[q][j] - d) < 1e-9 for j, d in tested[q].items())
        hits += len(set(want) & set(tested[q]))
    assert hits >= 85 and (scan.abandoned > 1800).all()
    limit = np.partition(exact, 9, axis=1)[:, 9]
    carried, found = plain_scan(queries, x, 10, limit=limit)
    assert carried.abandoned.sum() > scan.abandoned.sum()
    assert all(d <= limit[q] for q in range(9) for d in found[q].values())


def test_the_query_abandons_candidates(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        rows = ann.op3_adaptive_scan(spark, folder).select("query_id", "n_scanned", "n_abandoned").distinct().collect()
        assert len({r.query_id for r in rows}) == len(rows)
        assert all(0 < r.n_abandoned < r.n_scanned for r in rows)
        assert sum(r.n_abandoned for r in rows) > 0.2 * sum(r.n_scanned for r in rows)


def test_the_test_keeps_its_level():
    r = np.random.default_rng(4)
    for seen, dims in ((16, 64), (48, 64), (16, 17)):
        z = r.standard_normal((200_000, dims)) ** 2
        share = (z[:, :seen].sum(1) / z.sum(1) > ann.critical(seen, dims, 0.01)).mean()
        assert 0.008 < share < 0.012


def test_without_rotated_blocks_nothing_is_found():
    """The result comes from the scan: where partial distances are lost, so are neighbours."""
    r = np.random.default_rng(1)
    x = r.standard_normal((500, 32)).astype(np.float32)
    limit = np.full(5, 7.0)
    scan, good = plain_scan(x[:5].astype(float), x, 10, limit=limit)
    lost = ann.Scan(x[:5].astype(float), x, np.full((32, 32), np.nan, np.float32), 10, limit)
    lost.look(np.arange(5), 0, 500)
    assert all(good) and not len(lost.result()[0]) and (lost.abandoned == 500).all()


def test_doubles_are_not_rounded(spark):
    x = [[1.0, 2.0], [1.0 + 1e-12, 2.0], [1.0, 2.0 + 1e-9]]
    df = spark.createDataFrame([(100 * i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = ann.usable(df)
    got = found(ann.search(vectors, vectors))
    assert got[0] == [(100, abs(x[1][0] - 1.0)), (200, x[2][1] - 2.0)]


def test_ties_copies_and_unusable_vectors(spark):
    x = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 3
    ids = [*range(0, 3000, 100), 5, 6, 7]
    df = frame(spark, ids, x)
    bad = [(100_000, None), (100_100, [0.0, 0.0]), (100_200, [1.0, None]), (100_300, [float("nan"), 1.0]), (100_400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100_500, [1.0, 2.0, 3.0])]
    df = df.unionByName(spark.createDataFrame([(i, v, 0, 1, "v", 2, 3) for i, v in bad], SCHEMA)).unionByName(df.limit(3))
    got = run(spark, df)
    assert set(got) == set(range(0, 3000, 100))
    for q, near in got.items():
        assert near == [(i, 0.0) for i in [i for i in range(0, 1200, 100) if i != q][:10]]


def test_few_and_no_rows(spark):
    got = run(spark, frame(spark, [0, 1, 100], np.eye(3)[:, :2] + 0.5))
    assert {q: len(n) for q, n in got.items()} == {0: 2, 100: 2}
    assert run(spark, frame(spark, [], np.zeros((0, 2)))) == {}
    assert run(spark, frame(spark, [100], np.ones((1, 2)))) == {}


def test_blocks_of_lists_and_queries_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 8)).astype(np.float32)
    ids = np.arange(400) * 20
    whole = run(spark, frame(spark, ids, x), probes=99)
    monkeypatch.setattr(ann, "LIST_BLOCK", 7)
    monkeypatch.setattr(ann, "LEAST_BLOCK", 5)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    blocks = run(spark, frame(spark, ids, x), probes=99)
    assert {q: [v for v, _ in n] for q, n in brute(ids, x).items()} == {q: [v for v, _ in n] for q, n in blocks.items()} == {q: [v for v, _ in n] for q, n in whole.items()}


def test_probes_are_calibrated_for_vectors_without_clusters(spark):
    r = np.random.default_rng(11)
    x = r.standard_normal((3000, 32)).astype(np.float32)
    ids = np.arange(3000) * 10
    got, want = run(spark, frame(spark, ids, x), lists=60), brute(ids, x)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    assert hits >= 0.93 * sum(map(len, want.values()))
    few = run(spark, frame(spark, ids, x), lists=60, probes=3)
    assert sum(len({v for v, _ in few[q]} & {v for v, _ in near}) for q, near in want.items()) < hits


def test_lists_share_shards():
    held = {0: 5, 1: 4, 2: 30, 3: 2, 4: 3}
    out = ann.blocks_of_lists(held, 10)
    assert out[0] == out[1] == (0, 1) and out[2] == (1, 3) and out[3] == out[4] == (2, 1)


def test_smallest_table(spark):
    assert ann.op3_adaptive_scan(spark, SMALL).count() > 0
