import math
import re
from collections import Counter

from cases import TEXTS, documents
from oracle import SMALL

from weirflow.llm import lm_score as lm


def words(text):
    return [re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def brute(docs, good):
    """Scores from plain counters over (doc_id, text), a target document's own counts left out of the target's."""
    size = lm.VOCABULARY
    pairs = lambda t: list(zip([None, *(x := words(t))], x))

    def counts(rows):
        two = Counter(p for t in rows for p in pairs(t))
        one, before = Counter(), Counter()
        for (a, b), n in two.items():
            one[b] += n
            before[a] += n
        return two, one, before, sum(one.values())

    models = counts([t for d, t in docs if d in good]), counts([t for _, t in docs])
    out = []
    for d, t in docs:
        losses, own = [], counts([t])
        for model, seen in zip(models, (d in good, False)):
            two, one, before, total = ((lambda x, y=y, z=z: y[x] - seen * z[x]) if isinstance(y, Counter) else y - seen * z for y, z in zip(model, own))
            each = [-math.log((two((a, b)) + lm.PRIOR * (one(b) + 1) / (total + size)) / (before(a) + lm.PRIOR)) for a, b in pairs(t)]
            losses.append(sum(each) / len(each) if each else 0.0)
        out.append((d, len(words(t)), *losses))
    return out


def run(docs, labels):
    return lm.cross_entropy_difference(docs, labels).collect()


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], abs_tol=1e-5) and math.isclose(g[3], w[3], abs_tol=1e-5) and math.isclose(g[4], g[2] - g[3], abs_tol=1e-12)


def test_query_equals_brute_force(spark):
    import zlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    same(lm.op10_cross_entropy_difference(spark, SMALL).collect(), brute(docs, good))


def test_score_separates_held_out_junk(spark):
    folder = "/root/testdata/sf0.01"
    rows = lm.op10_cross_entropy_difference(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g < b for g in good for b in bad) > 0.9 * len(good) * len(bad)


def test_awkward_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    import zlib

    good = {d for d in (1, 7) if zlib.crc32(str(d).encode()) % 4 != 2}
    same(run(documents(spark), labels), brute(TEXTS, good))
    assert run(documents(spark, []), labels) == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same(run(documents(spark), none), brute(TEXTS, set()))


def test_words_beyond_any_fixed_vocabulary_count(spark):
    """Two equal documents of 3,000 words are told apart from one whose words occur nowhere else."""
    rows = [(1, " ".join(f"common{k}" for k in range(3000))), (2, " ".join(f"common{k}" for k in range(3000))), (3, " ".join(f"alone{k}" for k in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = lm.cross_entropy_difference(docs, none).collect()
    loss = {r.doc_id: r.background_loss for r in got}
    assert loss[1] == loss[2] < loss[3] - 0.1
    same(got, brute(rows, set()))


def test_chunks_and_parts_do_not_matter(spark, monkeypatch):
    labels = spark.createDataFrame([(d, 1, 0) for d in range(9)], "doc_id long, quality int, toxic int")
    import zlib

    good = {d for d in range(9) if zlib.crc32(str(d).encode()) % 4 != 2}
    monkeypatch.setattr(lm, "CHUNK", 20)
    monkeypatch.setattr(lm, "PART", 500)
    same(run(documents(spark), labels), brute(TEXTS, good))


def test_no_document_is_scored_by_a_target_model_of_itself(spark):
    """A good document that shares no word with others is as strange to the target as one that is not good."""
    import zlib

    good = [d for d in range(99) if zlib.crc32(str(d).encode()) % 4 != 2][:3]
    rows = [(good[0], "p q r s t u " * 9), (good[1], "a b c d e f " * 9), (good[2], "a b c d e f g " * 9), (100, "v w x y z o " * 9), (None, "a b c"), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(g, 1) for g in good] + [(None, 1)], "doc_id long, quality int")
    got = lm.cross_entropy_difference(docs, labels).collect()
    same(got, brute(rows, set(good)))
    scores = {r.doc_id: r.target_loss for r in got}
    assert abs(scores[good[0]] - scores[100]) < 0.1 and scores[good[1]] < scores[100] - 5


def test_chunks_are_dealt_once(spark):
    """Asking and scoring share one shuffle of the chunks."""
    df = lm.op10_cross_entropy_difference(spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
