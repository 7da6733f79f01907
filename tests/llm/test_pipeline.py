import pytest
from cases import COLUMNS, documents
from oracle import SMALL

import corpus_pipeline
from weirflow.llm import packing, pii, quality_model, quality_rules, simhash


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "pii", "best_fit_packing"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        out.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return out


def test_stages_equal_plain_code(spark, stages):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in source.collect()}
    by_id = lambda s: sorted(s, key=lambda r: r["doc_id"])

    rules = quality_rules.fit(source, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {r.doc_id for r in quality_rules.apply(source, rules).collect() if r.kept}
    assert by_id(stages[0]) == by_id(rows[d] for d in kept)

    first = spark.createDataFrame(stages[0], source.schema)
    model = quality_model.fit(first, spark.read.parquet(f"{SMALL}/labels.parquet"))
    import numpy as np

    passed = [r for r in stages[0] if model.score(np.array([quality_model.features(r["text"])]))[0] >= 0.7]
    assert by_id(stages[1]) == by_id(passed)

    fps = [simhash.fingerprint(r["text"]) for r in by_id(stages[1])]
    ids = [r["doc_id"] for r in by_id(stages[1])]
    root = list(range(len(ids)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    firsts = {ids[i] for i in range(len(ids)) if top(i) == i}
    assert by_id(stages[2]) == by_id(r for r in stages[1] if r["doc_id"] in firsts) and len(firsts) < len(ids)

    trained = pii.trained()
    clean = [{**r, "text": t, "n_chars": len(t)} for r in stages[2] for t in [pii.redact(r["text"], pii.find(r["text"], trained)[1])]]
    assert by_id(stages[3]) == by_id(clean) and any("[email]" in r["text"] for r in clean)

    assert {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]}
    pieces = packing.pieces(spark.createDataFrame(stages[3], source.schema)).collect()
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in keys) for r in stages[4]) == sorted(tuple(r[k] for k in keys) for r in pieces)


def test_run_gives_the_last_stage(spark, stages):
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = sorted(tuple(r[k] for k in keys) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == sorted(tuple(r[k] for k in keys) for r in stages[4])


def test_good_documents_stay(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    words = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1 and words[d] >= 20}
    left = {r["doc_id"] for r in stages[1]}
    assert len(good & left) >= 0.98 * len(good)
    assert len({d for d, q in labels.items() if q == 0} & left) <= 0.1 * sum(q == 0 for q in labels.values())


@pytest.mark.parametrize("rows", [None, []])
def test_every_stage_takes_awkward_tables(spark, rows):
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "best_fit_packing":
            assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        out.collect()
    dedup = corpus_pipeline.near_dedup_stage(spark, docs, SMALL)
    if rows is None:
        left = sorted((r.doc_id or 0, r.text or "") for r in dedup.collect())
        # 2 and its copy go with 1; the empty texts and the null one (without id too) go with 3
        assert [d for d, _ in left] == [0, 1, 3, 6, 7, 8, 9] and left[0][1] == "no id here at all"
        twice = documents(spark, [(None, None), (None, ""), (None, "a b c d e"), (None, "a b c d e")])
        assert sorted(len(r.text or "") for r in corpus_pipeline.near_dedup_stage(spark, twice, SMALL).collect()) in ([0, 9],)
        same_id = documents(spark, [(5, "a b c d e f"), (5, "q r s t u v w"), (5, "a b c d e f")])
        assert corpus_pipeline.near_dedup_stage(spark, same_id, SMALL).count() == 2
