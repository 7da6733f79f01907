import math
import re
from collections import Counter

import numpy as np
from cases import TEXTS, documents
from oracle import SMALL

from weirflow.llm import labelled
from weirflow.llm import quality_model as q


def plain_features(text):
    """The sixteen numbers by plain patterns over characters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * 16
    n, chars = len(words), sum(map(len, words))
    share = lambda pattern: len(re.findall(pattern, text))
    lines = text.split("\n")
    full = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    count = Counter(words)
    return [
        math.log1p(n), chars / n, share(r"[#*$%&|<>]") / n, share(r"[!?~^=_+{}\[\]\\/@`]") / chars, share("[A-Z]") / chars, share("[0-9]") / chars, len(count) / n,
        max(count.values()) / n, len(inside) / n, (len(full) - len(set(full))) / len(lines), n / len(lines), share("[.:;]") / chars, share(",") / n,
        len(text.encode()) / len(text), sum(a == b for a, b in zip(words, words[1:])) / n, sum(len(w.encode()) > 14 for w in count) / n,
    ]


def plain_score(model, x):
    """One entry at a time: the bin of a value is the number of cuts below it."""
    below = lambda cuts, v: sum(c < v for c in cuts)
    total = model.base + sum(t[below(c, v)] for t, c, v in zip(model.tables, model.cuts, x))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        total += t[below(model.pair_cuts[a], x[a])][below(model.pair_cuts[b], x[b])]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_query_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = q.fit(docs, labels)
    got = {r.doc_id: r for r in q.op8_quality_classifier(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and len(model.pairs) == 4
    import zlib

    for d in rows:
        r, want = got[d.doc_id], plain_score(model, plain_features(d.text))
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.predicted == (want >= 0.7) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)


def test_features_equal_plain_patterns():
    for _, text in TEXTS:
        if text is None or len(text) < 100_000:
            assert np.allclose(q.features(text), plain_features(text), rtol=1e-12), text


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = [(d, "good words here " * 5 + str(d)) for d in range(200)] + [(d, "$$ ## $$ " * 9) for d in range(0, 200, 2)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(200)], "doc_id long, quality int, toxic int")
    a = q.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    b = q.fit(spark.createDataFrame(rows[::-1] * 2, "doc_id long, text string").repartition(5), labels)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables + a.pair_tables, b.tables + b.pair_tables))


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = q.op8_quality_classifier(spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_are_never_looked_at(spark):
    ids = [d for d in range(400)]
    docs = spark.createDataFrame([(d, "good words here " * 5 if d % 2 else "$$ ## $$ " * 9) for d in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in ids], "doc_id long, quality int, toxic int")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    a, b = q.fit(docs, labels), q.fit(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))
    assert labelled.sample(docs, labels, 10).count() == 10


def test_tables_add_up_and_pairs_help():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    model = q.train(x, y, pairs=1)
    assert model.pairs == [(1, 0)]
    alone = q.train(x, y, pairs=0)
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert right(model) > 0.93 > 0.7 > right(alone)
    total = model.base + sum(t[np.searchsorted(c, x[:, k])] for k, (t, c) in enumerate(zip(model.tables, model.cuts)))
    (a, b), table = model.pairs[0], model.pair_tables[0]
    total = total + table[np.searchsorted(model.pair_cuts[a], x[:, a]), np.searchsorted(model.pair_cuts[b], x[:, b])]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))


def test_awkward_documents(spark):
    docs = documents(spark)
    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.fit(docs, empty_labels)
    rows = q.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and {r.score for r in rows} == {0.5}
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, one_class)
    scores = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    assert scores[3] == scores[4] and all(s > 0.5 for s in scores.values())
    kept = q.filter_documents(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert q.filter_documents(docs, model, 1.1).count() == 0
    assert q.score(documents(spark, []), model).count() == 0 and q.filter_documents(documents(spark, []), model).count() == 0
