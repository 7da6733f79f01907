import random
import re

import numpy as np
from cases import TEXTS, documents
from oracle import SMALL

from weirflow.llm import quality_rules as q
from weirflow.llm.text_stats import base_counts


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(seen) if seen.count(w) > 1 for k in range(8)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "&", "\x0b", "\x85", "cc "]) for _ in range(r.randint(0, 120)))
        raw = text.encode()
        assert base_counts(raw, raw.split()) == brute(text)
    text = "a b c d e f g h x a b c d e f g h y a b c d e f g h"
    assert base_counts(text.encode(), text.encode().split())[4] == brute(text)[4] == 24


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat = brute(text)
    some = lambda pattern: len(re.findall(pattern, text))
    w, c = max(n, 1), max(chars, 1)
    return {
        "words": n, "word_length": chars / w, "symbols_per_word": symbols / w, "marks_per_word": some(r"[!?~^=_+{}\[\]\\/@`]") / w, "upper_share": some("[A-Z]") / c,
        "digit_share": some("[0-9]") / c, "distinct_share": len(set(words)) / w, "repeat_share": repeat / w, "dup_line_share": dup / (text.count("\n") + 1),
    }


def test_query_over_all_documents(spark):
    got = {r.doc_id: r for r in q.op2_quality_rules(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = q.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    docs = docs.collect()
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], brute(d.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        x = plain_features(d.text or "")
        rejects = [k for k, rule in enumerate(rules, 1) if all((x[t.feature] > t.threshold) == t.above for t in rule)]
        assert r.rule == (rejects[0] if rejects else 0) and r.kept == (not r.base_failed and not rejects)


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    """Ids with several texts, one of them junk."""
    words = "some plain words that are good enough to pass the rules of a base with more than twenty of them in all of its lines here"
    rows = [(d, words + f" {d}") for d in range(200)] + [(d, "### $$$ " * 4 + words + f" {d}") for d in range(150)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(200)], "doc_id long, quality int, toxic int")
    one = q.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    two = q.fit(spark.createDataFrame(rows[::-1] * 2, "doc_id long, text string").repartition(7), labels)
    assert one == two


def test_columns_with_the_names_of_statistics(spark):
    docs = documents(spark).selectExpr("*", "1 as _stat_n_words", "2 as n_lines", "'r' as _row", "3 as rule")
    kept = q.filter_documents(docs, [])
    assert kept.columns == docs.columns and {(r.n_words, r._stat_n_words, r.n_lines, r._row, r.rule) for r in kept.collect()} == {(1, 1, 2, "r", 3)}


def test_learned_list_separates_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = q.op2_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2 and not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_covering_grows_and_prunes():
    r = np.random.default_rng(0)
    x = {"a": r.random(3000), "b": r.random(3000), "noise": r.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["a"] < 0.05)
    rules = q.learn(x, bad, r.random(3000) < 0.33)
    hit = np.zeros(3000, bool)
    for rule in rules:
        assert len(rule) <= 3
        hit |= np.logical_and.reduce([t.holds(x) for t in rule])
    assert (hit == bad).mean() > 0.97
    assert not any(t.feature == "noise" for rule in rules for t in rule)
    assert q.learn(x, np.zeros(3000, bool), r.random(3000) < 0.33) == []


def test_awkward_documents(spark):
    docs = documents(spark)
    rules = [(q.Test("symbols_per_word", True, 0.5),)]
    got = q.apply(docs, rules).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got if not (r.doc_id or 0) in (1, 2, 6, 7)) == [
        (0, 0, False), (0, 5, False), (3, 0, False), (4, 0, False), (5, 0, False), (8, 2, False), (9, 90, False)
    ]
    assert sorted(r.doc_id for r in got if r.kept) == [1, 2, 2]
    kept = q.filter_documents(docs, rules)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]
    empty = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.fit(empty, labels) == [] and q.apply(empty, []).count() == 0 and q.filter_documents(empty, []).count() == 0
    messy = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")
    assert q.fit(docs, messy) == []
