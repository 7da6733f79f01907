import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, clean_text, documents
from oracle import SMALL
from tokenizers import Tokenizer

from weirflow.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def holds(rows, texts, library, size=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for doc, text in texts:
        ids = ids_of(library, text)
        copies = sum(d == doc for d, _ in texts)
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        if copies == 1:
            assert [r.piece for r in parts] == list(range(len(parts)))
            for r in parts:
                own = ids[r.start : r.start + r.length]
                assert r.start == r.piece * size and r.length == len(own) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            assert sum(r.length for r in parts) == len(ids)
    return by_sequence


def test_query_packs_all_documents(spark, library):
    rows = packing.op9_best_fit_packing(spark, SMALL).collect()
    sequences = holds(rows, clean_text(spark, SMALL), library)
    assert len(sequences) <= sum(r.length for r in rows) / 2048 * 1.02 + 1


def test_most_sequences_come_from_fitted_patterns(spark):
    rows = packing.op9_best_fit_packing(spark, "/root/testdata/sf0.1").select("sequence_id", "from_pattern").distinct().collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and sum(r.from_pattern for r in rows) > 0.7 * len(rows)


def test_random_texts_equal_the_library(library):
    coder, r = bpe.word_bpe(PATH), random.Random(6)
    alphabet = ["a", "B", "the", " ", "\n", "'s", "'T", "1", "é", "É", "é", "你", "\U0001f600", "\x85", "\xa0", " ", "!", "...", "Σ", "İ", "²", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "</w>", "\x00", "ing"]
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    r = np.random.default_rng(seed)
    size = 64
    histogram = np.concatenate([[0], r.poisson(r.choice([0.3, 5, 400]), size)]) * (r.random(size + 1) < 0.7)
    runs = packing.plan(histogram)
    used = np.zeros(size + 1, np.int64)
    for run in runs:
        assert sum(a * b for a, b in run.parts) <= size
        for length, times in run.parts:
            used[length] += times * run.repeat
    assert np.array_equal(used, histogram)
    assert [run.first for run in runs] == list(np.cumsum([0, *(run.repeat for run in runs)])[:-1])
    need, total = (np.arange(size + 1) * histogram).sum() / size, sum(run.repeat for run in runs)
    if histogram.sum() > 2000:
        assert total <= max(np.ceil(need), histogram[size // 2 + 1 :].sum()) * 1.04 + 1
    places = packing.Places(runs, size)
    seen = set()
    for length in np.flatnonzero(histogram):
        s, o, _ = places.find(np.full(histogram[length], length), np.arange(histogram[length]))
        for a, b in zip(s.tolist(), o.tolist()):
            for k in range(int(length)):
                assert (a, b + k) not in seen
                seen.add((a, b + k))


def test_least_squares_meets_a_histogram_that_patterns_can_make():
    rows = np.array([(40, 24, 0), (30, 30, 4), (64, 0, 0)])
    histogram = np.zeros(65)
    for row, n in zip(rows, (7, 5, 3)):
        for length in row[row > 0]:
            histogram[length] += n
    assert np.allclose(packing.nnls(rows, histogram, 2000), (7, 5, 3), atol=0.2)


def test_awkward_documents(spark, library):
    rows = packing.pack(packing.pieces(documents(spark))).collect()
    holds(rows, [(d, t) for d, t in TEXTS if d is not None], library)
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 2 for r in rows) == 2
    assert packing.pack(packing.pieces(documents(spark, []))).count() == 0
    with_ids = packing.pieces(documents(spark), ids=True).where("doc_id = 8").first()
    assert bytes(with_ids.ids) == struct.pack("<3I", *ids_of(library, "a b"))


def test_special_tokens_are_read_as_the_library_reads_them(spark, library):
    texts = ["a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "A<|EndOfText|>", "é<|endoftext|>É ", "<|endoftext", "<<|endoftext|>>", "<|endoftext|>"]
    coder = bpe.word_bpe(PATH)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
    assert coder.encode("a <|endoftext|> b") == struct.pack("<3I", 320, 49407, 321)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert bpe.word_bpe(PATH, False).encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_equal_lengths_and_null_ids_are_spread(spark, monkeypatch):
    """No window group grows beyond a fixed size, whatever rows are alike."""
    from pyspark.sql import functions as F

    from weirflow.llm import common

    monkeypatch.setattr(common, "CELL_ROWS", 5000)
    n = 100_000
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"), F.monotonically_increasing_id().alias("_row"))
    found = common.ranked(same, "length", {1000: n}, ["doc_id"])
    assert found.select("rank").distinct().count() == n and found.agg(F.max("rank")).first()[0] == n - 1
    cells = same.groupBy(F.pmod(F.xxhash64("_row"), F.lit(20))).count().agg(F.max("count")).first()[0]
    assert cells < 1.1 * 5000
    packed = packing.pack(same.drop("_row").withColumn("piece", F.col("piece").cast("int")))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.max("offset").alias("o")).where("n != 2000 or k != 2 or o != 1000").count() == 0
    assert packed.count() == n
