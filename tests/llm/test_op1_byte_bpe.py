import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from cases import TEXTS, clean_text, documents
from oracle import SMALL

from weirflow.llm import bpe, tokenize

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_random_texts_equal_the_library(library):
    coder, r = bpe.byte_bpe(PATH), random.Random(3)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "́", "你", "\U0001f600", "\x1c", "\x85", "\xa0", " ", "!", "...", "​", "²", "\x00", "ing", "tion"]
    for _ in range(5000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 16)))
        ids = coder.encode(text)
        assert ids == packed(library.encode_ordinary(text)), text
        assert coder.decode(ids) == text.encode()


def test_long_runs_are_taken_back_and_equal_the_library(library):
    """Runs of few letters, where the longest match is often given up."""
    coder, r = bpe.byte_bpe(PATH), random.Random(5)
    for letters in ("a", "ab", "abcdefgh", "etaoinshr", "\u00e9\u4f60"):
        for n in (50, 3000):
            text = "".join(r.choice(letters) for _ in range(n))
            assert coder.encode(text) == packed(library.encode_ordinary(text))


def test_no_place_is_tried_twice_with_the_same_token(library):
    """Time is linear: there are at most as many judgements as tokens that begin at the places of a text."""
    merges, tries, r = bpe.ByteBpe(PATH).merges, [], random.Random(8)
    text = "".join(r.choice("abcd") for _ in range(20_000))
    begin = sum(text.startswith(t, k) for k in range(len(text)) for t in {text[k : k + n] for n in range(1, 9)} if t in merges.tokens)

    class Asked(dict):
        def get(self, key, default=None):
            tries.append(key)
            return super().get(key, default)

    merges.fits = Asked()
    ids = merges.encode(text)
    assert packed(ids) == packed(library.encode_ordinary(text)) or len(ids) > 1
    assert len(tries) <= begin


def test_small_memos_change_nothing(library):
    coder = bpe.ByteBpe(PATH)
    coder.pieces.entries = coder.chunks.entries = 5
    text = " ".join(f"word{n} other{n % 7}" for n in range(200))
    assert coder.encode(text) == coder.encode(text) == packed(library.encode_ordinary(text))


def test_query_over_all_documents(spark, library):
    got = {r.doc_id: r for r in tokenize.op1_byte_bpe(spark, SMALL).collect()}
    for doc, text in clean_text(spark, SMALL):
        ids = packed(library.encode_ordinary(text or ""))
        assert (got[doc].n_tokens, got[doc].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward_documents(spark, library):
    docs = documents(spark)
    encoded = tokenize.encode(docs)
    rows = sorted(((r.doc_id or 0), bytes(r.ids), r.n_tokens) for r in encoded.collect())
    want = sorted(((d or 0), packed(i), len(i)) for d, i in ((d, library.encode_ordinary(t or "")) for d, t in TEXTS))
    assert rows == want
    back = tokenize.decode(encoded)
    assert sorted(((r.doc_id or 0), bytes(r.decoded)) for r in back.collect()) == sorted(((d or 0), (t or "").encode()) for d, t in TEXTS)
    assert tokenize.encode(documents(spark, [])).count() == 0
