"""Byte-pair encoding in linear time by backtracking over longest matches.

A piece of text is a string of symbols. An Aho-Corasick automaton's trie over the
vocabulary gives the longest token that begins at a place, and a table the next
shorter one that begins alike. A token may follow another only if the merge rules would not
have joined symbols across their border, which is decided by unwinding both tokens'
own merges and is memoised per pair. Encoding goes forward by the longest match; one
that does not fit what precedes it is given up for the next shorter, and where none
fits the last token is taken back and shortened. Tokens with compatible neighbours
throughout are the only such sequence for the symbols they cover, and are what the
merges give; so a place that was once taken back is never tried again, and the time
is linear.

The symbols are bytes as Latin-1 characters. A vocabulary with word ends, which is
packed rather than studied here, is left to its library's model.
"""

from __future__ import annotations

import base64
import functools
import json
import struct

import ahocorasick
import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Entries that a worker keeps in a memo before it drops the older half.
MEMO_ENTRIES = 300_000
#: Longest piece that is kept in a memo.
MEMO_CHARS = 64
#: Plain runs: letters of Latin-1, then marks of ASCII but the apostrophe. Patterns cut them between the two.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"


class Memo(dict):
    """Dictionary filled by a function on misses, of bounded size (two generations)."""

    def __init__(self, make, entries: int = MEMO_ENTRIES, longest: int = MEMO_CHARS):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """Exact BPE encoder for one vocabulary.

    ``tokens`` maps each token's symbols to its id; ids grow in merge order. The two
    parts that a token is merged from are found from the vocabulary, in that order.
    """

    def __init__(self, tokens: dict[str, int]):
        size = 1 + max(tokens.values())
        self.length = [0] * size
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        usable = {}
        for symbols, i in sorted(tokens.items(), key=lambda x: x[1]):
            self.length[i] = len(symbols)
            if len(symbols) > 1:
                for cut in range(len(symbols) - 1, 0, -1):
                    left, right = tokens.get(symbols[:cut], i), tokens.get(symbols[cut:], i)
                    if left < i and right < i and self._compatible(left, right):
                        break
                else:
                    self.parts[i] = (i, i)
                    continue  # the merges never give this token
                self.parts[i] = left, right
                self.merged[left, right] = i
            else:
                self.parts[i] = (i, i)
            usable[symbols] = i
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for symbols, i in usable.items():
            self.automaton.add_word(symbols, i)
        self.automaton.make_automaton()
        self.tokens, self.longest = usable, max(map(len, usable))
        self.shorter = [-1] * size  # the longest token that a token begins with
        for symbols, i in usable.items():
            self.shorter[i] = next((usable[symbols[:k]] for k in range(len(symbols) - 1, 0, -1) if symbols[:k] in usable), -1)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two tokens alone."""
        merged, parts = self.merged, self.parts
        limit = 1 << 62
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            # Undo whichever token was merged later; its merge bounds what may have happened before.
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def _judge(self, key: int) -> bool:
        if len(self.fits) > 4 * MEMO_ENTRIES:
            self.fits.clear()
        good = self.fits[key] = self._compatible(key >> 24, key & 0xFFFFFF)
        return good

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one piece, by the longest match that fits and backtracking."""
        length, shorter, tokens = self.length, self.shorter, self.tokens
        memo, judge, deepest, longest = self.fits.get, self._judge, self.automaton.longest_prefix, self.longest
        n, at, before = len(symbols), 0, -1
        out: list[int] = []
        given_up: set[int] = set()
        while at < n:
            rest = symbols[at : at + longest]
            k = deepest(rest)
            token = tokens.get(rest[:k])
            while token is None:  # the trie goes on below the last token on its path
                k -= 1
                token = tokens.get(rest[:k])
            while True:
                if token < 0:  # nothing fits: take the last token back and shorten it
                    given_up.add(at)
                    token = out.pop()
                    at -= length[token]
                    before = out[-1] << 24 if out else -1
                elif at + length[token] not in given_up:
                    if before < 0:
                        break
                    good = memo(before | token)
                    if good is None:
                        good = judge(before | token)
                    if good:
                        break
                token = shorter[token]
            out.append(token)
            at += length[token]
            before = token << 24
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Byte-level BPE from a rank file: text to ids and back."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes = {v: k for k, v in ranks.items()}
        self.merges = Merges(self.ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = Memo(self._piece, MEMO_ENTRIES // 3)
        self.chunks = Memo(self._chunk, 2 * MEMO_ENTRIES)
        self.lone = regex.compile(r" (?=\s|\Z)|[\x1c-\x1f]").search
        self.plain = regex.compile(f"( ?[{_LETTERS}]+)([{_MARKS}]*)").fullmatch
        self.own = pattern == public_tokenizers.PATTERN

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1")
        whole = self.ranks.get(symbols)
        return _packed(self.merges.encode(symbols) if whole is None else [whole])

    def _chunk(self, chunk: str) -> bytes:
        plain = self.plain(chunk)
        if plain:
            word, marks = plain.groups()
            return self.chunks[word] + self.pieces[marks] if marks else self._piece(word)
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where every space stands between other characters, no match of the pattern
        reaches across one from the left, so the text is cut there first.
        """
        if self.own and not self.lone(text):
            first, *rest = text.split(" ")
            return self.chunks[first] + b"".join([self.chunks[" " + x] for x in rest]) if rest else self.chunks[first]
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-ins for bytes in vocabulary files: itself if printable, else moved above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class WordBpe:
    """BPE with word ends, lower case and dropped white space: text to ids, as the library gives them.

    White space never lies inside a token, so each run of other characters is
    encoded by itself and memoised: plain ones are cut into pieces here and go to the
    library's model; runs outside plain Latin letters, where normalisation may depend
    on more, go through the whole library. The strings of special tokens are found
    first, before anything is normalised; if not ``special``, they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in added if special}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.tokens, self.stand_ins = self.library.model.tokenize, _byte_characters()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(f"([{_LETTERS}]+)([{_MARKS}]*)").fullmatch
        self.odd = regex.compile(r"[^\x09-\x0d\x20-\x7e\xa1-ɏ]").search
        self.pieces = Memo(self._piece, MEMO_ENTRIES // 3)
        self.chunks = Memo(self._chunk, 2 * MEMO_ENTRIES)

    def _piece(self, piece: str) -> bytes:
        return _packed([t.id for t in self.tokens(piece.encode().decode("latin-1").translate(self.stand_ins))])

    def _chunk(self, chunk: str) -> bytes:
        plain = self.plain(chunk)
        if plain:
            word, marks = plain.groups()
            return self.chunks[word] + self.pieces[marks] if marks else self._piece(word.lower())
        if self.odd(chunk):
            return _packed(self.library.encode(chunk, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self.split(chunk.lower())))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials and "<|" in text:
            parts = self.specials.split(text)  # every second one is a special token
            return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=4)
def word_bpe(path: str, special: bool = True) -> WordBpe:
    return WordBpe(path, special)
