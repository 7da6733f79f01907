"""Exact counts over whole texts that quality operators use.

Words are runs of ``[^\\x20\\x09-\\x0D]``; lines are split at ``\\n``.
"""

from __future__ import annotations

import numpy as np

#: Fixed by the query's contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # three doublings below
_BLANK = b" \t\n\r\x0b\f"
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
#: All bytes but those that count as code points of words: blanks and UTF-8 continuation bytes.
_NOT_CHARS = _BLANK + bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in some run of eight found twice or more in the text.

    Runs are compared by 64-bit mixes of word hashes; equal runs always have equal
    mixes. Where mixes meet, the runs are ranked exactly, so the count is exact.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    distinct: dict[bytes, int] = {}
    ids = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), np.int64, n)
    if len(distinct) == n:
        return 0
    mix = ids.astype(np.uint64) * _MIX[0] + np.uint64(1)
    mix ^= mix >> np.uint64(29)
    for step, odd in zip((1, 2, 4), _MIX):
        mix = mix[:-step] * odd + mix[step:]
        mix ^= mix >> np.uint64(31)
    if len(np.unique(mix)) == len(mix):
        return 0
    rank = ids
    for step in (1, 2, 4):  # exact: pairs of ranks are ranked again
        _, rank = np.unique(rank[:-step] * np.int64(n) + rank[step:], return_inverse=True)
    found = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    return (
        len(words),
        len(raw.translate(None, _NOT_CHARS)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )
