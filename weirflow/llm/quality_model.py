"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: features take turns, and each turn fits a small tree on one
binned feature to the gradient and adds its steps, shrunk, to that feature's
lookup table. Then the pairs whose joint table lowers the loss most are boosted in
turn the same way. A document's score is a sum of table entries, taken for a whole
batch by vectorised additions.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import labelled
from weirflow.llm.common import map_arrow, map_batches, read
from weirflow.llm.text_stats import base_counts

#: Bound of the labelled sample the tables are fitted on.
SAMPLE_ROWS = 8000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "symbols", "marks", "upper", "digits", "distinct", "top_word", "repeats",
    "dup_lines", "line_words", "stops", "commas", "bytes_per_char", "adjacent", "long_words",
)
_SYMBOLS, _MARKS, _STOPS = b"#*$%&|<>", b"!?~^=_+{}[]\\/@`", b".;:"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text (null or empty: all zero)."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars, symbols, dup, repeated = base_counts(raw, words)
    share = lambda chars_: (len(raw) - len(raw.translate(None, chars_))) / chars
    counts = Counter(words)
    lines = raw.count(b"\n") + 1
    return [
        math.log1p(n), chars / n, symbols / n, share(_MARKS), share(_UPPER), share(_DIGITS),
        len(counts) / n, max(counts.values()) / n, repeated / n, dup / lines, n / lines, share(_STOPS),
        raw.count(b",") / n, len(raw) / max(len(text), 1), sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(len(w) > 14 for w in counts) / n,
    ]


@dataclass
class Additive:
    """Cuts and lookup tables; ``score`` gives probabilities."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k])]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a]), np.searchsorted(self.pair_cuts[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _steps(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree on one binned feature: at most ``leaves`` runs of bins, each with its Newton step."""
    ridge, runs = 1.0, [(0, len(g))]
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(runs) < leaves:
        best, where = 1e-9, None
        for a, b in runs:
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = worth(a, mid) + worth(mid, b) - worth(a, b)
                if gain.max() > best:
                    best, where = gain.max(), (a, b, int(mid[gain.argmax()]))
        if where is None:
            break
        a, b, m = where
        runs.remove((a, b))
        runs += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _steps2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on a pair of binned features: one cut of each."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def quarters(c):
        a, b, d, e = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return a, b - a, d - a, e - b - d + a

    if min(g.shape) < 2:
        return np.zeros_like(g)
    gain = sum(x**2 / (y + 1.0) for x, y in zip(quarters(G), quarters(H)))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    i, j = i + 1, j + 1
    for rows in (slice(0, i), slice(i, None)):
        for columns in (slice(0, j), slice(j, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + 1.0)
    return out


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 60, pairs: int = 4, rate: float = 0.15) -> Additive:
    """Fit the tables. With no rows, or one class only, the score is the (smoothed) share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [_quantiles(x[:, k], bins) for k in range(x.shape[1])]
    model = Additive(cuts, math.log(share / (1 - share)), [np.zeros(len(c) + 1) for c in cuts])
    if not len(y) or y.min() == y.max():
        return model
    total = np.full(len(y), model.base)
    spots = [np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)]

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, spot in enumerate(spots):
            g, h = slopes()
            n = len(cuts[k]) + 1
            step = rate * _steps(np.bincount(spot, g, n), np.bincount(spot, h, n))
            model.tables[k] += step
            total += step[spot]
    coarse = [_quantiles(x[:, k], pair_bins) for k in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, k]) for k, c in enumerate(coarse)]

    def grid(a, b, w):
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(at[a] * shape[1] + at[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {}
    for a in range(len(cuts)):
        for b in range(a):
            step = _steps2(ga := grid(a, b, g), ha := grid(a, b, h))
            gains[a, b] = float((ga * step - 0.5 * ha * step**2).sum())
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_cuts = coarse
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _steps2(grid(a, b, g), grid(a, b, h))
            table += step
            total += step[at[a], at[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most ``rows`` labelled documents; held-out rows give no label, and the order of rows does not matter."""
    names = ", ".join(f"{n} double" for n in FEATURES)

    def make():
        def work(ids, texts, text_hash, y):
            return [ids, text_hash, y, *map(list, zip(*[features(t) for t in texts.to_pylist()]))]

        return work

    found = map_batches(labelled.sample(docs, labels, rows), f"doc_id long, text_hash long, y int, {names}", make)
    got = labelled.one_each(found).toPandas().sort_values("doc_id")
    return train(got[list(FEATURES)].to_numpy(float), got.y.to_numpy(float))


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``score`` and ``predicted`` for every whole text; only the text is looked at.

    Null and empty texts are scored alike. Repeated rows are scored each. Other
    columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(ids, texts):
            p = shared.value.score(np.array([features(t) for t in texts.to_pylist()], float))
            return ids, p, (p >= threshold).astype(np.int32)

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double, predicted int", make)


def filter_documents(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at the threshold or above, with all their columns, whatever their names, in one pass without a join.

    Null and empty texts are scored alike, by what labelled texts without words tell
    about them; null ids and repeated rows are judged by their own text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                p = shared.value.score(np.array([features(t) for t in batch.column(at).to_pylist()], float))
                yield batch.filter(pa.array(p >= threshold))

    return map_arrow(docs, run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
