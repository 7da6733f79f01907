"""Quality rules: a learned decision list over text statistics.

Sequential covering on labelled statistics: each rule is grown as a conjunction of
thresholds by information gain, pruned on rows kept aside, and kept if it is
precise there; rows it covers leave the set and the next rule is grown. The list
becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import labelled
from weirflow.llm.common import map_arrow, map_batches, read
from weirflow.llm.text_stats import base_counts

#: Bound of the labelled sample the list is learned from.
SAMPLE_ROWS = 8000
#: Fixed by the query's contract.
MIN_WORDS, MAX_REPEATED = 20, 30

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, n_marks long, n_distinct_words long, n_lines long"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?~^=_+{}[]\\/@`"

#: Statistics that rules may test, from the counts above.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def statistics(docs: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the counts in ``STATS`` and ``base_failed``, for every whole text.

    A null text has no words and fails. Repeated rows are counted each. Columns
    other than doc_id, text and ``keep`` (names and types) are left out.
    """
    keep = keep or {}

    def make():
        def work(ids, texts, *rest):
            rows = [_counts((t or "").encode()) for t in texts.to_pylist()]
            return [ids, *map(list, zip(*rows)), *rest]

        return work

    ddl = ", ".join(["doc_id long", STATS, *(f"{c} {kind}" for c, kind in keep.items())])
    stats = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), ddl, make)
    return stats.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _counts(raw: bytes) -> tuple[int, ...]:
    words = raw.split()
    size = len(raw)
    return (
        *base_counts(raw, words),
        size - len(raw.translate(None, _UPPER)),
        size - len(raw.translate(None, _DIGITS)),
        size - len(raw.translate(None, _MARKS)),
        len(set(words)),
        raw.count(b"\n") + 1,
    )


def learn(x: dict[str, np.ndarray], bad: np.ndarray, aside: np.ndarray, max_rules: int = 12, max_tests: int = 3, precision: float = 0.9) -> list[Rule]:
    """Rules for rejecting, in order. ``aside`` marks the rows that rules are pruned and judged on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (left & bad & ~aside).sum() >= 3:
        rule = _prune(_grow(x, bad, left & ~aside, max_tests), x, bad, left & aside)
        if not rule:
            break
        covered = _covers(rule, x) & left
        hits, all_ = (covered & bad).sum(), covered.sum()
        judged = covered & aside
        if hits < 3 or hits < precision * all_ or (judged & bad).sum() < precision * judged.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _grow(x, bad, rows, max_tests) -> Rule:
    rule: list[Test] = []
    rows = rows.copy()
    while len(rule) < max_tests:
        p, n = (rows & bad).sum(), (rows & ~bad).sum()
        if p == 0 or n == 0:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for name, values in x.items():
            cuts = np.unique(values[rows])
            if len(cuts) > 64:
                cuts = np.unique(np.quantile(values[rows], np.linspace(0, 1, 65)))
            cuts = (cuts[:-1] + cuts[1:]) / 2
            if not len(cuts):
                continue
            place = np.searchsorted(cuts, values[rows])  # value > cuts[:place]
            hits = np.bincount(place[bad[rows]], minlength=len(cuts) + 1)
            miss = np.bincount(place[~bad[rows]], minlength=len(cuts) + 1)
            for above in (True, False):
                tp = hits[::-1].cumsum()[::-1][1:] if above else hits.cumsum()[:-1]
                fp = miss[::-1].cumsum()[::-1][1:] if above else miss.cumsum()[:-1]
                gains = np.where(tp > 0, tp * (np.log2(np.maximum(tp, 1) / np.maximum(tp + fp, 1)) - before), 0)
                k = int(gains.argmax())
                if gains[k] > gain:
                    gain, best = gains[k], Test(name, above, float(cuts[k]))
        if best is None:
            break
        rule.append(best)
        rows &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x, bad, rows) -> Rule:
    """Drop tests from the end while precision on the rows kept aside does not fall."""

    def worth(r: Rule) -> float:
        covered = _covers(r, x) & rows
        return ((covered & bad).sum() + 1) / (covered.sum() + 2)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn the list from at most ``rows`` labelled documents that the base rules pass.

    The list does not depend on the order of rows. Where no labelled document is
    left, or none is bad, it is empty.
    """
    stats = labelled.one_each(statistics(labelled.sample(docs, labels, rows), {"y": "int", "text_hash": "long"})).where("not base_failed")
    got = stats.select("doc_id", "y", *(F.expr(e).alias(n) for n, e in FEATURES.items())).toPandas().sort_values("doc_id")
    if got.empty:
        return []
    x = {n: got[n].to_numpy(float) for n in FEATURES}
    ids = got.doc_id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return learn(x, got.y.to_numpy() == 0, (ids >> np.uint64(40)) % np.uint64(3) == 0)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, 0 if none: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, ``rule`` (the first that rejects, 0 if none) and ``kept`` for every document; see ``statistics`` for nulls and repeats."""
    return statistics(docs).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names, in one pass without a join.

    Null, empty and blank texts have too few words and go; null ids and repeated
    rows are judged by their own text like any other.
    """
    names = [f.split()[0] for f in STATS.split(", ")]
    plain = docs.toDF(*(f"column {k}" for k in range(len(docs.columns))))  # no statistic has such a name
    schema = plain.select("*", *(F.lit(0).cast("long").alias(n) for n in names)).schema
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [_counts((t or "").encode()) for t in batch.column(at).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*batch.schema.names, *names])

    counted = map_arrow(plain, run, schema)
    return counted.where(~base_failed() & (verdict(rules) == 0)).drop(*names).toDF(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return apply(docs, fit(docs, read(spark, sf_dir, "labels")))
