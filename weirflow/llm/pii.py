"""Personal data: rules, and a semi-Markov conditional random field beside them.

The rules' spans always stand. The random field segments the neighbourhood of
digits and at-signs: a segment is either one token outside or a whole candidate
span of one kind, scored by features of the whole span (digit count and grouping,
checksum, parts, borders, the word before), and a dynamic program over bounded
segments chooses borders and kinds together. It is trained by maximum likelihood
on generated sentences with known spans (a fixed number, made from a seed), with
forms that the rules miss and look-alikes that are not personal data.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import map_arrow, map_batches, read

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the query's contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Longest candidate, in tokens and characters, and most tokens that are segmented at once.
MAX_TOKENS, MAX_CHARS, PIECE = 24, 48, 4096
#: Generated sentences that the model is trained on, and passes over them.
SENTENCES, PASSES, SEED = 600, 8, 11
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")
_CHUNK = re.compile(r"\S+")
#: What stands for an at-sign and for a dot in addresses.
_SIGN = re.compile(r"\s?[\[(]at[\])]\s?|\s?@\s?")
_DOT = re.compile(r"\.|\s?[\[(](?:dot|\.)[\])]\s?")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by kind, then start; leftmost, not overlapping within a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        else:
            done = max(done, at)  # nothing that starts before this sign can match
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def windows(text: str, reach: int = 4) -> Iterator[tuple[int, int]]:
    """Stretches of text within ``reach`` words of an anchor; only they can hold candidates."""
    if not _ANCHOR.search(text):
        return
    recent: deque[tuple[int, int]] = deque(maxlen=reach + 1)
    start = end = last = None  # the stretch so far, and the number of its last word
    for number, m in enumerate(_CHUNK.finditer(text)):
        a, b = m.span()
        recent.append((number, a))
        if _ANCHOR.search(text, a, b):
            first, at = recent[0]
            if start is not None and first > last + 1:
                yield start, end
                start = None
            if start is None:
                start = at
            end, last = b, number + reach
        elif start is not None and number <= last:
            end = b
    if start is not None:
        yield start, end


def candidates(text: str, tokens: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first token, last token + 1) of spans that could be personal data: bounded, with free borders and an at-sign or enough digits."""
    out = []
    free = [not any(a < e and s < b for s, e in taken) for a, b in tokens]
    for i, (a, _) in enumerate(tokens):
        c = text[a]
        if not (c.isalnum() or c in "+(") or a and text[a - 1].isalnum():
            continue
        digits, sign = 0, False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            s, e = tokens[j]
            if not free[j] or e - a > MAX_CHARS or text[s] in "\r\n":
                break
            if "0" <= text[s] <= "9":
                digits += e - s
            sign |= text[s] == "@" or text[s:e] == "at"
            if digits > 19 and not sign:
                break
            if not text[e - 1].isalnum() or e < len(text) and text[e].isalnum():
                continue
            if sign or digits >= 7 or digits >= 4 and text.count(".", a, e) == 3:
                out.append((i, j + 1))
    return out


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span: digits and their grouping, marks, checksum, the parts of a number or of an address, and what stands around it."""
    span = text[start:end]
    digits = _digits(span)
    runs = [len(x) for x in re.findall(r"[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span))))
    before = re.findall(r"\w+", text[max(0, start - 24) : start])
    out = [
        "one",
        f"n{len(digits)}",
        f"runs{'-'.join(map(str, runs[:6]))}",
        f"marks{marks[:8]}",
        f"letters{min(letters, 3)}",
        f"first{span[0] if not span[0].isalnum() else 'd' if span[0].isdigit() else 'a'}",
        f"before{_class(text[start - 1 : start])}",
        f"after{_class(text[end : end + 1])}{_class(text[end + 1 : end + 2])}",
        f"word{before[-1].lower()[:12] if before and not before[-1].isdigit() else ''}",
    ]
    if not letters:
        out.append(f"shape{'-'.join(map(str, runs[:6]))}{marks[:4]}")
    if len(digits) >= 13:
        good = luhn(digits)
        out += [f"luhn{good}", f"luhn{good}{16 <= len(digits) <= 19}{not letters}"]
    if len(set(runs)) == 1 and runs[0] == 4:
        out.append(f"fours{len(runs)}")
    parts = re.split(r"[.]|\s*\[\.\]\s*|\s?\(dot\)\s?", span)
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append(f"parts{all(len(p) < 4 and int(p) < 256 for p in parts)}")
    signs = _SIGN.findall(span)
    out.append(f"signs{min(len(signs), 2)}")
    if len(signs) == 1:
        local, domain = _SIGN.split(span)
        names = _DOT.split(domain)
        kinds = ["".join(sorted({"a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else "." if c in "._%+-" else "x" for c in x})) for x in (local, domain.replace(".", ""))]
        out += [f"sign{signs[0].strip()}", f"sign{signs[0]}names{min(len(names), 4)}", f"local{kinds[0]}", f"domain{' ' in kinds[1]}{'x' in kinds[1]}", f"tail{min(len(names[-1]), 5)}{names[-1].isalpha()}", f"names{min(len(names), 4)}{all(names)}"]
    return out


def _class(c: str) -> str:
    return "end" if not c else "space" if c.isspace() else "word" if c.isalnum() else c if c in ".,;:)(/=\"'-" else "mark"


@dataclass
class Model:
    """``weights[feature]`` has one number per kind; ``moves[a, b]`` scores kind b (0: outside) after a."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[Span]:
        """Best segmentation of each window; spans never overlap ``taken`` or each other.

        Very long windows are segmented ``PIECE`` tokens at a time; what is decided
        near a piece's end is decided again with what follows it, so memory is bounded
        and no span is cut.
        """
        out: list[Span] = []
        merged: list[list[int]] = []
        for s, e in sorted(taken):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        ends = [e for _, e in merged]
        for a, b in windows(text):
            state = 0
            while a < b:
                tokens = [m.span() for m in islice(_TOKEN.finditer(text, a, b), PIECE)]
                stop = tokens[-1][1]
                here = []
                for k in range(bisect.bisect_right(ends, a), len(merged)):
                    if merged[k][0] >= stop:
                        break
                    here.append(merged[k])
                found = candidates(text, tokens, here)
                scores = np.array([self.score(features(text, tokens[i][0], tokens[j - 1][1])) for i, j in found]).reshape(-1, len(KINDS))
                path = best(len(tokens), found, scores, self.moves, state) if found else []
                keep = len(tokens)
                if stop < b:
                    keep -= MAX_TOKENS
                    keep = min([keep, *(i for i, j, _ in path if j > keep)])
                path = [p for p in path if p[1] <= keep]
                out += [(KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k in path]
                state = path[-1][2] + 1 if path and path[-1][1] == keep else 0
                a = tokens[keep - 1][1]
        return out

    def score(self, names: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for name in names:
            w = self.weights.get(name)
            if w is not None:
                total += w
        return total


def best(n: int, found: list[tuple[int, int]], scores: np.ndarray, moves: np.ndarray, state: int = 0) -> list[tuple[int, int, int]]:
    """Segmentation of ``n`` tokens after ``state`` with the highest score: (first, last + 1, kind) of its entities."""
    states = len(KINDS) + 1
    value = np.full((n + 1, states), -np.inf)
    value[0, state] = 0
    back = np.zeros((n + 1, states, 3), np.int32)  # token, state and candidate before; -1: outside
    ending: dict[int, list[int]] = {}
    for c, (_, j) in enumerate(found):
        ending.setdefault(j, []).append(c)
    for t in range(1, n + 1):
        into = value[t - 1] + moves[:, 0]
        k = int(into.argmax())
        value[t, 0], back[t, 0] = into[k], (t - 1, k, -1)
        for c in ending.get(t, ()):
            i = found[c][0]
            into = value[i][:, None] + moves[:, 1:] + scores[c]
            for kind in range(len(KINDS)):
                k = int(into[:, kind].argmax())
                if into[k, kind] > value[t, kind + 1]:
                    value[t, kind + 1], back[t, kind + 1] = into[k, kind], (i, k, c)
    t, state, out = n, int(value[n].argmax()), []
    while t:
        i, k, c = back[t, state].tolist()
        if c >= 0:
            out.append((i, t, state - 1))
        t, state = i, k
    return out[::-1]


def expectations(n: int, found: list[tuple[int, int]], scores: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the partition sum, probability of each (candidate, kind), and expected moves."""
    states = len(KINDS) + 1
    ahead, behind = np.full((n + 1, states), -np.inf), np.full((n + 1, states), -np.inf)
    ahead[0, 0] = 0
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for c, (i, j) in enumerate(found):
        ending.setdefault(j, []).append(c)
        starting.setdefault(i, []).append(c)
    for t in range(1, n + 1):
        ahead[t, 0] = np.logaddexp.reduce(ahead[t - 1] + moves[:, 0])
        for c in ending.get(t, ()):
            into = np.logaddexp.reduce(ahead[found[c][0]][:, None] + moves[:, 1:], axis=0) + scores[c]
            ahead[t, 1:] = np.logaddexp(ahead[t, 1:], into)
    behind[n] = 0
    for t in range(n - 1, -1, -1):
        total = moves[:, 0] + behind[t + 1, 0]
        for c in starting.get(t, ()):
            on = moves[:, 1:] + scores[c] + behind[found[c][1], 1:]
            total = np.logaddexp(total, np.logaddexp.reduce(on, axis=1))
        behind[t] = total
    whole = np.logaddexp.reduce(ahead[n])
    moved = np.zeros_like(moves)
    for t in range(n):
        moved[:, 0] += np.exp(ahead[t] + moves[:, 0] + behind[t + 1, 0] - whole)
    marginal = np.zeros((len(found), len(KINDS)))
    for c, (i, j) in enumerate(found):
        p = np.exp(ahead[i][:, None] + moves[:, 1:] + scores[c] + behind[j, 1:] - whole)
        moved[:, 1:] += p
        marginal[c] = p.sum(0)
    return float(whole), marginal, moved


def sentences(count: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Generated text with known spans. Look-alikes (dates, versions, keys, orders, prices) carry none."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def card(sep: str) -> str:
        body = r.choice("3456") + num(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def mail() -> str:
        sign = r.choice(["@", " @ ", " (at) ", "(at)", " [at] ", "[at]"])
        dot = r.choice([".", ".", ".", " [dot] ", "[.]", " (dot) "]) if sign != "@" else "."
        return name() + r.choice(["", "." + name(), num(2)]) + sign + name() + dot + r.choice(["com", "org", "net", "de", "info"])

    def phone() -> str:
        area, mid, end = str(r.randint(201, 989)), num(3), num(4)
        forms = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1-{}-{}-{}", "001 {} {} {}", "+1 ({}) {}-{}", "+44 {} {} {}"]
        return r.choice(forms).format(area, mid, end)

    def ip() -> str:
        dot = r.choice([".", ".", "[.]"])
        return dot.join(str(r.randint(0, 255)) for _ in range(4))

    def unlike(n: int, sep: str = "") -> str:
        """A number of a card's length whose checksum is wrong."""
        body = num(n)
        while luhn(body):
            body = num(n)
        return sep.join(body[k : k + 4] for k in range(0, n, 4)) if sep else body

    fakes = [
        lambda: unlike(16), lambda: unlike(r.randint(16, 19)), lambda: unlike(16, r.choice([" ", "-", "."])), lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"',
        lambda: f"20{num(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{num(2)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}",
        lambda: num(r.randint(7, 15)), lambda: num(16)[:15] + "x", lambda: "AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(16)),
        lambda: "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{num(3)}.{num(3)},{num(2)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: "@" + name(), lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"no. {num(8)}", lambda: "at " + name(), lambda: f"{num(4)} {num(4)} {num(4)}",
        lambda: f"{name()} at {name()}.{name()}", lambda: f"{num(3)} {num(3)} {num(4)}", lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(3)}", lambda: f"CC BY-NC {num(1)}.{num(1)}.",
    ]
    makers = {"email": mail, "ip": ip, "card": lambda: card(r.choice([" ", "-", "", ".", "/"])), "phone": phone}
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(name() for _ in range(r.randint(2, 5))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += r.choice(fakes)()
            text += r.choice([" ", ". ", ", ", " ", "!! ", "### ", "; "])
        out.append((text + name(), spans))
    return out


def train(examples: list[tuple[str, list[Span]]], passes: int = PASSES, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by adaptive gradient steps, one window at a time.

    Windows whose gradient is small already are visited in every fourth pass only.
    """
    index: dict[str, int] = {}
    cases = []
    for text, spans in examples:
        gold = {(s, e): KINDS.index(k) for k, s, e in spans}
        for a, b in windows(text):
            tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
            found = candidates(text, tokens, [])
            if found:
                rows = [[index.setdefault(f, len(index)) for f in features(text, tokens[i][0], tokens[j - 1][1])] for i, j in found]
                truth = [(c, gold[key]) for c, (i, j) in enumerate(found) if (key := (tokens[i][0], tokens[j - 1][1])) in gold]
                cases.append([len(tokens), found, rows, truth, 1.0])
    weights, moves = np.zeros((len(index), len(KINDS))), np.zeros((len(KINDS) + 1,) * 2)
    moves[1:, 1:] = -2.0
    square, square_moves = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    order = random.Random(SEED)
    for number in range(passes):
        order.shuffle(cases)
        for case in cases:
            n, found, rows, truth, off = case
            if off < 0.02 and number % 4:
                continue
            scores = np.array([weights[r].sum(0) for r in rows])
            _, marginal, moved = expectations(n, found, scores, moves)
            gap = -marginal
            true_moves = np.zeros_like(moves)
            state = at = 0
            for c, kind in truth:
                gap[c, kind] += 1
                i, j = found[c]
                for _ in range(i - at):
                    true_moves[state, 0] += 1
                    state = 0
                true_moves[state, kind + 1] += 1
                state, at = kind + 1, j
            for _ in range(n - at):
                true_moves[state, 0] += 1
                state = 0
            case[4] = float(np.abs(gap).max())
            for r, g in zip(rows, gap):
                if np.abs(g).max() > 1e-4:
                    step = g - ridge * weights[r]
                    square[r] += step**2
                    weights[r] += rate * step / np.sqrt(square[r])
            step = true_moves - moved
            square_moves += step**2
            moves += 0.3 * rate * step / np.sqrt(square_moves)
    return Model({f: weights[i] for f, i in index.items()}, moves)


@functools.lru_cache(maxsize=2)
def trained(count: int = SENTENCES, seed: int = SEED) -> Model:
    return train(sentences(count, seed))


def find(text: str | None, model: Model | None) -> tuple[list[Span], list[Span]]:
    """Spans of the rules, and all spans with those the model adds; both by kind, then start."""
    if not text or not _ANCHOR.search(text):
        return [], []
    base = rule_spans(text)
    more = model.spans(text, [(s, e) for _, s, e in base]) if model else []
    order = lambda x: (KINDS.index(x[0]), x[1])
    return base, sorted(base + more, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, counts of the rules' spans, ``base`` and ``spans`` as text) of every whole text.

    Offsets are code points, ends exclusive. A null text counts as empty. Repeated
    rows and null ids give rows like others; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def make():
        def work(ids, texts):
            rows = []
            for text in texts.to_pylist():
                base, spans = find(text, shared.value)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, written(base), written(spans)))
            return [ids, *map(list, zip(*rows))]

        return work

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ddl, make)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; all other columns stay. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    at, kinds = docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            clean = [redact(t, find(t, shared.value)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = map_arrow(docs, run, kinds)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")
