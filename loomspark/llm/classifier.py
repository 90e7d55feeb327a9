"""Quality classifier: a sparse ensemble of rules, compiled to column expressions.

Each text is reduced to statistics (``FEATURES``). From a bounded sample of labelled rows shallow boosted trees are grown on the
logistic loss; every path from a root to a node is a conjunctive rule over the statistics. A lasso logistic regression over
the rules keeps a few with weights. The model is a list of rules, and scoring is a Spark column expression: the statistics of
all documents are computed once, in batches, and the rules run inside the engine.

Only rows with crc32(doc_id as text) mod 5 != 0 are learnt from, at most ``SAMPLE`` of them, those with the smallest hash of their
id (the bound is the one documented limit; scoring covers all rows). Labels, lang, source and doc_id are no inputs of a score.
Null and empty texts have all-zero statistics and get a score as any other. Repeated and null ids are scored like others; null
ids are held out by no rule (``held_out`` null becomes false) and not learnt from. Several labels of one id count once, as their
majority (1 on a tie); each row of a labelled id is learnt from. Texts of any length are read whole; other columns don't matter. Without labelled rows of both classes, all
scores are the share of label 1, or 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

SAMPLE = 20_000
THRESHOLD = 0.3
TREES = 60
DEPTH = 3
RATE = 0.15

FEATURES = (
    "n_bytes", "n_words", "word_len", "unique_words", "upper", "digits", "punct", "symbols", "non_ascii", "white", "lines", "line_len", "dup_lines", "short_words",
    "long_words", "ends_stop", "commas", "caps_words", "top_word", "symbol_words", "digit_words", "urls", "repeat_pairs", "stop_bytes", "vowels", "sentence_len",
)

_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_PUNCT, _SYMBOL, _WHITE = b".,;:!?'\"()-", b"#*$%&|<>{}[]~^\\/@=+_", b" \t\n\x0b\x0c\r"
_HIGH, _VOWEL = bytes(range(128, 256)), b"aeiouAEIOU"


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [float(n)] + [0.0] * (len(FEATURES) - 1)
    share = lambda chars: (n - len(text.translate(None, chars))) / n
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, words), dtype=np.int64, count=k)
    pairs = len(set(zip(words, words[1:])))
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?\"")
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    odd = sum(c for w, c in counts.items() if w.translate(None, _SYMBOL) != w)
    num = sum(c for w, c in counts.items() if w.translate(None, _DIGIT) != w)
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(n), math.log1p(k), float(lens.mean()), len(counts) / k, share(_UPPER), share(_DIGIT), share(_PUNCT), share(_SYMBOL), share(_HIGH), share(_WHITE),
        math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), float((lens <= 3).mean()), float((lens >= 12).mean()), ends / len(lines),
        text.count(b",") / k, caps / k, max(counts.values()) / k, odd / k, num / k, (text.count(b"http") + text.count(b"www.")) / k, 1 - pairs / max(1, k - 1), stops / n, share(_VOWEL), math.log1p(k / (stops + 1)),
    ]


_STATS = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), *((f, pa.float64()) for f in FEATURES)])
_STATS_DDL = "_rid long, doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
        x = np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], schema=_STATS)


def measured(docs: DataFrame) -> DataFrame:
    return materialize(rows_of(docs).mapInArrow(_measure, _STATS_DDL), "quality-stats")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it above, threshold), and its weight."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, t in self.tests:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, above, t in self.tests:
            c = F.col(FEATURES[j])
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[j]} {'>' if above else '<='} {t:.6g}" for j, above, t in self.tests) + f" -> {self.weight:+.4f}"


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + r.column()
        return 1.0 / (1.0 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list) -> None:
    """Split on the best gain of the second-order loss over binned statistics; note the path of each node."""
    if path:
        paths.append((path, rows))
    if depth == 0 or len(rows) < 40:
        return
    best, gs, hs = (1e-3, None, None), g[rows], h[rows]
    total_g, total_h = gs.sum(), hs.sum()
    for j in range(x.shape[1]):
        if not len(cuts[j]):
            continue
        b = bins[rows, j]
        cg, ch = np.cumsum(np.bincount(b, gs, len(cuts[j]) + 1))[:-1], np.cumsum(np.bincount(b, hs, len(cuts[j]) + 1))[:-1]
        n = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
        gain[(n < 20) | (n > len(rows) - 20)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, k)
    if best[1] is None:
        return
    _, j, k = best
    low = bins[rows, j] <= k
    for above in (False, True):
        _grow(x, bins, cuts, g, h, rows[low != above], depth - 1, (*path, (j, above, float(cuts[j][k]))), paths)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = 1.5e-3) -> Model:
    """Boosted trees for the rules, then lasso logistic weights by accelerated proximal gradient; deterministic."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(math.log(p / (1 - p)), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    prior = y.mean()
    z, paths = np.full(len(y), math.log(prior / (1 - prior))), {}
    rng = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        found: list = []
        _grow(x, bins, cuts, g, h, rows, depth, (), found)
        inner = {path[:-1] for path, _ in found}
        for path, _ in found:
            paths.setdefault(tuple(sorted(path)), None)
            if path not in inner:  # a leaf moves the margin of all rows that it holds for
                m = Rule(path).holds(x)
                z[m] += RATE * g[m].sum() / (h[m].sum() + 1)
    rules = [Rule(p) for p in paths]
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    _, first = np.unique(a.T, axis=0, return_index=True)
    first.sort()
    a, rules = a[:, first], [rules[k] for k in first]
    mean = a.mean(axis=0)
    scale = np.maximum(a.std(axis=0), 0.05)
    s = (a - mean) / scale
    step = 4 / (np.linalg.norm(s, 2) ** 2 / len(y) + 1)
    w, b, wv, bv, t = np.zeros(len(rules)), math.log(prior / (1 - prior)), np.zeros(len(rules)), math.log(prior / (1 - prior)), 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(s @ wv + bv))) - y
        new = wv - step * (s.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = bv - step * r.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wv, bv = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(float(b - (w / scale) @ mean), tuple(Rule(rules[k].tests, float(w[k] / scale[k])) for k in kept))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out: those with the smallest hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))  # labels of one id that differ: the majority, ties count as 1
    order = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)).alias("_order")
    rows = stats.filter(~held_out() & F.col("doc_id").isNotNull()).join(known, "doc_id").select("*", order)
    n = rows.count()
    if n > sample:  # hashes are even: few rows above the bound are sorted, whatever the number of labels
        rows = rows.filter(F.col("_order") < int((sample + 6 * math.sqrt(sample) + 10) / n * (1 << 40)))
    rows = rows.orderBy("_order", "doc_id", "_rid").limit(sample)
    data = rows.select("y", *FEATURES).toPandas().to_numpy(dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    return fit(np.ascontiguousarray(data[:, 1:]), data[:, 0])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """_rid, doc_id, held_out, score, predicted."""
    stats = measured(docs)
    out = stats.select("_rid", "doc_id", held_out().alias("held_out"), train(stats, labels, sample).score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
