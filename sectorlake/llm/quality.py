"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of each whole text (shares of kinds of bytes, words and repeats).
2. Boosted trees of depth 3 on labelled rows; every path from a root to a node
   is a rule, a conjunction of comparisons of statistics.
3. A logistic model over the rules with an L1 penalty keeps few of them.
4. The kept rules compile into one Spark column expression over the statistics.

Fitting uses at most FIT_ROWS labelled rows (by a hash of the id); labels of the held-out fold are
never read.  Defined results: null and empty texts have all statistics 0 and
get a score like any other; conflicting labels of a document count as their
mean, 1 from 0.5; without labels every score is 0.5; a null doc_id counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunked, column, crc_mod, ids_of, keep

FIT_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
CUTOFF = 0.7
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "shout", "bar", "line_bytes", "beyond_ascii",
    "distinct", "twins", "capital_words", "stops",
]


def _kinds() -> dict[str, np.ndarray]:
    def at(chars: bytes) -> np.ndarray:
        t = np.zeros(256, dtype=bool)
        t[list(chars)] = True
        return t

    high = np.zeros(256, dtype=bool)
    high[128:] = True
    return {
        "upper": at(bytes(range(65, 91))), "digit": at(bytes(range(48, 58))), "mark": at(b"#$%&*^~"),
        "shout": at(b"!?"), "bar": at(b"|"), "newline": at(b"\n"), "beyond_ascii": high,
    }


def statistics(text: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    w = Words(text)
    size, count = np.diff(w.bound).astype(float), np.diff(w.first).astype(float)
    some, any_word = np.maximum(size, 1), np.maximum(count, 1)

    def share(mask: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[bound])

    by = {k: share(t[w.buf], w.bound) for k, t in _kinds().items()}
    distinct, edges = np.zeros(w.docs), w.first.tolist()
    for d, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            h = np.sort(w.hash[a:b])
            distinct[d] = 1 + np.count_nonzero(h[1:] != h[:-1])
    twin = np.zeros(len(w.start), dtype=bool)
    twin[1:] = w.hash[1:] == w.hash[:-1]
    long = w.end - w.start > 1
    second = w.buf[np.minimum(w.start + 1, w.end - 1)]
    caps = long & (second >= 65) & (second < 91)
    stop = np.isin(w.buf[w.end - 1], np.frombuffer(b".,;:", np.uint8))
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), share(~w.space, w.bound) / any_word, by["upper"] / some, by["digit"] / some,
            by["mark"] / some, by["shout"] / some, by["bar"] / some, size / (by["newline"] + 1), by["beyond_ascii"] / some,
            distinct / any_word, share(twin, w.first) / any_word, share(caps, w.first) / any_word, share(stop, w.first) / any_word,
        ]
    )


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, cut in self.terms:
            v = x[:, STATISTICS.index(name)]
            out &= v > cut if above else v <= cut
        return out

    def column(self) -> Column:
        out = None
        for name, above, cut in self.terms:
            term = F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut)
            out = term if out is None else out & term
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], pull: np.ndarray, curve: np.ndarray, columns: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """Paths of one tree on gradients, and its prediction for each row."""
    rules: list[Rule] = []
    value = np.zeros(len(x))

    def grow(rows: np.ndarray, terms: tuple, left: int) -> None:
        if terms:
            rules.append(Rule(terms))
        g, h = pull[rows].sum(), curve[rows].sum()
        value[rows] = g / (h + 1)
        if not left or len(rows) < 20:
            return
        best = (1e-6, None, None)
        for j in columns:
            if not len(cuts[j]):
                continue
            gs = np.bincount(codes[rows, j], pull[rows], len(cuts[j]) + 1).cumsum()[:-1]
            hs = np.bincount(codes[rows, j], curve[rows], len(cuts[j]) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return
        j, k = best[1], best[2]
        low = codes[rows, j] <= k
        grow(rows[low], (*terms, (STATISTICS[j], False, float(cuts[j][k]))), left - 1)
        grow(rows[~low], (*terms, (STATISTICS[j], True, float(cuts[j][k]))), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, value


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1 logistic weights by accelerated proximal gradient; the bias is free."""
    n = max(1, len(y))
    a = np.hstack([np.ones((len(y), 1)), r])
    rate = 4.0 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = np.zeros(a.shape[1])
    v = w
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -40, 40)))
        z = v - rate * (a.T @ (p - y) / n)
        z[1:] = np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - rate * penalty, 0)
        v, w = z + step / (step + 3) * (z - w), z
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, bins: int = 48, penalty: float = 3e-4, seed: int = 11) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, (), ())
    rate = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return RuleEnsemble(base, (), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    codes = np.column_stack([np.searchsorted(c, col) for c, col in zip(cuts, x.T, strict=True)])
    z, rules = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = rng.random(len(y)) < 0.7
        columns = rng.choice(len(STATISTICS), size=9, replace=False)
        found, value = _tree(x, codes, cuts, np.where(rows, y - p, 0), np.where(rows, p * (1 - p), 0), columns, depth)
        z = z + 0.4 * value
        rules += found
    seen, kept = set(), []
    for rule in dict.fromkeys(rules):
        on = rule.holds(x)
        if on.tobytes() not in seen and 5 <= on.sum() <= len(y) - 5:
            seen.add(on.tobytes())
            kept.append(rule)
    r = np.column_stack([k.holds(x) for k in kept]).astype(float) if kept else np.zeros((len(y), 0))
    bias, weight = _lasso(r, y, penalty)
    chosen = np.flatnonzero(np.abs(weight) > 1e-6)
    return RuleEnsemble(bias, tuple(kept[i] for i in chosen), tuple(float(weight[i]) for i in chosen))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunked(batches):
        x = statistics(column(part, "text"))
        yield pa.RecordBatch.from_arrays([pa.array(ids_of(part)), *(pa.array(c) for c in x.T)], names=["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every whole text."""
    body = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return body.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def train(measured: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """An ensemble from labels (doc_id, quality) outside the held-out fold."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(FOLDS) != HELD_OUT))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    # a share of the labels by a hash of the id, a little over fit_rows of them, so no task offers more
    known = labels.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    labels = labels.where(draw < int(min(1.0, 1.25 * fit_rows / max(1, known)) * (1 << 30)))
    rows = measured.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toPandas()
    return fit(rows[STATISTICS].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    measured = keep(measure(docs))
    model = train(measured, labels, fit_rows)
    scored = measured.select("doc_id", (crc_mod(FOLDS) == HELD_OUT).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
