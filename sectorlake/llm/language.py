"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary classifier for each bit
predicts it from hashed byte trigrams (square roots of their shares, so texts
of all lengths compare).  Decoding sums, over the bits, the logistic loss of
the classifier's margin against the codeword, weighted by how reliable the bit
was in fitting; the codeword of least loss wins.  ``score`` is the share of
exp(-loss) that it takes, ``ambiguous`` marks texts in which the next codeword
comes close.

Codes: all 2**(n-1) - 1 distinct splits of n languages up to 7 languages, else
random balanced words of 10 log2(n) bits, the best of several draws by least
distance.

Fitting uses at most about DOCS_A_LANGUAGE documents of each language, and about
FIT_DOCS in all (whole texts, chosen by a hash of the id).

Defined results: ``und``, score 0, not ambiguous, for a null text or one
without a letter; no labelled texts: ``und`` for all; a null doc_id counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunked, column, crc_mod

DIMS = 2048
DOCS_A_LANGUAGE, FIT_DOCS = 1000, 20_000
LANGUAGES_TO_SEND = 10_000  # counts of as many may go to every task
HELD_OUT = 2
FOLDS = 4
MARGIN = 0.05
_ROWS = 2048


def features(text: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of trigram shares (documents x dims), and which texts have a letter."""
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    texts = pa.concat_arrays([text])
    bound = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[bound[0] : bound[-1]] if data is not None else np.zeros(0, np.uint8)
    bound = bound - bound[0]
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    b = table[buf].astype(U64)
    ascii_letters = np.concatenate([[0], np.cumsum((table[buf] != 32) & (table[buf] < 128), dtype=np.int64)])
    has = np.diff(ascii_letters[bound]) > 0
    size = np.diff(bound)
    for d in np.flatnonzero(~has & (size > 0)):
        has[d] = any(c.isalpha() for c in text[int(d)].as_py())
    x = np.zeros((n, dims), np.float32)
    if len(b) >= 3:
        tri = (b[:-2] << U64(16)) | (b[1:-1] << U64(8)) | b[2:]
        bucket = ((tri * U64(0x9E3779B97F4A7C15)) >> U64(64 - int(math.log2(dims)))).astype(np.int64)
        doc = np.repeat(np.arange(n), size)
        inside = doc[:-2] == doc[2:]
        count = np.bincount(doc[:-2][inside] * dims + bucket[inside], minlength=n * dims).reshape(n, dims)
        total = np.maximum(count.sum(axis=1, keepdims=True), 1)
        x = np.sqrt(count / total).astype(np.float32)
    return x, has


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +-1 bits for each of n languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if (s >> i) & 1 else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)], dtype=float)
    bits, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(seed), None
    for _ in range(50):
        code = np.array([rng.permutation([1.0] * (n // 2) + [-1.0] * (n - n // 2)) for _ in range(bits)]).T
        gram = code @ code.T - 2 * bits * np.eye(n)
        if best is None or gram.max() < best[0]:
            best = (gram.max(), code)
    return best[1]


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share, and the next one's share."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        return share.argmax(axis=1), order[:, -1], order[:, -2] if order.shape[1] > 1 else np.zeros(len(x))


def fit(x: np.ndarray, label: np.ndarray, languages: list[str], steps: int = 150, ridge: float = 1e-4) -> Model:
    """Logistic regressions for all bits at once, by accelerated gradient steps."""
    code = codewords(len(languages))
    y = code[label]
    balance = 1.0 / np.maximum(np.bincount(label, minlength=len(languages)), 1)[label]
    balance = (balance / balance.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    v, c, rate = w, b, 4.0 / (1 + ridge)
    for step in range(steps):
        pull = -y / (1 + np.exp(np.clip(y * (x @ v + c), -40, 40))) * balance
        w2, b2 = v - rate * (x.T @ pull + ridge * v), c - rate * pull.sum(axis=0)
        k = step / (step + 3)
        v, c, w, b = w2 + k * (w2 - w), b2 + k * (b2 - b), w2, b2
    right = ((x @ w + b) * y > 0).mean(axis=0)
    return Model(languages, code, w * 3, b * 3, np.maximum(right - 0.5, 0.01) * 2)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunked(batches, rows=_ROWS):
        x, has = features(column(part, "text"))
        yield pa.RecordBatch.from_arrays([column(part, "lang"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(has)], names=["lang", "x", "has"])


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0))


def train(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE) -> Model | None:
    """A model from labelled texts outside the held-out fold."""
    learn = docs.select(_id().alias("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    learn = learn.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod(FOLDS) != HELD_OUT))
    counts = learn.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    each = max(1, min(docs_a_language, FIT_DOCS // languages))
    counts = F.broadcast(counts) if languages <= LANGUAGES_TO_SEND else counts
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = learn.join(counts, "lang").where(draw < each / F.col("n")).select("lang", "text").mapInArrow(_vectors, "lang string, x binary, has boolean").where("has").select("lang", "x").toArrow()
    if not rows.num_rows:
        return None
    found = rows.column("lang").to_pylist()
    languages = sorted(set(found))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(found), -1)
    return fit(x, np.array([languages.index(l) for l in found]), languages)


def _predicted(model: Model | None, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, rows=_ROWS):
            n = part.num_rows
            lang, score, close = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            if model is not None:
                x, has = features(column(part, "text"))
                best, share, other = model.decode(x)
                for i in np.flatnonzero(has):
                    lang[i] = model.languages[best[i]]
                score, close = np.where(has, share, 0.0), has & (share - other < margin)
            yield pa.RecordBatch.from_arrays(
                [column(part, c) for c in part.schema.names if c != "text"] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close)],
                names=[c for c in part.schema.names if c != "text"] + ["lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, model: Model | None, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous."""
    body = docs.select(_id().alias("doc_id"), F.col("text").cast("string"))
    body = body.select("doc_id", (crc_mod(FOLDS) == HELD_OUT).alias("held_out"), "text")
    return body.mapInArrow(_predicted(model, margin), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
