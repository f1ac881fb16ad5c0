"""Benchmark decontamination: a BM25 index of test items, block-max WAND, then
overlap of question and answer.

Index.  An item's question (all but its last sentence; without sentences, the
first three quarters of its words) and its answer (the rest) are cut into sections
of at most SECTION words, each part by itself if both have LEAST_PART words.  A
term's posting list holds its impact on each section, as a share of the section's
score for its own words, so scores and the threshold are comparable for all
sections.  Lists are cut at blocks of BLOCK sections, and each part has a header
with its largest impact.

Query.  Every passage of every training text is a query: windows of two cells of
SECTION words, one cell apart, so each section's text lies in some window whole.
The pivot divides the lists: those of the most frequent terms, which together
cannot bring any section of a block to more than ``rest`` of that block, below the
threshold, are not walked at all until a block is opened.  The headers of the
others are summed up for each cell and block, for all cells of a batch at once; a
block is opened for a passage where the sum over its two cells and the block's
rest reach the threshold, and all its sections are scored exactly.  Every one at
the threshold or above is retrieved.

Verification.  Runs of up to RUN words of question and answer are looked up in
the whole document.  The item has leaked (``leak``) with ``both``, if OVERLAP of
the question's and of the answer's runs occur; with the ``question`` alone, of
LEAST_PART words or more, which has to be there almost whole then (QUESTION_ALONE),
as a question without its answer may be a coincidence of phrasing; or as a
``part``, if OVERLAP of all its runs occur.

Words are lower-cased and punctuation separates them.  Distinct items are indexed
in slices of about SLICE_CHARS characters (one item at least), SLICES_A_PASS of
them in a pass over the documents.  Frequencies, the number of sections and their
mean length are those of all items, so slicing changes no score.

Defined results: null and empty texts and items match nothing; repeated items
are reported each; repeated documents are reported each; a null id counts as
0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunked, column, i64, ids_of, keep, run_hash, _WORD_MUL

SECTION = 64
BLOCK = 8
K1, B = 1.2, 0.75
THRESHOLD = 0.4
OVERLAP, QUESTION_ALONE = 0.5, 0.8
RUN, LEAST_PART = 5, 8
FREQUENT = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)  # shares of sections from which on a term is frequent: the first that leaves a rest below REST
REST = 0.75
SLICE_CHARS, SLICES_A_PASS = 1 << 20, 8
CELLS = 1 << 20  # (cell, block) sums at once
_MARKS = string.punctuation.encode()


def _words(text: pa.Array) -> Words:
    return Words(pc.utf8_lower(text.cast(pa.large_string()).fill_null("")), separators=_MARKS)


def _runs(w: Words, doc: int, lo: int, hi: int) -> tuple[np.ndarray, int]:
    """Distinct hashes of runs of RUN words among words lo..hi-1 of a document (of all, if these are fewer), and their size."""
    a, b = w.first[doc] + lo, w.first[doc] + hi
    n = min(RUN, b - a)
    if n <= 0:
        return np.zeros(0, np.uint64), 0
    at = np.arange(a, b - n + 1)
    return np.unique(run_hash(w.hash, at, at + n, _WORD_MUL)), int(n)


def _answer_at(text: str, n: int) -> int:
    """Word at which the item's answer begins."""
    ends = [m.end() for m in re.finditer(r"[.!?:]\s+(?=\S)", text)]
    if ends:
        cut = len(_words(pa.array([text[: ends[-1]]])).start)
        if 0 < cut < n:
            return cut
    return max(1, math.ceil(n * 0.75)) if n else 0


def sections(w: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(item, first word, last word + 1) of all sections, and where each item's answer begins."""
    item, start, end, cuts = [], [], [], []
    for d, text in enumerate(texts):
        a, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
        cuts.append(_answer_at(text, n))
        apart = min(cuts[-1], n - cuts[-1]) >= LEAST_PART
        for lo, hi in ((0, cuts[-1]), (cuts[-1], n)) if apart else ((0, n),):
            for s in range(lo, hi, SECTION):
                item.append(d)
                start.append(a + s)
                end.append(a + min(hi, s + SECTION))
    return *(np.array(x, dtype=np.int64) for x in (item, start, end)), cuts


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + size[i] - 1 for all i, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """BM25 posting lists of items, cut at blocks, with their maxima.

    df: sections of all items with each of ``terms``; n, mean: number and mean
    length of all sections.
    """

    def __init__(self, keys: np.ndarray, texts: list[str], terms: np.ndarray, df: np.ndarray, n: int, mean: float, threshold: float = THRESHOLD):
        w = _words(pa.array(texts, pa.string()))
        item, start, end, cuts = sections(w, texts)
        self.key = keys
        self.question = [_runs(w, d, 0, c) for d, c in enumerate(cuts)]
        self.answer = [_runs(w, d, c, int(w.first[d + 1] - w.first[d])) for d, c in enumerate(cuts)]
        self.question_words = np.array(cuts, dtype=np.int64)
        size, width = end - start, max(1, len(item))
        section = np.repeat(np.arange(len(size)), size)
        term = np.searchsorted(terms, w.hash[_ranges(start, size)])
        pair, tf = np.unique(term * width + section, return_counts=True)
        term, section = pair // width, pair % width
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)[section])
        impact = impact / np.bincount(section, impact, minlength=width)[section]
        for share in FREQUENT:
            self.frequent = df >= max(2.0, share * n)
            rest = np.bincount(section, np.where(self.frequent[term], impact, 0), minlength=width)
            if rest.max(initial=0) <= REST * threshold:
                break
        else:
            self.frequent, rest = np.zeros(len(terms), dtype=bool), np.zeros(width)
        order = np.argsort(rest, kind="stable")  # sections of a block have rests alike
        self.item = item[order]
        back = np.empty(width, np.int64)
        back[order] = np.arange(width)
        if len(section):
            section = back[section]
        by = np.lexsort((section, term))
        term, self.section, self.impact = term[by], section[by], impact[by]
        self.terms, self.blocks = terms, -(-len(item) // BLOCK)
        self.rest = np.array([rest[order[b : b + BLOCK]].max() for b in range(0, len(item), BLOCK)])
        key = term * max(1, self.blocks) + self.section // BLOCK
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.part_key, self.part_begin, self.part_size = key[begin], begin, np.diff(np.r_[begin, len(key)])
        self.part_block = self.part_key % max(1, self.blocks)
        self.part_max = np.maximum.reduceat(self.impact, begin) if len(begin) else np.zeros(0)
        self.list_begin = np.searchsorted(term[begin], np.arange(len(terms) + 1))
        self.list_size = np.where(self.frequent, 0, np.diff(self.list_begin))  # frequent ones are not walked

    def retrieve(self, w: Words, threshold: float) -> dict[tuple[int, int], float]:
        """Best score of each (document, item) with a passage at the threshold or above."""
        best: dict[tuple[int, int], float] = {}
        if not len(self.terms):
            return best
        many = len(self.terms)
        count = np.diff(w.first)
        cells = -(-count // SECTION)
        base = np.cumsum(cells) - cells
        at = np.minimum(np.searchsorted(self.terms, w.hash), many - 1)
        hit = np.flatnonzero(self.terms[at] == w.hash)
        doc = np.repeat(np.arange(w.docs), count)[hit]
        key = np.unique((base[doc] + (hit - w.first[doc]) // SECTION) * many + at[hit])
        cell, term = key // many, key % many
        of = np.repeat(np.arange(w.docs), cells)
        step = max(1, CELLS // self.blocks)
        for a in range(0, len(of), step):
            # one cell more, which only ends a passage here
            lo, hi = np.searchsorted(cell, [a, a + step + 1])
            self._batch(cell[lo:hi] - a, term[lo:hi], of[a : a + step + 1], min(step, len(of) - a), threshold, best)
        return best

    def _batch(self, cell: np.ndarray, term: np.ndarray, of: np.ndarray, passages: int, threshold: float, best: dict) -> None:
        n = self.list_size[term]
        part = _ranges(self.list_begin[term], n)
        spot = np.repeat(cell, n) * self.blocks + self.part_block[part]
        bound = np.bincount(spot, self.part_max[part], minlength=len(of) * self.blocks).reshape(-1, self.blocks)
        paired = np.zeros(len(of), dtype=bool)  # whether the next cell is of the same document
        paired[:-1] = of[1:] == of[:-1]
        both = bound[:passages].copy()
        follow = bound[1 : passages + 1]
        both[: len(follow)] += np.where(paired[: len(follow), None], follow, 0)
        passage, block = np.nonzero(both + self.rest >= threshold - 1e-9)
        if not len(passage):
            return
        # the distinct terms of these passages
        first = np.searchsorted(cell, np.arange(len(of) + 1))
        wanted, back = np.unique(passage, return_inverse=True)
        last = wanted + 1 + paired[wanted]
        size = first[last] - first[wanted]
        key = np.unique(np.repeat(np.arange(len(wanted)), size) * len(self.terms) + term[_ranges(first[wanted], size)])
        owner, mine = key // len(self.terms), key % len(self.terms)
        begin = np.searchsorted(owner, np.arange(len(wanted) + 1))
        size = np.diff(begin)[back]
        rows = np.repeat(np.arange(len(passage)), size)
        ask = mine[_ranges(begin[back], size)] * self.blocks + block[rows]
        at = np.minimum(np.searchsorted(self.part_key, ask), len(self.part_key) - 1)
        there = self.part_key[at] == ask
        rows, at = rows[there], at[there]
        size = self.part_size[at]
        posting = _ranges(self.part_begin[at], size)
        score = np.bincount(np.repeat(rows, size) * BLOCK + self.section[posting] % BLOCK, self.impact[posting], minlength=len(passage) * BLOCK)
        for k in np.flatnonzero(score >= threshold).tolist():
            row, inner = divmod(k, BLOCK)
            pair = (int(of[passage[row]]), int(self.item[block[row] * BLOCK + inner]))
            best[pair] = max(best.get(pair, 0.0), float(score[k]))


class _Runs:
    """Runs of words of a chunk's documents: hashed for a whole chunk at once, a size
    at a time, and sorted for a document when it is asked for."""

    def __init__(self, w: Words):
        self.w, self.grams, self.of = w, {}, {}

    def share(self, doc: int, runs: np.ndarray, size: int) -> float:
        """How much of ``runs`` (of ``size`` words) a document has."""
        if not len(runs):
            return 0.0
        if size not in self.grams:
            self.grams[size] = self.w.grams(size)
        if (doc, size) not in self.of:
            at, value = self.grams[size]
            lo, hi = np.searchsorted(at, self.w.first[doc : doc + 2])
            self.of[doc, size] = np.sort(value[lo:hi])
        have = self.of[doc, size]
        return float((have[np.minimum(np.searchsorted(have, runs), len(have) - 1)] == runs).mean()) if len(have) else 0.0


def _found(indexes: list, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            w, ids = _words(column(part, "text")), ids_of(part)
            rows, have = [], _Runs(w)
            for shared in indexes:
                index = shared.value
                for (doc, item), score in index.retrieve(w, threshold).items():
                    (q, q_size), (a, a_size) = index.question[item], index.answer[item]
                    qs, as_ = have.share(doc, q, q_size), have.share(doc, a, a_size)
                    whole = (qs * len(q) + as_ * len(a)) / max(1, len(q) + len(a))
                    leak = "both" if min(qs, as_) >= overlap else "question" if qs >= QUESTION_ALONE and index.question_words[item] >= LEAST_PART else "part" if whole >= overlap else None
                    if leak:
                        rows.append((int(ids[doc]), int(index.key[item]), score, qs, as_, leak))
            rows.sort()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "key", "score", "question_overlap", "answer_overlap", "leak"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of items with their sections, for each slice; term null: number and words of all sections."""
    for part in chunked(batches):
        slices = column(part, "slice").to_numpy()
        texts = column(part, "text").to_pylist()
        w = _words(pa.array(texts, pa.string()))
        item, start, end, _ = sections(w, texts)
        size = end - start
        owner = np.repeat(np.arange(len(size)), size)
        word = w.hash[_ranges(start, size)]
        names, term = np.unique(word, return_inverse=True)
        pair = np.unique(owner * max(1, len(names)) + term)
        owner, term = pair // max(1, len(names)), pair % max(1, len(names))
        key, count = np.unique(slices[item[owner]] * max(1, len(names)) + term, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[key // max(1, len(names)), -1]), pa.array(np.r_[i64(names)[key % max(1, len(names))], 0] if len(key) else [0]), pa.array(np.r_[count, len(size)]), pa.array(np.r_[np.zeros(len(count), np.int64), size.sum()])],
            names=["slice", "term", "n", "words"],
        )


def build(items: DataFrame, slice_chars: int = SLICE_CHARS, threshold: float = THRESHOLD) -> list[Index]:
    """Indexes of all distinct texts of items (text, key), in slices."""
    items = items.withColumn("chars", F.length("text").cast("long"))
    chars = items.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    buckets = max(1, 4 * -(-chars // slice_chars)) if chars > slice_chars else 1
    items = items.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    slices, held, number = {}, 0, 0
    for b, n in sorted((r["bucket"], r["n"]) for r in items.groupBy("bucket").agg(F.sum("chars").alias("n")).collect()):  # four rows for each slice
        if held and held + n > slice_chars:
            number, held = number + 1, 0
        slices[b], held = number, held + n
    if not slices:
        return []
    place = F.get(F.array(*[F.lit(slices.get(b, 0)) for b in range(buckets)]), F.col("bucket").cast("int")).cast("long")
    items = keep(items.select("key", "text", place.alias("slice")))
    counted = keep(items.select("slice", "text").mapInArrow(_counted, "slice long, term long, n long, words long"))
    n, words = counted.where("slice = -1").agg(F.sum("n"), F.sum("words")).first()
    terms = counted.where("slice >= 0")
    df = terms.select("slice", "term").distinct().join(terms.groupBy("term").agg(F.sum("n").alias("df")), "term")
    out = []
    for s in range(number + 1):
        mine = items.where(F.col("slice") == s).select("key", "text").toPandas().sort_values("key")
        known = df.where(F.col("slice") == s).select("term", "df").toPandas()
        hashes = known["term"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(hashes)
        out.append(Index(mine["key"].to_numpy(dtype=np.int64), mine["text"].tolist(), hashes[order], known["df"].to_numpy(dtype=float)[order], int(n or 0), (words or 1) / max(1, n or 1), threshold))
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, leak) of verified leaks."""
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"), F.col("text").cast("string")).where("text is not null").withColumn("key", F.xxhash64("text"))
    shared = [spark.sparkContext.broadcast(i) for i in build(named.select("key", "text").dropDuplicates(["key"]), slice_chars, threshold)]
    schema = "doc_id long, key long, score double, question_overlap double, answer_overlap double, leak string"
    found = spark.createDataFrame([], schema)
    for a in range(0, len(shared), SLICES_A_PASS):  # one pass, unless the items are many
        part = body.mapInArrow(_found(shared[a : a + SLICES_A_PASS], threshold, overlap), schema)
        found = part if a == 0 else found.unionByName(part)
    return found.join(named.select("key", "item_id"), "key").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leak")
