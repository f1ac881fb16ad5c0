"""Substring dedup by seed and extend.

Seeds.  The words of a document are hashed in runs of ``seed_words``; a window
of ``window`` words elects the smallest of its run hashes (the leftmost of
equal ones) as its anchor.  The election depends on the window's words alone,
so equal windows elect the same anchor at the same place, and joining on
anchors finds every repeat of ``window`` words or more.

Extend.  An occurrence of an anchor is stored with the stretch of windows that
elected it, and a hash of that whole stretch.  Where all occurrences of a
shared anchor have the same stretch, the match extends over all of it and the
smallest document id settles every occurrence.  Where they differ, the
occurrences of each distinct stretch in the smallest document that has it are
extended exactly: each window of the stretch, i.e. each way to split the words
left and right of the anchor, is matched by hash.  Consecutive matched windows
join into maximal repeats.

No pairs of documents are formed: a group of m copies costs m rows, however
large.  Hashes have 64 bits.

Occurrences belong to rows, which a hash of id and text names, so rows that repeat
a doc_id lose the words of their own text alone.

Defined results: a null or empty text has no words and loses none; documents
shorter than the window lose nothing; rows that repeat a doc_id do not remove
each other's windows; a null doc_id is handled as 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chunked, column, i64, ids_of, keep, run_hash

WINDOW = 50
SEED_WORDS = 20


def window_anchors(words: Words, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor word, anchor hash, first window, last window) for each maximal
    stretch of consecutive windows with the same anchor."""
    at, grams = words.grams(seed_words)
    n = len(words.start)
    empty = np.zeros(0, np.int64)
    span = window - seed_words + 1
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return empty, empty.astype(U64), empty, empty
    value = np.full(n + span, np.iinfo(np.uint64).max, dtype=U64)
    value[at] = grams
    best, where, width = value.copy(), np.arange(n + span), 1
    while width < span:  # a minimum over 2**k, then the remainder
        step = min(width, span - width)
        other, place = best[step:], where[step:]
        take = other < best[:-step]
        best = np.concatenate([np.where(take, other, best[:-step]), best[-step:]])
        where = np.concatenate([np.where(take, place, where[:-step]), where[-step:]])
        width += step
    anchor = where[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(starts)) - 1
    return anchor[lo], value[anchor[lo]], starts[lo], starts[hi]


def _anchors(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            w, ids = Words(column(part, "text")), ids_of(part)
            at, value, lo, hi = window_anchors(w, window, seed_words)
            doc = np.searchsorted(w.first, lo, side="right") - 1
            stretch = run_hash(w.hash, lo, hi + window, U64(0xB5297A4D3C6EF372 | 1)) ^ (at - lo).astype(U64)
            # text that repeats itself elects equal anchors with equal stretches side by side: one row for each run
            new = np.ones(len(lo), dtype=bool)
            new[1:] = (value[1:] != value[:-1]) | (stretch[1:] != stretch[:-1]) | (doc[1:] != doc[:-1])
            run_lo = np.flatnonzero(new)
            hi = hi[np.append(run_lo[1:], len(lo)) - 1] if len(lo) else hi
            lo, value, stretch, doc = lo[run_lo], value[run_lo], stretch[run_lo], doc[run_lo]
            yield pa.RecordBatch.from_arrays(
                [i64(value), i64(stretch), ids[doc], column(part, "row").to_numpy()[doc], (lo - w.first[doc]).astype(np.int32), (hi - w.first[doc]).astype(np.int32)],
                names=["anchor", "stretch", "doc_id", "row", "lo", "hi"],
            )

    return run


def _windows(window: int):
    """Hashes of the windows asked for: rows of doc_id, row, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            w, ids = Words(column(part, "text")), ids_of(part)
            spans = column(part, "spans")
            size = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            doc = np.repeat(np.arange(len(ids)), size)
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            count = hi - lo + 1
            pos = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            doc = np.repeat(doc, count)
            start = w.first[doc] + pos
            value = run_hash(w.hash, start, start + window, U64(0xB5297A4D3C6EF372 | 1))
            yield pa.RecordBatch.from_arrays([i64(value), ids[doc], column(part, "row").to_numpy()[doc], pos.astype(np.int32)], names=["content", "doc_id", "row", "lo"])

    return run


def _rows(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, row (the key of id and text), text and other columns."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string"), *others)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text", *others)


def repeats(rows: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(row, lo, hi): words lo..hi-1 are covered by windows that also start in a
    document with a smaller id.  Intervals of a row may overlap."""
    found = rows.mapInArrow(_anchors(window, seed_words), "anchor long, stretch long, doc_id long, row long, lo int, hi int")
    # one exchange serves the grouping of anchors and the join with it: both sides ask for the same columns
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.where("anchor is not null and stretch is not null and doc_id is not null and row is not null and lo is not null and hi is not null").repartition(n, "anchor")
    shared = (
        found.groupBy("anchor")
        .agg(
            F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("stretch").alias("s0"), F.max("stretch").alias("s1"),
            F.min("lo").alias("lo0"), F.max("hi").alias("hi1"), F.max("row").alias("row1"),
        )
        .where("first_doc < last_doc and lo0 <= hi1 and row1 is not null")
        .select("anchor", "first_doc", (F.col("s0") == F.col("s1")).alias("alike"))
    )
    # shared anchors are a fraction of all; what follows reads them several times
    seeds = keep(found.join(shared, "anchor"))
    settled = seeds.where("alike and doc_id > first_doc").select("row", "lo", (F.col("hi") + window).alias("hi"))
    mixed = seeds.where("not alike")
    classes = mixed.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("rep"))
    classed = keep(mixed.join(classes, ["anchor", "stretch"]).select("doc_id", "row", "lo", "hi", "rep"))
    copies = classed.where("doc_id > rep").select("row", "lo", (F.col("hi") + window).alias("hi"))
    # every occurrence in that document: a passage it holds twice has to go twice
    asked = classed.where("doc_id = rep").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    contents = rows.join(asked, "row").select("doc_id", "row", "text", "spans").mapInArrow(_windows(window), "content long, doc_id long, row long, lo int")
    contents = keep(contents)
    first = contents.groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    extended = (
        contents.join(first, "content")
        .where("doc_id > first_doc")
        .select("row", "lo", (F.col("lo") + window).alias("hi"))
    )
    return settled.unionByName(copies).unionByName(extended)


def _strip(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            w = Words(column(part, "text"), hashed=False)
            lo_lists = column(part, "spans")
            size = np.nan_to_num(np.asarray(pc.list_value_length(lo_lists).to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
            flat = lo_lists.flatten()
            doc = np.repeat(np.arange(len(size)), size)
            n = len(w.start)
            mark = np.zeros(n + 1, dtype=np.int64)
            if len(doc):
                lo, hi = (np.minimum(w.first[doc] + flat.field(k).to_numpy(zero_copy_only=False), w.first[doc + 1]) for k in ("lo", "hi"))
                np.add.at(mark, lo, 1)
                np.add.at(mark, hi, -1)
            gone = np.cumsum(mark)[:n] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[w.first[1:]] - total[w.first[:-1]]
            digests, kept_texts, raw = [], [], w.buf.tobytes()
            for d in range(w.docs):
                a, b = w.first[d], w.first[d + 1]
                body = raw[w.bound[d] : w.bound[d + 1]].split()  # bytes.split: 0x20 and 0x09-0x0D
                if removed[d]:
                    body = [body[i] for i in np.flatnonzero(~gone[a:b])]
                body = b" ".join(body)
                digests.append(hashlib.sha256(body).hexdigest())
                if keep_text:  # a text that loses nothing stays as it is
                    kept_texts.append(body.decode() if removed[d] else raw[w.bound[d] : w.bound[d + 1]].decode())
            rest = [column(part, c) for c in part.schema.names if c not in ("text", "spans")]
            names = [c for c in part.schema.names if c not in ("text", "spans")]
            arrays = [*rest, pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names += ["n_words", "n_removed", "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the carried columns, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    body = _rows(docs, *carry)
    spans = repeats(body.select("doc_id", "row", "text"), window, seed_words).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kinds = dict(body.dtypes)
    schema = "doc_id long, " + "".join(f"`{c}` {kinds[c]}, " for c in carry) + "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return body.join(spans, "row", "left").select("doc_id", *carry, "text", "spans").mapInArrow(_strip(keep_text), schema)
