"""Best-fit packing planned on a histogram of lengths.

Each document is its token ids and an end id; longer ones are cut into pieces
of the sequence length.  Packing depends on the lengths of pieces alone, so
best fit (longest first, into the fullest sequence that still has room) runs
over the counts of the at most ``capacity`` distinct lengths on the driver.
The plan is a list of segments: pieces of one length whose ranks lie in a range
go to consecutive sequences, a fixed number in each, at a fixed offset.  It has
a few segments for each length, whatever the number of documents.  Pieces then
take their slots by joining on rank within length.

Ranks are dealt in two steps, so no length gathers in one task: counts of each
length in each block of documents, running totals of these counts, then the
rank inside the block.

Defined results: a null or empty text is the end id alone; rows that repeat a
doc_id are packed each; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunked, column, ids_of, keep
from .tokens import append_end, crc32, encode, vocabulary_path

CAPACITY = 4096
END_ID = 1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first.

    Segments (length, first rank, last rank + 1, first sequence, pieces in each
    sequence, offset of the first): rank r goes to sequence
    first + (r - rank) // each, at offset + (r - rank) % each * length.
    """
    out, fresh = [], 0
    open_: dict[int, list[list[int]]] = {}  # room left: runs [first sequence, how many]
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rooms = [r for r in set(rooms) if open_.get(r)]
        heapify(rooms)
        small = []
        while left:
            while rooms and (rooms[0] < length or not open_.get(rooms[0])):
                r = heappop(rooms)
                if open_.get(r):
                    small.append(r)
            if rooms:
                room = rooms[0]
                first, n = open_[room].pop()
            else:
                room, first, n = capacity, fresh, -1
            each = room // length
            need = -(-left // each)
            if n < 0:
                n = need
                fresh += n
            used = min(n, need)
            if n > used:
                open_[room].append([first + used, n - used])
            full = used if used * each <= left else used - 1
            for count, pieces in ((full, each), (used - full, left - full * each)):
                if count:
                    out.append((length, rank, rank + count * pieces, first, pieces, capacity - room))
                    rest = room - pieces * length
                    if rest:
                        open_.setdefault(rest, []).append([first, count])
                        heappush(rooms, rest)
                    rank += count * pieces
                    left -= count * pieces
                    first += count
        rooms += small
    return out


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)  # of each length, in this block
        for part in chunked(batches):
            flat, first = append_end(*encode(column(part, "text"), path), end_id)
            size, ids = np.diff(first), ids_of(part)
            n = -(-size // capacity)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(np.arange(len(ids)), n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            at = first[doc] + start
            crcs = [crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            inner = np.empty(len(order), np.int64)
            inner[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
            local = seen[length] + inner
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), block), pa.int32()), pa.array(local)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "local"],
            )

    return run


def _placed(segments: np.ndarray):
    """Slots of pieces by (length, rank): a search in the plan."""
    key = segments[:, 0] * (1 << 45) + segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            length, rank = (column(part, c).to_numpy() for c in ("length", "rank"))
            s = segments[np.searchsorted(key, length * (1 << 45) + rank, side="right") - 1]
            k = rank - s[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(column(part, c) for c in names), pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 5] + k % s[:, 4] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    body = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, local long"
    pieces = keep(body.mapInArrow(_pieces(path or vocabulary_path(), capacity, end_id), schema))
    counts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = keep(counts)
    # at most ``capacity`` rows reach the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 6)
    w = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("length", "block", "before")
    # as many rows as lengths and blocks: too many to send to every task at scale, while pieces are few bytes each
    ranked = pieces.join(before.hint("merge"), ["length", "block"]).withColumn("rank", F.col("before") + F.col("local"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not len(segments):
        return docs.sparkSession.createDataFrame([], out)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(segments), out)
