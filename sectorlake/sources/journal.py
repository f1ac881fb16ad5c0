"""A journal as a data source, in batch and as a stream.

``path`` is a raw journal, or a folder with one file for each dense range of it,
named by the offset of its first byte, on storage that all executors reach.
Files are split at 4 KiB pages, which no record crosses, into partitions of
partitionBytes (32 MiB); a range is read in windows, never whole.  Filters on
offset reach the planning.

A stream begins after the last record (``startingOffset`` latest, the default)
or at the first (earliest); its offset is the place of the last record it gave,
so a restart neither repeats nor loses one, and a record that is only half
written comes with a later batch.  Storage that cannot be read fails the query,
which may then be started again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import arrow, kernels
from ..functions.layout import PAGE_SIZE
from ..operators.journal import FIELDS
from .pages import PARTITION_BYTES, register
from .storage import Segment, Space, bounds, segments

NAME = "sectorlake_journal"
WINDOW, TAIL = 4 << 20, 64 << 10
_NAMES = [n for n, _ in kernels.USN_FIELDS]


@dataclass
class Stretch(InputPartition):
    part: Segment
    begin: int  # of the space, at a page
    end: int
    after: int
    until: int


def _stretches(parts: list[Segment], after: int, until: int, wide: int) -> list[Stretch]:
    """Partitions of the ranges that may hold records after ``after``, up to ``until``."""
    out = []
    for s in parts:
        first = max(0, (after - s.base) // PAGE_SIZE * PAGE_SIZE)
        for at in range(first, s.size, wide):
            if s.base + at <= until:
                out.append(Stretch(s, s.base + at, s.base + min(at + wide, s.size), after, until))
    return out


def _batches(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    """Records of a stretch, window by window; one that reaches past a window is
    read with the next, one past the stretch belongs to it."""
    space, at = Space(path, 0, [part.part]), part.begin
    while at < part.end:
        size = min(WINDOW, part.end - at)
        extra = min(TAIL, part.part.end - at - size)
        body = pa.array([space.read(at, size + extra)], pa.binary())
        rows = kernels.usn_records(np.array([at]), body)
        offset = rows["offset"]
        mine = (offset < at + size) & (offset > part.after) & (offset <= part.until)
        if mine.any():
            keep = np.flatnonzero(mine)
            yield arrow.batch(kernels.USN_FIELDS, {k: [v[i] for i in keep] if isinstance(v, list) else v[keep] for k, v in rows.items()})
        inside = int(np.searchsorted(offset, at + size))  # the last of these may reach into the next window
        last = int(offset[inside - 1] + rows["length"][inside - 1]) if inside else 0
        at = max(at + size, -(-last // 8) * 8)
    space.close()


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.low, self.high = options["path"], int(options.get("from", 0)), (1 << 63) - 1
        self.wide = max(1, int(options.get("partitionBytes", PARTITION_BYTES)) // PAGE_SIZE) * PAGE_SIZE

    def pushFilters(self, filters: list) -> Iterator:
        self.low, self.high, rest = bounds(filters, "offset", self.low, self.high)
        yield from rest

    def partitions(self) -> list[Stretch]:
        parts = [s for s in segments(self.path) if s.end > self.low]
        return _stretches(parts, self.low - 1, self.high, self.wide)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)


class JournalTail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.earliest = options["path"], options.get("startingOffset", "latest").lower() == "earliest"
        self.known = -1

    def _last(self) -> int:
        """Offset of the last record: from the end backwards, a window at a time."""
        for s in reversed(segments(self.path)):
            end = s.size
            while end > 0 and s.end > self.known:
                begin = max(0, end - WINDOW) // PAGE_SIZE * PAGE_SIZE
                last = max((int(o) for b in _batches(self.path, Stretch(s, s.base + begin, s.base + end, -1, s.end)) for o in b.column(0).to_numpy()), default=None)
                if last is not None:
                    self.known = max(self.known, last)
                    return self.known
                end = begin
        return self.known

    def initialOffset(self) -> dict:
        return {"after": -1 if self.earliest else self._last()}

    def latestOffset(self) -> dict:
        return {"after": self._last()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        parts = [s for s in segments(self.path) if s.end > start["after"]]
        return _stretches(parts, start["after"], end["after"], PARTITION_BYTES)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options)

    def streamReader(self, schema) -> JournalTail:
        return JournalTail(self.options)


def read_journal(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark, JournalSource)
    return spark.read.format(NAME).options(**options).load(path)
