"""File records of a raw record table or of a whole volume as rows: (entry, raw).

``sectorlake_mft`` options: image (false: the path is the table itself; true: a
volume, whose boot sector and first record say where the table lies), recordSize
(1024) and clusterSize (4096) for a raw table, imageOffset (0), partitionBytes.

Planning reads the boot sector and the records that describe the table itself
(those named by its attribute list too); then each partition reads its range of
entries from the extents that hold it.  Filters on entry reach the planning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import kernels
from ..functions.layout import ATTRIBUTE_LIST, CLUSTER, DATA, MAX_PIECES, RECORD_SIZE, STRUCTS
from .pages import BATCH_BYTES, PARTITION_BYTES, register
from .storage import Segment, Space, bounds

NAME = "sectorlake_mft"
_SCHEMA = pa.schema([("entry", pa.int64()), ("raw", pa.binary())])
_MOST_SECTOR = 4096


@dataclass(frozen=True)
class Volume:
    """What the boot sector says."""

    sector: int
    cluster: int
    sectors: int
    mft: int
    record: int

    @classmethod
    def of(cls, data: bytes) -> Volume:
        def get(name: str, signed: bool = False) -> int:
            at, kind = STRUCTS["NTFS_BOOT_SECTOR"][name]
            return int.from_bytes(data[at : at + int(kind[1:]) // 8], "little", signed=signed)

        sector, cluster, size = get("Sector_size"), get("_cluster_size") * get("Sector_size"), get("_mft_record_size", True)
        if get("Magic") != 0xAA55:
            raise ValueError("Invalid magic")
        if cluster not in [1 << i for i in range(17)]:
            raise ValueError(f"Invalid cluster size {cluster:x}")
        if not sector or sector % 512:
            raise ValueError("Invalid sector_size")
        if not get("_volume_size") * sector // cluster:
            raise ValueError("Volume size is 0")
        return cls(sector, cluster, get("_volume_size"), get("_mft_cluster") * cluster, size * cluster if size > 0 else 1 << -size)


class Table:
    """A record table: (offset in the table, offset in the space, bytes) of its extents, in order."""

    def __init__(self, space: Space, record: int, extents: list[tuple[int, int, int]], size: int):
        self.space, self.record, self.extents, self.size = space, record, extents, size

    def read(self, begin: int, end: int) -> bytes:
        out = bytearray(end - begin)
        for at, place, n in self.extents:
            a, b = max(begin, at), min(end, at + n)
            if a < b and place >= 0:
                out[a - begin : b - begin] = self.space.read(place + a - at, b - a)
        return bytes(out)


def _extents(pieces: list[dict], cluster: int) -> tuple[list[tuple[int, int, int]], int]:
    """Extents and size of the stream of these pieces."""
    pieces = sorted(pieces, key=lambda a: a["vcn_start"])[:MAX_PIECES]
    size, ready, unit = (next((a[k] for a in pieces if a[k]), 0) for k in ("size", "initialized", "unit"))
    runs = [(r["lcn"], r["rel"], r["len"]) for a in pieces for r in a["runs"] or []]
    rows = kernels.mapping(runs, pieces[0]["flags"], unit, cluster, size, ready)
    return [(begin, -1 if sparse else lcn * cluster, n) for _, _, lcn, sparse, _, _, _, begin, n in rows if n > 0], size


def bootstrap(space: Space, volume: Volume) -> Table:
    """The record table of a volume, from its first record: the last $DATA there,
    then, with an attribute list, all pieces that the list names."""
    first = kernels.record(space.read(volume.mft, volume.record))
    if first["error"]:
        raise ValueError(first["error"])
    own = [a for a in first["attributes"] if a["type"] == DATA]
    if not own:
        raise ValueError("$DATA attribute not found for $MFT")
    if own[-1]["resident"]:
        raise ValueError("$DATA of $MFT is resident")
    table = Table(space, volume.record, *_extents([own[-1]], volume.cluster))
    lists = [a for a in first["attributes"] if a["type"] == ATTRIBUTE_LIST]
    if not lists:
        return table
    pieces = [a for x in lists for a in _members(table, volume, x, first["number"]) if a["type"] == DATA] + own
    # a list may name a piece that is here as well
    seen: dict[int, dict] = {}
    for a in pieces:
        if not a["resident"] and a["name"] == "":
            seen.setdefault(a["vcn_start"], a)
    return Table(space, volume.record, *_extents(list(seen.values()), volume.cluster))


def _members(table: Table, volume: Volume, attribute: dict, number: int) -> list[dict]:
    """Attributes that a list names in other records, up to the first that cannot be found."""
    body = attribute["content"]
    if not attribute["resident"]:
        found, size = _extents([attribute], volume.cluster)
        body = Table(table.space, volume.record, found, size).read(0, min(size, 1 << 20))
    entries, out = kernels.list_entries(pa.array([body], pa.binary())), []
    for ref, kind, attr in zip(*(entries[k].tolist() for k in ("ref", "type", "attr")), strict=True):
        if ref == number:
            continue
        other = kernels.record(table.read(ref * volume.record, (ref + 1) * volume.record))
        hit = next((a for a in other["attributes"] if a["type"] == kind and a["attr"] == attr), None)
        if hit is None:
            break
        out.append(hit)
    return out


@dataclass
class Entries(InputPartition):
    first: int
    last: int
    extents: list[tuple[int, int, int]]
    parts: list[Segment]
    shift: int
    record: int


class MftReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high = options, 0, (1 << 48) - 1

    def pushFilters(self, filters: list) -> Iterator:
        self.low, self.high, rest = bounds(filters, "entry", self.low, self.high)
        yield from rest

    def _table(self) -> Table:
        o = self.options
        space = Space(o["path"], int(o.get("imageOffset", 0)))
        if o.get("image", "false").lower() == "true":
            return bootstrap(space, Volume.of(space.read(0, _MOST_SECTOR)))
        return Table(space, int(o.get("recordSize", RECORD_SIZE)), [(0, 0, space.size)], space.size)

    def partitions(self) -> list[Entries]:
        table, out = self._table(), []
        wide = max(1, int(self.options.get("partitionBytes", PARTITION_BYTES)) // table.record)
        dense = table.space.dense()
        for at, place, n in table.extents:
            if place < 0:
                continue
            for a, b in dense:
                lo, hi = max(place, a), min(place + n, b)  # records that no file holds are not read
                if lo >= hi:
                    continue
                first, last = (lo - place + at) // table.record, -(-(hi - place + at) // table.record)
                first, last = max(first, self.low, out[-1].last if out else 0), min(last, self.high + 1, table.size // table.record)
                for f in range(first, last, wide):
                    end = min(f + wide, last)
                    near = [e for e in table.extents if e[0] < end * table.record and e[0] + e[2] > f * table.record]
                    spots = [(p + table.space.shift, p + table.space.shift + k) for _, p, k in near if p >= 0]
                    parts = [s for s in table.space.parts if any(s.base < y and s.end > x for x, y in spots)]
                    out.append(Entries(f, end, near, parts, table.space.shift, table.record))
        return out

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        space, size = Space(self.options["path"], partition.shift, partition.parts), partition.record
        table = Table(space, size, partition.extents, 0)
        step = max(1, BATCH_BYTES // size)
        for first in range(partition.first, partition.last, step):
            last = min(first + step, partition.last)
            body = table.read(first * size, last * size)
            raw = [body[i * size : (i + 1) * size] for i in range(last - first)]
            live = [i for i, r in enumerate(raw) if r[:64].strip(b"\0")]  # zeros are no record
            yield pa.RecordBatch.from_arrays([pa.array([first + i for i in live], pa.int64()), pa.array([raw[i] for i in live], pa.binary())], schema=_SCHEMA)
        space.close()


class MftSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "entry long, raw binary"

    def reader(self, schema) -> MftReader:
        return MftReader(self.options)


def read_mft(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Records of a raw record table."""
    register(spark, MftSource)
    return spark.read.format(NAME).options(**options).load(path)


def read_volume(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Records of a volume."""
    return read_mft(spark, path, image="true", **options)


def open_volume(path: str, shift: int = 0) -> tuple[Space, Volume]:
    """A volume's bytes and what its boot sector says, on the driver."""
    space = Space(path, shift)
    return space, Volume.of(space.read(0, _MOST_SECTOR))
