"""Snapshot catalogues of a volume: ``sectorlake_vss`` gives one row for each
128-byte entry, (catalog, identifier, offset, data).

The chain of catalogue blocks starts at the volume header and is followed on
the driver, block headers alone; a block that was met before ends it.  Each
block is a partition.  Option: imageOffset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.layout import STRUCTS, VSS_BLOCK, VSS_ENTRY, VSS_HEADER
from .pages import register
from .storage import Segment, Space

NAME = "sectorlake_vss"
_SCHEMA = pa.schema([("catalog", pa.int64()), ("identifier", pa.string()), ("offset", pa.int64()), ("data", pa.binary())])


def guid_text(raw: bytes) -> str:
    """Sixteen bytes as {8-4-4-4-12}."""
    parts = raw[3::-1], raw[5:3:-1], raw[7:5:-1], raw[8:10], raw[10:16]
    return "{" + "-".join(p.hex() for p in parts) + "}"


def _number(struct: str, field: str, data: bytes) -> int:
    at, _ = STRUCTS[struct][field]
    return int.from_bytes(data[at : at + 8], "little")


@dataclass
class Block(InputPartition):
    offset: int
    parts: list[Segment]


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shift = options["path"], int(options.get("imageOffset", 0))

    def partitions(self) -> list[Block]:
        space, out, seen = Space(self.path, self.shift), [], set()
        at = _number("VSS_VOLUME_HEADER", "CatalogOffset", space.read(VSS_HEADER, VSS_ENTRY))
        while 0 < at < space.size and at not in seen:
            seen.add(at)
            near = [s for s in space.parts if s.base - self.shift < at + VSS_BLOCK and s.end - self.shift > at]
            out.append(Block(at, near))
            at = _number("VSS_CATALOG_HEADER", "NextOffset", space.read(at, VSS_ENTRY))
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        space = Space(self.path, self.shift, partition.parts)
        body = space.read(partition.offset, VSS_BLOCK)
        spots = range(VSS_ENTRY, VSS_BLOCK, VSS_ENTRY)
        n = len(spots)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([partition.offset] * n, pa.int64()), pa.array([guid_text(body[:16])] * n, pa.string()), pa.array([partition.offset + s for s in spots], pa.int64()),
                pa.array([body[s : s + VSS_ENTRY] for s in spots], pa.binary()),
            ],
            schema=_SCHEMA,
        )
        space.close()


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "catalog long, identifier string, offset long, data binary"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def read_snapshots(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark, SnapshotSource)
    return spark.read.format(NAME).options(**options).load(path)
