"""Raw bytes as rows, and rows as raw bytes.

``sectorlake_pages`` reads a space (see storage) in blocks: (offset, data).
Options: blockSize (4096), overlap (0: bytes of the next block that follow a
block's own, for records that cross), imageOffset (0), partitionBytes (32 MiB).
Blocks end in zeros past the end; ranges that no file holds are not read.
Filters on offset reach the planning, so other ranges are not opened.

Writing (offset, data) rows gives a folder of such files, with the option packed
of packed ones.  Rows of a partition are taken in the order they come in; a gap
of up to GAP bytes is filled with zeros, any other begins a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.layout import CLUSTER, PAGE_SIZE
from .storage import Packer, Segment, Space, bounds, file_system

NAME = "sectorlake_pages"
PARTITION_BYTES, BATCH_BYTES, GAP, FILE_BYTES = 32 << 20, 4 << 20, 64 << 10, 64 << 20
_SCHEMA = pa.schema([("offset", pa.int64()), ("data", pa.binary())])


@dataclass
class Span(InputPartition):
    begin: int
    end: int
    parts: list[Segment]


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shift = options["path"], int(options.get("imageOffset", 0))
        self.block, self.overlap = int(options.get("blockSize", PAGE_SIZE)), int(options.get("overlap", 0))
        self.wide = max(1, int(options.get("partitionBytes", PARTITION_BYTES)) // self.block) * self.block
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters: list) -> Iterator:
        self.low, self.high, rest = bounds(filters, "offset", self.low, self.high)
        yield from rest

    def partitions(self) -> list[Span]:
        space, out = Space(self.path, self.shift), []
        for a, b in space.dense():
            first = max(a // self.block, -(-self.low // self.block)) * self.block
            if out and first < out[-1].end:
                first = out[-1].end  # a block that two files share
            last = min(b, self.high // self.block * self.block + self.block)
            for begin in range(first, last, self.wide):
                end = min(begin + self.wide, last)
                near = [s for s in space.parts if s.base - self.shift < end + self.block + self.overlap and s.end - self.shift > begin]
                out.append(Span(begin, -(-end // self.block) * self.block, near))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        space = Space(self.path, self.shift, partition.parts)
        step = max(1, BATCH_BYTES // (self.block + self.overlap)) * self.block
        for begin in range(partition.begin, partition.end, step):
            end = min(begin + step, partition.end)
            body = space.read(begin, end - begin + self.overlap)
            at = range(begin, end, self.block)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([body[o - begin : o - begin + self.block + self.overlap] for o in at], pa.binary())], schema=_SCHEMA)
        space.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PagesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, packed: bool = False):
        self.path, self.packed = path, packed

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, place = file_system(self.path)
        fs.create_dir(place, recursive=True)
        done, base, size, sink, temporary = [], None, 0, None, ""

        def flush() -> None:
            sink.close()
            name = f"{place}/0x{base:016x}" + (f"-{size}.packed" if self.packed else ".bin")
            fs.move(temporary, name)  # an attempt that is run again gives the same file
            done.append(name)

        for part in batches:
            for offset, data in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("offset", "data")), strict=True):
                gap = offset - base - size if base is not None else 0
                if base is not None and (gap < 0 or gap > GAP or size + gap + len(data) > FILE_BYTES):
                    flush()
                    base = None
                if base is None:
                    base, size, gap, temporary = offset, 0, 0, f"{place}/.{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(temporary)
                    sink = Packer(stream) if self.packed else stream
                put = sink.add if self.packed else sink.write
                if gap:
                    put(bytes(gap))
                put(data)
                size += gap + len(data)
        if base is not None:
            flush()
        return Written(done)

    def abort(self, messages: list) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for name in m.files if m else []:
                fs.delete_file(name)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "offset long, data binary"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        return PagesWriter(self.options["path"], self.options.get("packed", "false").lower() == "true")


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_pages(spark: SparkSession, path: str, **options: int) -> DataFrame:
    register(spark, PagesSource)
    return spark.read.format(NAME).options(**options).load(path)


def read_disk(spark: SparkSession, path: str, cluster: int = CLUSTER, **options: int) -> DataFrame:
    """(lcn, data): the clusters of an image."""
    pages = read_pages(spark, path, blockSize=cluster, **options)
    return pages.select((F.col("offset") / cluster).cast("long").alias("lcn"), "data")


def read_index(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(page, data): the pages of a raw index stream."""
    return read_pages(spark, path, blockSize=PAGE_SIZE, **options).withColumnRenamed("offset", "page")


def read_windows(spark: SparkSession, path: str, cluster: int = CLUSTER, **options: int) -> DataFrame:
    """(base, data): windows of a raw device to carve, each with a cluster of the next."""
    return read_pages(spark, path, blockSize=255 * cluster, overlap=cluster, **options).withColumnRenamed("offset", "base")


def write_pages(pages: DataFrame, path: str, partitions: int = 8, packed: bool = False, ordered: bool = False) -> None:
    """(offset, data) rows as a folder of files in order of offset.  ``ordered``:
    the rows of each partition are in order already, and nothing is shuffled."""
    register(pages.sparkSession, PagesSource)
    placed = pages.select("offset", "data")
    if not ordered:
        placed = placed.repartitionByRange(partitions, "offset").sortWithinPartitions("offset")
    placed.write.format(NAME).mode("append").option("packed", str(packed).lower()).save(path)


def dealt(rows: DataFrame, offset: Column, size: int, area: int = 32 << 20) -> DataFrame:
    """rows of a space of ``size`` bytes with their ``offset``, each area of the
    space in one partition and in order, so what is made of them is ordered."""
    n = max(1, min(2000, -(-size // area)))
    return rows.withColumn("offset", offset.cast("long")).repartition(n, F.floor(F.col("offset") / area)).sortWithinPartitions("offset")
