"""Stream content: pieces to extents, extents to chunks of bytes, reads, hashes, run trees.

A stream is (entry, type, name).  Its bytes exist only as chunks of at most
CHUNK_CLUSTERS clusters or one compressed unit; nothing holds a whole stream
but ``contents``, which is for streams that fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrow, codecs, kernels
from ..functions.layout import CLUSTER, MAX_PIECES
from ..sources.storage import Image, Space

STREAM = ["entry", "type", "name"]
CHUNK_CLUSTERS = 16
ZEROS = bytes(1 << 20)


# ---- extents ---------------------------------------------------------------

def pieces(attributes: DataFrame) -> DataFrame:
    """One row for each non-resident stream: the runs of its pieces joined, each
    piece following the one before from cluster 0 on, at most MAX_PIECES; the
    sizes and the unit are the first that any piece states."""
    order = Window.partitionBy(*STREAM).orderBy("vcn_start", "ord")
    rows = attributes.where("not resident").withColumn("again", F.lag("vcn_start").over(order).eqNullSafe(F.col("vcn_start"))).where("not again")
    before = F.lag("vcn_end").over(order)
    rows = rows.withColumn("gap", F.when(F.coalesce(F.try_add(before, F.lit(1).cast("long")), F.lit(0).cast("long")) == F.col("vcn_start"), 0).otherwise(1))
    rows = rows.withColumn("broken", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.row_number().over(order))
    part = F.struct("vcn_start", "attr", "flags", "size", "initialized", "unit", "runs")
    one = rows.where((F.col("broken") == 0) & (F.col("n") <= MAX_PIECES)).groupBy(*STREAM).agg(F.array_sort(F.collect_list(part)).alias("p"))
    first = lambda k: F.coalesce(F.get(F.filter(F.transform("p", lambda x: x[k]), lambda v: v != 0), F.lit(0)), F.lit(0))
    head = F.get("p", F.lit(0))
    return one.select(
        *STREAM, head["attr"].alias("attr"), head["flags"].alias("flags"), first("size").cast("long").alias("size"), first("initialized").cast("long").alias("initialized"),
        first("unit").cast("int").alias("unit"), F.flatten(F.transform("p", lambda x: x["runs"])).alias("runs"),
    )


_EXTENT = [
    ("entry", pa.int64()), ("type", pa.int64()), ("name", pa.string()), ("attr", pa.int32()), ("size", pa.int64()), ("initialized", pa.int64()), ("ord", pa.int32()),
    ("cluster", pa.int64()), ("clusters", pa.int64()), ("lcn", pa.int64()), ("is_sparse", pa.bool_()), ("unit", pa.int64()), ("stored", pa.int64()), ("part", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
]


def extents(attributes: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """The extents of non-resident streams in order: where a range of the file
    lies on disk, sparse ones, places of compressed units (unit > 0), and the
    sparse ends up to the initialised and the actual size (clusters = 0).  Runs
    past the initialised size have no length."""

    def kernel(part: pa.RecordBatch) -> dict:
        rows = []
        for r in part.to_pylist():
            run = [(x["lcn"], x["rel"], x["len"]) for x in r["runs"]]
            for i, e in enumerate(kernels.mapping(run, r["flags"], r["unit"], cluster, r["size"], r["initialized"])):
                rows.append((r["entry"], r["type"], r["name"], r["attr"], r["size"], r["initialized"], i, *e))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_EXTENT)
        return dict(zip((n for n, _ in _EXTENT), cols, strict=True))

    return arrow.mapped(pieces(attributes), _EXTENT, kernel)


def ranges(found: DataFrame) -> DataFrame:
    """(entry, type, name, offset, length, is_sparse): a compressed unit is one range."""
    return found.where("part = 0 and length > 0").select(*STREAM, "offset", "length", "is_sparse")


def range_size(found: DataFrame) -> DataFrame:
    """Where the last range of each stream ends."""
    return found.groupBy(*STREAM).agg(F.max(F.col("offset") + F.col("length")).alias("end"))


def run_info(found: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """The tree of mappings of each stream as rows in order: the whole stream (level
    0), its runs (1), the places of a unit that lies in several (2), the end that
    was never initialised (0)."""
    first = Window.partitionBy(*STREAM).orderBy("ord")
    unit = Window.partitionBy(*STREAM, "cluster")
    rows = found.withColumns({"places": F.count("*").over(unit), "head": F.row_number().over(first) == 1})
    several = (F.col("unit") > 0) & (F.col("places") > 1)
    wide = F.when(F.col("unit") > 0, F.col("unit")).otherwise(F.col("clusters"))

    def row(level, kind, from_, to, length, compressed, sparse, size, reader, sub):
        return F.struct(
            F.lit(kind).alias("mapping"), F.lit(level).alias("level"), from_.cast("long").alias("from_offset"), to.cast("long").alias("to_offset"), length.cast("long").alias("length"),
            compressed.cast("long").alias("compressed_length"), sparse.alias("is_sparse"), F.lit(size).cast("long").alias("cluster_size"), reader.alias("reader"), F.lit(sub).alias("sub"),
        )

    no, zero = F.lit(False), F.lit(0)
    whole = row(0, "MappedReader", zero, zero, F.col("initialized"), zero, no, 1, F.lit("RangeReader"), 0)
    run = row(1, "MappedReader", F.col("cluster"), F.when(several, zero).otherwise(F.col("lcn")), wide, F.col("stored"), F.col("is_sparse"), cluster,
              F.when(F.col("is_sparse"), "NullReader").when(several, "RangeReader").otherwise("PagedReader"), 1)
    place = row(2, "MappedReader", F.col("part"), F.col("lcn"), F.col("clusters"), zero, no, cluster, F.lit("PagedReader"), 2)
    pad = row(0, "MappedReader", F.col("offset"), zero, F.col("length"), zero, F.lit(True), 1, F.lit("NullReader"), 3)
    is_pad = (F.col("clusters") == 0) & (F.col("offset") >= F.col("initialized"))
    listed = F.filter(
        F.array(F.when(F.col("head"), whole), F.when((F.col("clusters") > 0) & (F.col("part") == 0), run), F.when(several, place), F.when(is_pad, pad)), lambda r: r.isNotNull()
    )
    return rows.select(*STREAM, "ord", F.explode(listed).alias("r")).select(*STREAM, "ord", "r.*")


def run_text(info: DataFrame) -> DataFrame:
    """run_info with each row as a line of text."""
    marks = F.concat(F.when(F.col("is_sparse"), "Sparse ").otherwise(""), F.when(F.col("compressed_length") != 0, F.concat(F.lit("Compressed Length "), F.col("compressed_length"))).otherwise(""))
    text = F.concat(
        F.repeat(F.lit(" "), F.col("level")), F.lit(" "), F.col("level"), F.lit(" "), F.col("mapping"), F.lit(": FileOffset "), F.col("from_offset"), F.lit(" -> DiskOffset "), F.col("to_offset"),
        F.lit(" (Length "), F.col("length"), F.lit(", "), marks, F.lit(" Cluster "), F.col("cluster_size"), F.lit(") Delegate "), F.col("reader"),
    )
    return info.withColumn("text", text)


def disk_offsets(asked: DataFrame, found: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """asked (entry, type, name, offset) with the place on disk of that byte; null
    where it is sparse, compressed or past the end.  The stream's key joins, the
    range is a condition on what meets."""
    e = found.select(*STREAM, F.col("offset").alias("lo"), F.col("length").alias("n"), "lcn", "is_sparse", "unit")
    inside = (asked["offset"] >= e["lo"]) & (asked["offset"] < e["lo"] + e["n"])
    met = asked.alias("q").join(e.alias("e"), [F.col(f"q.{c}") == F.col(f"e.{c}") for c in STREAM] + [inside], "left")
    place = F.when((F.col("unit") == 0) & ~F.col("is_sparse"), F.col("lcn") * cluster + F.col("q.offset") - F.col("lo"))
    return met.select("q.*", place.alias("disk_offset"))


# ---- bytes -------------------------------------------------------------------

def chunks(attributes: DataFrame, disk: DataFrame | Image | None = None, cluster: int = CLUSTER) -> DataFrame:
    """(entry, type, name, attr, size, offset, length, data) of whole streams; data
    is null where they are sparse.

    ``disk`` (lcn, data) holds clusters; those it lacks read as zeros.  With an
    Image, chunks are read from it where they lie and no cluster is shuffled.
    Otherwise extents
    are exploded into clusters, joined once, and gathered into chunks, so one
    pass reads the disk, whatever the fragmentation.  Clusters compress well, so
    their shuffled size says little about their memory: they are never broadcast.
    """
    inside = attributes.where("resident").select(*STREAM, "attr", "size", F.lit(0).cast("long").alias("offset"), F.octet_length("content").cast("long").alias("length"), F.col("content").alias("data"))
    if isinstance(disk, Image):
        return inside.unionByName(_read(attributes, disk, cluster))
    found = extents(attributes, cluster).where("length > 0")
    sparse = found.where("is_sparse").select(*STREAM, "attr", "size", "offset", "length", F.lit(None).cast("binary").alias("data"))
    dense = found.where("not is_sparse")
    single = F.when(F.col("unit") > 0, F.col("clusters")).otherwise(F.ceil(F.col("length") / cluster))
    wanted = dense.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), single - 1)))
    group = F.when(F.col("unit") > 0, F.col("offset")).otherwise(F.col("offset") + F.floor(F.col("k") / CHUNK_CLUSTERS) * (CHUNK_CLUSTERS * cluster))
    wanted = wanted.select(
        *STREAM, "attr", "size", (F.col("unit") > 0).alias("packed"), group.alias("group"), (F.col("part") + F.col("k")).alias("i"), (F.col("offset") + F.col("length")).alias("end"), (F.col("lcn") + F.col("k")).alias("lcn")
    )
    if disk is None:
        got = wanted.withColumn("data", F.lit(None).cast("binary"))
    else:
        got = wanted.join(disk.select("lcn", "data").hint("merge"), "lcn", "left")
    one = got.groupBy(*STREAM, "attr", "size", "packed", "group").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("parts"), F.max("end").alias("end"))
    kinds = [("entry", pa.int64()), ("type", pa.int64()), ("name", pa.string()), ("attr", pa.int32()), ("size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]

    def kernel(part: pa.RecordBatch) -> dict:
        group, end, packed = (arrow.columns(part, c)[0].to_pylist() for c in ("group", "end", "packed"))
        parts = arrow.columns(part, "parts")[0]
        flat = parts.flatten().field("data").to_pylist()
        edge = parts.offsets.to_pylist()
        data = []
        for g, e, p, a, b in zip(group, end, packed, edge[:-1], edge[1:], strict=True):
            body = b"".join((x or b"").ljust(cluster, b"\0")[:cluster] for x in flat[a - edge[0] : b - edge[0]])
            if p:
                body = codecs.lznt1(body)[0] or b""
            want = e - g if p else min(e - g, len(body))
            data.append(body[:want].ljust(want, b"\0"))
        keys = {c: arrow.columns(part, c)[0] for c in (*STREAM, "attr", "size")}
        return {**keys, "offset": group, "length": [len(x) for x in data], "data": data}

    outside = arrow.mapped(one, kinds, kernel, rows=64)
    return inside.unionByName(sparse).unionByName(outside)


_CHUNK = [("entry", pa.int64()), ("type", pa.int64()), ("name", pa.string()), ("attr", pa.int32()), ("size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
AREA = 4 << 20


def _read(attributes: DataFrame, disk: Image, cluster: int) -> DataFrame:
    """The chunks of non-resident streams, read from an image.  What is shuffled
    says where they lie; an area of the image falls to one task, in order."""
    place = pa.list_(pa.struct([("lcn", pa.int64()), ("clusters", pa.int64())]))
    kinds = [*_CHUNK, ("packed", pa.bool_()), ("first", pa.int64()), ("places", place)]

    def placed(part: pa.RecordBatch) -> dict:
        rows = []
        for r in part.to_pylist():
            head = (r["entry"], r["type"], r["name"], r["attr"], r["size"])
            unit = None
            for _, clusters, lcn, sparse, wide, _, _, begin, n in kernels.mapping([(x["lcn"], x["rel"], x["len"]) for x in r["runs"]], r["flags"], r["unit"], cluster, r["size"], r["initialized"]):
                if n <= 0:
                    continue
                if sparse:
                    rows.append((*head, begin, n, False, None, None))
                elif wide:
                    if unit != begin:
                        rows.append((*head, begin, n, True, lcn, []))
                        unit = begin
                    rows[-1][-1].append((lcn, clusters))
                else:
                    for k in range(0, -(-n // cluster), CHUNK_CLUSTERS):
                        size = min(CHUNK_CLUSTERS * cluster, n - k * cluster)
                        rows.append((*head, begin + k * cluster, size, False, lcn + k, [(lcn + k, -(-size // cluster))]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        values = dict(zip((n for n, _ in kinds), cols, strict=True))
        values["places"] = [None if p is None else [{"lcn": a, "clusters": n} for a, n in p] for p in values["places"]]
        return values

    wanted = arrow.mapped(pieces(attributes), kinds, placed)
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.repartition(n, F.floor(F.col("first") * cluster / AREA)).sortWithinPartitions("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(disk.path, disk.shift)
        for part in arrow.pieces(batches, 64):
            data = []
            for length, packed, places in zip(*(c.to_pylist() for c in arrow.columns(part, "length", "packed", "places")), strict=True):
                if places is None:
                    data.append(None)
                    continue
                body = b"".join(space.read(p["lcn"] * cluster, p["clusters"] * cluster) for p in places)
                body = (codecs.lznt1(body)[0] or b"") if packed else body
                data.append(body[:length].ljust(length, b"\0"))
            yield arrow.batch([*_CHUNK, ("data", pa.binary())], {**{c: arrow.columns(part, c)[0] for c, _ in _CHUNK}, "data": data})
        space.close()

    return dealt.mapInArrow(run, arrow.ddl([*_CHUNK, ("data", pa.binary())]))


def in_order(found: DataFrame, kinds: list[tuple[str, pa.DataType]], consumer: Callable[[], object]) -> DataFrame:
    """Streams through a consumer that takes their chunks in order: its ``add(offset,
    length, data)`` and ``rows()`` give tuples of the columns after the stream's.

    Chunks are sorted in their partitions and pass one by one, so a stream may be
    larger than memory; it stays in one task.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select(*STREAM, "size", "offset", "length", "data").repartition(n, *STREAM).sortWithinPartitions(*STREAM, "offset")
    every = [("entry", pa.int64()), ("type", pa.int64()), ("name", pa.string()), *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out, held = None, None, [], 0

        def emit(rows: list) -> None:
            nonlocal held
            out.extend((*key, *r) for r in rows)
            held += sum(len(x) for r in rows for x in r if isinstance(x, bytes)) + len(rows)

        def flush() -> pa.RecordBatch:
            nonlocal held
            cols = list(zip(*out, strict=True))
            out.clear()
            held = 0
            return arrow.batch(every, dict(zip((k for k, _ in every), cols, strict=True)))

        for part in arrow.pieces(batches, 64):
            for e, t, nm, size, offset, length, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (e, t, nm) != key:
                    if now is not None:
                        emit(now.rows(True))
                    key, now = (e, t, nm), consumer(size)
                now.add(offset, length, data)
                emit(now.rows(False))
                if held > 4 << 20:
                    yield flush()
        if now is not None:
            emit(now.rows(True))
        if out:
            yield flush()

    return dealt.mapInArrow(run, arrow.ddl(every))


class _Digest:
    """Hashes of a stream, with zeros for what is sparse."""

    def __init__(self, size: int, names: tuple[str, ...]):
        self.size, self.at, self.hashes = size, 0, [hashlib.new(n) for n in names]

    def _feed(self, data: bytes) -> None:
        data = data[: max(0, self.size - self.at)]
        for h in self.hashes:
            h.update(data)
        self.at += len(data)

    def _zeros(self, until: int) -> None:
        while self.at < min(until, self.size):
            self._feed(ZEROS[: until - self.at])

    def add(self, offset: int, length: int, data: bytes | None) -> None:
        self._zeros(offset)
        if data is None:
            self._zeros(offset + length)
        elif offset + len(data) > self.at:
            self._feed(data[self.at - offset :])

    def rows(self, end: bool) -> list[tuple]:
        if not end:
            return []
        self._zeros(self.size)
        return [(self.at, *(h.hexdigest() for h in self.hashes))]


def digests(found: DataFrame, names: tuple[str, ...] = ("md5",)) -> DataFrame:
    """(entry, type, name, size, one column for each hash) of chunks' streams."""
    return in_order(found, [("size", pa.int64()), *((n, pa.string()) for n in names)], lambda size: _Digest(size, names))


class _Whole:
    def __init__(self, size: int):
        self.size, self.body = size, bytearray()

    def add(self, offset: int, length: int, data: bytes | None) -> None:
        self.body += bytes(max(0, offset - len(self.body)))
        self.body[offset : offset + length] = bytes(length) if data is None else data

    def rows(self, end: bool) -> list[tuple]:
        return [(self.size, bytes(self.body[: self.size].ljust(self.size, b"\0")))] if end else []


def contents(found: DataFrame) -> DataFrame:
    """(entry, type, name, size, data) of streams that each fit a row."""
    return in_order(found, [("size", pa.int64()), ("data", pa.binary())], _Whole)


class _Pages:
    """Pages of a stream; none where it is sparse as a whole."""

    def __init__(self, size: int, page: int):
        self.page, self.number, self.body, self.ready = page, 0, None, []

    def _turn(self, number: int) -> None:
        if self.body is not None and number != self.number:
            self.ready.append((self.number * self.page, bytes(self.body)))
            self.body = None
        self.number = number

    def add(self, offset: int, length: int, data: bytes | None) -> None:
        at = 0
        while data and at < len(data):
            number, spot = divmod(offset + at, self.page)
            self._turn(number)
            if self.body is None:
                self.body = bytearray(self.page)
            take = min(self.page - spot, len(data) - at)
            self.body[spot : spot + take] = data[at : at + take]
            at += take

    def rows(self, end: bool) -> list[tuple]:
        if end:
            self._turn(-1)
        out, self.ready = self.ready, []
        return out


def paged(found: DataFrame, page: int) -> DataFrame:
    """(entry, type, name, offset, data) in pages of a fixed size, zero-padded; dense ones alone."""
    return in_order(found, [("offset", pa.int64()), ("data", pa.binary())], lambda size: _Pages(size, page))


def read_at(asked: DataFrame, found: DataFrame, block: int = CHUNK_CLUSTERS * CLUSTER) -> DataFrame:
    """The bytes that each request (id, entry, type, name, offset, length) covers,
    as far as the stream reaches: (id, data).

    Requests and chunks are cut at multiples of ``block`` and meet by stream and
    block, so no range join is needed; sparse bytes are zeros.
    """
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.greatest(F.col("length"), F.lit(1)) - 1) / block)
    over = F.explode(F.sequence(first, last))
    q = asked.select("id", *STREAM, F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), over.alias("block"))
    c = found.select(*STREAM, F.col("offset").alias("at"), F.least(F.col("offset") + F.col("length"), F.col("size")).alias("stop"), "data", over.alias("block"))
    met = q.join(c, [*STREAM, "block"]).where((F.col("at") < F.col("hi")) & (F.col("stop") > F.col("lo")))
    begin = F.greatest("at", "lo", F.col("block") * block)
    end = F.least("stop", "hi", (F.col("block") + 1) * block)
    n = (end - begin).cast("int")
    piece = F.when(F.col("data").isNull(), F.unhex(F.repeat(F.lit("00"), n))).otherwise(F.substring("data", (begin - F.col("at") + 1).cast("int"), n))
    parts = met.where(begin < end).select("id", F.struct(begin.alias("begin"), F.hex(piece).alias("h")).alias("p"))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["h"]), ""))
    return asked.select("id").join(parts.groupBy("id").agg(whole.alias("data")), "id", "left").withColumn("data", F.coalesce("data", F.unhex(F.lit(""))))
