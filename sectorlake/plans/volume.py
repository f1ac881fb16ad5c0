"""A whole volume from the tables, written as a space of page files.

Records: 0 the record table itself (its runs in fragments, the later ones named
by an attribute list in record 13), 5 the root, 11 $Extend, 12 $UsnJrnl, 14
System Volume Information, 16+ regions, 24+ snapshot stores, 32+ nations, 64 + 2c
customers, 65 + 2o orders.  Directories have an index root with two entries and
index pages with the others.  Events are the journal, behind a sparse head.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.columns import to_filetime
from ..functions.layout import CLUSTER, EPOCH, VSS_HEADER
from ..session import fresh_path, until_exit
from ..sources.pages import dealt, write_pages
from . import encode

EVENTS_A_PAGE, SPARSE_HEAD, ENTRIES_A_PAGE, PAGES_A_CUSTOMER, LEAST_FRAGMENT = 40, 1000, 24, 3, 256
#: Event types as journal reasons.
KINDS = {"click": 1 << 8, "view": 1 << 1, "purchase": (1 << 31) | 1, "signup": 1 << 12, "logout": 1 << 9}
STORE_IDENTIFIER = encode.guid(77)
#: Index entries are ten years younger than the files, so all are plausible.
INDEX_SHIFT = 3653 * 864_000_000_000
_made: dict[tuple[str, str], str] = {}


def made(df: DataFrame, make, kinds: list[tuple[str, pa.DataType]], rows: int = 1024, then: arrow.Step | None = None) -> DataFrame:
    """Rows of df, so many at a time, through an encoder that gives tuples of the
    columns ``kinds``; with ``then``, what that step makes of them in the same worker."""

    def kernel(part: pa.RecordBatch) -> dict:
        made_ = [r for x in part.to_pylist() for r in make(x)]
        cols = list(zip(*made_, strict=True)) if made_ else [()] * len(kinds)
        return dict(zip((n for n, _ in kinds), cols, strict=True))

    return arrow.chained(df, arrow.Step(kinds, kernel, rows), then) if then else arrow.mapped(df, kinds, kernel, rows=rows)


RAW = [("entry", pa.int64()), ("raw", pa.binary())]
PAGES = [("offset", pa.int64()), ("data", pa.binary())]


def _sizes(spark: SparkSession, d: str) -> dict[str, int]:
    top = lambda t, c: int(spark.read.parquet(f"{d}/{t}.parquet").agg(F.coalesce(F.max(c), F.lit(0))).first()[0])
    entries = 66 + 2 * max(top("customer", "c_custkey"), top("orders", "o_orderkey"))
    clusters = -(-entries // 4)
    wide = max(LEAST_FRAGMENT, -(-clusters // 64))
    fragments = -(-clusters // wide)
    out = {"clusters": clusters, "wide": wide, "fragments": fragments, "mft": 64}
    out["index"] = out["mft"] + fragments * wide
    out["customers"] = out["index"] + 64 * 1024
    out["journal"] = out["customers"] + PAGES_A_CUSTOMER * (top("customer", "c_custkey") + 2)
    out["pages"] = top("events", "event_id") // EVENTS_A_PAGE + 1
    out["catalog"] = out["journal"] + out["pages"] + 16
    out["end"] = out["catalog"] + 16
    return out


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """(entry, parent, name, is_dir, ft, size) of everything in the tree."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    fixed = spark.createDataFrame(
        [(5, 5, ".", True), (11, 5, "$Extend", True), (12, 11, "$UsnJrnl", False), (14, 5, "System Volume Information", True)], "entry long, parent long, name string, is_dir boolean"
    ).selectExpr("entry", "parent", "name", "is_dir", f"{EPOCH}L AS ft", "0L AS size")
    stores = made(t("region").select("r_regionkey"), lambda r: [(24 + r["r_regionkey"], 14, store_name(r["r_regionkey"]), False, EPOCH, 0)], [
        ("entry", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("is_dir", pa.bool_()), ("ft", pa.int64()), ("size", pa.int64())])
    return (
        fixed.union(stores)
        .union(t("region").selectExpr("16L + r_regionkey", "5L", "r_name", "true", f"{EPOCH}L", "0L"))
        .union(t("nation").selectExpr("32L + n_nationkey", "16L + n_regionkey", "n_name", "true", f"{EPOCH}L", "0L"))
        .union(t("customer").selectExpr("64L + 2 * c_custkey", "32L + c_nationkey", "c_name", "true", f"{EPOCH}L", "0L"))
        .union(t("orders").select(F.col("o_orderkey") * 2 + 65, F.col("o_custkey") * 2 + 64, F.concat(F.lit("order-"), F.col("o_orderkey")), F.lit(False), to_filetime(F.col("o_orderdate")), F.floor("o_totalprice").cast("long")))
    )


def store_name(region: int) -> str:
    from ..sources.snapshots import guid_text

    return guid_text(encode.guid(region)) + guid_text(STORE_IDENTIFIER)


def _index_place(z: dict[str, int], entry: int) -> int:
    return z["index"] + entry * 1024 if entry < 64 else z["customers"] + (entry - 64) // 2 * PAGES_A_CUSTOMER


def _records(spark: SparkSession, nodes: DataFrame, z: dict[str, int]) -> DataFrame:
    """(offset, data) of the records, in order.  What is dealt out are the rows
    that records are made of; directories need two of their entries and the number."""
    below = _below(nodes).select(F.col("parent").alias("entry"), F.slice("below", 1, 2).alias("below"), F.size("below").alias("n"))
    dirs = nodes.where("is_dir").join(below, "entry", "left")
    files = nodes.where("not is_dir").select("*", F.lit(None).cast(below.schema["below"].dataType).alias("below"), F.lit(0).alias("n"))
    own = spark.createDataFrame(_table_records(z), "entry long, raw binary")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in files.schema if f.name != "entry"]
    every = dirs.select(*files.columns, F.lit(None).cast("binary").alias("raw")).union(files.withColumn("raw", F.lit(None).cast("binary"))).union(own.select("entry", *none, "raw"))
    runs = [(None, SPARSE_HEAD), (z["journal"], min(3, z["pages"]))] + ([(z["journal"] + 8, z["pages"] - 3)] if z["pages"] > 3 else [])
    total = SPARSE_HEAD + z["pages"]

    def make(r: dict) -> list[tuple]:
        if r["raw"] is not None:
            return [(r["offset"], r["raw"])]
        e, ft, t0 = r["entry"], r["ft"], (EPOCH,) * 4
        name = encode.name_body(r["parent"], 5 if r["parent"] == 5 else 1, (ft,) * 4, r["size"], r["name"])
        streams = []
        if r["is_dir"]:
            inner = [(c["e"], 1, encode.name_body(e, 5 if e == 5 else 1, (c["ft"] + INDEX_SHIFT,) * 4, c["size"], c["name"])) for c in r["below"] or []]
            streams.append(encode.index_root(inner))
            pages = -(-max(0, (r["n"] or 0) - 2) // ENTRIES_A_PAGE)
            if pages:
                streams.append(encode.mapped(21, "$I30", [(_index_place(z, e), pages)], (0, pages - 1), pages * CLUSTER, kind=160))
        elif e == 12:
            streams += [encode.mapped(5, "$J", runs, (0, total - 1), total * CLUSTER, flags=1 << 15), encode.resident(6, "$Max", bytes(32))]
        elif 24 <= e < 32:
            streams.append(encode.resident(3, "", encode.store_file(STORE_IDENTIFIER, 4096 * (e - 23), encode.guid(e - 24), 1 << (e - 24))))
        else:
            streams.append(encode.mapped(3, "", [(50, r["size"] // CLUSTER + 1)], (0, r["size"] // CLUSTER), r["size"]))
        return [(r["offset"], encode.record(e, 5 if e == 5 else 1, (ft, ft, ft, ft) if e > 63 else t0, [name], streams, r["is_dir"]))]

    fragment = F.floor(F.col("entry") / (4 * z["wide"]))
    inside = F.col("entry") - fragment * (4 * z["wide"])
    offset = (F.lit(z["mft"]) + (z["fragments"] - 1 - fragment) * z["wide"]) * CLUSTER + inside * 1024
    return made(dealt(every, offset, z["index"] * CLUSTER), make, PAGES)


def _below(nodes: DataFrame) -> DataFrame:
    """(parent, below): the entries of each directory, in order."""
    return nodes.where("entry <> 5").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(F.col("entry").alias("e"), "name", "ft", "size"))).alias("below"))


def _index_pages(nodes: DataFrame, z: dict[str, int]) -> DataFrame:
    below = _below(nodes).where(F.size("below") > 2)
    place = F.when(F.col("parent") < 64, z["index"] + F.col("parent") * 1024).otherwise(z["customers"] + F.floor((F.col("parent") - 64) / 2) * PAGES_A_CUSTOMER)

    def make(r: dict) -> list[tuple]:
        e, rest, out = r["parent"], r["below"][2:], []
        for i in range(0, len(rest), ENTRIES_A_PAGE):
            inner = [(c["e"], 1, encode.name_body(e, 5 if e == 5 else 1, (c["ft"] + INDEX_SHIFT,) * 4, c["size"], c["name"])) for c in rest[i : i + ENTRIES_A_PAGE]]
            out.append(((_index_place(z, e) + i // ENTRIES_A_PAGE) * CLUSTER, encode.index_page(inner, [])))
        return out

    return made(dealt(below, place * CLUSTER, (z["journal"] - z["index"]) * CLUSTER), make, PAGES, rows=64)


def _table_records(z: dict[str, int]) -> list[tuple[int, bytes]]:
    """The records that describe the record table."""
    wide, n, t0 = z["wide"], z["fragments"], (EPOCH,) * 4
    place = lambda i: z["mft"] + (n - 1 - i) * wide
    length = [min(wide, z["clusters"] - i * wide) for i in range(n)]
    size, name = z["clusters"] * CLUSTER, encode.name_body(5, 5, t0, 0, "$MFT")
    first = encode.mapped(1, "", [(place(0), length[0])], (0, length[0] - 1), size)
    if n == 1:
        return [(0, encode.record(0, 1, t0, [name], [first]))]
    later = encode.mapped(2, "", [(place(i), length[i]) for i in range(1, n)], (length[0], z["clusters"] - 1), 0, 0)
    named = encode.attribute_list([(16, 0, 0, 0), (128, 1, 0, 0), (128, 2, 13, length[0])])
    return [(0, encode.record(0, 1, t0, [name], [first], lists=[named])), (13, encode.record(13, 1, None, [], [later], base=1 << 48))]


def build(spark: SparkSession, d: str) -> str:
    """The folder of the volume of these tables, written once for an application."""
    key = (spark.sparkContext.applicationId, d)
    if key in _made:
        return _made[key]
    z, path = _sizes(spark, d), fresh_path(spark, "volume")
    nodes = _nodes(spark, d)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", to_filetime(F.col("ts")).alias("ft"), "user_id", "event_type", F.floor(F.col("event_id") / EVENTS_A_PAGE).alias("page"))
    pages = events.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("event_id", "ft", "user_id", "event_type"))).alias("es"))
    journal = made(dealt(pages, F.col("page") * CLUSTER, z["pages"] * CLUSTER), lambda r: [_journal_page(z, r)], PAGES, rows=64)
    regions = sorted(r[0] for r in spark.read.parquet(f"{d}/region.parquet").select("r_regionkey").collect())  # a handful
    for part in (_records(spark, nodes, z), _index_pages(nodes, z), journal):
        write_pages(part, path, packed=True, ordered=True)
    write_pages(spark.createDataFrame(_fixed_pages(z, regions), "offset long, data binary"), path, packed=True)
    until_exit(spark, path)
    _made[key] = path
    return path


def _journal_page(z: dict[str, int], r: dict) -> tuple[int, bytes]:
    at = (SPARSE_HEAD + r["page"]) * CLUSTER
    out = b""
    for x in r["es"]:
        parent = 64 + 2 * x["user_id"]
        out += encode.usn(x["event_id"] + 1000, 1, parent, 1 + x["event_id"] % 2, at + len(out) + 1, x["ft"], KINDS.get(x["event_type"], 1 << 15), f"event-{x['event_id']}.log", 1 << x["event_id"] % 3)
    place = z["journal"] + (r["page"] if r["page"] < 3 else r["page"] + 5)
    return place * CLUSTER, out.ljust(CLUSTER, b"\0")


def _fixed_pages(z: dict[str, int], regions: list[int]) -> list[tuple[int, bytes]]:
    """Boot sector and snapshot catalogues: two blocks, of which the second leads back to the first."""
    sectors = (z["end"] + 64) * CLUSTER // 512
    catalog = [z["catalog"] * CLUSTER, (z["catalog"] + 8) * CLUSTER]
    half = [regions[: (len(regions) + 1) // 2], regions[(len(regions) + 1) // 2 :]]
    blocks = []
    for i, keys in enumerate(half):
        entries = [e for k in keys for e in (encode.snapshot_volume(1000 + k, encode.guid(k), EPOCH + k * 10**7), encode.snapshot_place(encode.guid(k), tuple(k * 10 + j for j in range(7))))]
        blocks.append((catalog[i], encode.snapshot_block(STORE_IDENTIFIER, catalog[i], catalog[1 - i], entries)))
    mft = z["mft"] + (z["fragments"] - 1) * z["wide"]
    return [(0, encode.boot_sector(mft, sectors, serial=42)), (VSS_HEADER, encode.snapshot_header(catalog[0])), *blocks]
