"""Change journal: scan, carve, last record, history, paths."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, kernels
from ..functions.columns import filetime, flag_names
from ..functions.layout import CLUSTER, DATA, USN_ATTRIBUTES, USN_REASONS, USN_SOURCES
from ..session import keep
from ..sources.storage import Image
from . import extents
from .paths import ERR, MISSING, PathOptions, linked, paths

FIELDS = arrow.ddl(kernels.USN_FIELDS)
JOURNAL_PATH, JOURNAL_STREAM = "$Extend/$UsnJrnl", "$J"


def _scanned(stretches: DataFrame, scan: Callable) -> DataFrame:
    def kernel(part: pa.RecordBatch) -> dict:
        return scan(arrow.numbers(part, "base"), arrow.columns(part, "data")[0])

    return arrow.mapped(stretches.select("base", "data"), kernels.USN_FIELDS, kernel, rows=64)


def scan(stretches: DataFrame) -> DataFrame:
    """(base, data) stretches to journal records; stretches are independent tasks."""
    return _scanned(stretches, kernels.usn_records)


def carve(windows: DataFrame) -> DataFrame:
    """Records anywhere in raw windows; windows may overlap, each record comes once."""
    return _scanned(windows, kernels.carve_usn).dropDuplicates(["offset"])


def of_stream(attributes: DataFrame, disk: DataFrame | Image, cluster: int = CLUSTER) -> DataFrame:
    """Records of the $J streams among attributes.  Sparse ranges are not read; a
    journal's records do not cross its 4 KiB pages, so chunks are scanned apart."""
    rows = attributes.where((F.col("type") == DATA) & (F.col("name") == JOURNAL_STREAM))
    found = extents.chunks(rows, disk, cluster).where("data is not null")
    return scan(found.select(F.col("offset").alias("base"), "data"))


def named(records: DataFrame) -> DataFrame:
    """records with their time, and the names of reasons, sources and file attributes, each sorted."""
    names = lambda c, table: F.array_join(flag_names(F.col(c), table, bits=True), ",")
    return records.withColumns({
        "ts": filetime(F.col("time")), "reasons": names("reason", USN_REASONS), "sources": names("source", USN_SOURCES), "file_attributes": names("attributes", USN_ATTRIBUTES),
    })


def last_record(records: DataFrame) -> DataFrame:
    """The record of the greatest offset: partial maxima, then one row."""
    row = F.struct(*records.columns)
    return records.agg(F.max_by(row, "offset").alias("r")).select("r.*")


def history(records: DataFrame, merge: Callable[[Column, Column], Column] = F.min_by) -> DataFrame:
    """What the journal remembers of every (file, sequence): by default the first
    name and parent it saw; ``merge`` of (name and parent, offset) may choose otherwise."""
    seen = F.struct("name", "parent", "parent_seq")
    return records.groupBy("file", "file_seq").agg(merge(seen, F.col("offset")).alias("h")).select("file", "file_seq", "h.*")


def with_paths(records: DataFrame, table: DataFrame, past: DataFrame | None = None, options: PathOptions = PathOptions()) -> DataFrame:
    """records with ``links``: every path of the parent with the record's name, and
    ``full_path``, the first.

    ``table`` is paths.summaries of file records; a parent is looked up there
    first, then, if its sequence has moved on, in ``past`` (journal.history).  A
    parent that is unreadable, or another file by now, is named under <Err>.
    """
    if not options.resolve:
        return records.withColumn("links", F.array("name")).withColumn("full_path", F.col("name"))
    refs = records.select("parent", "parent_seq").distinct()
    parents = refs.select(F.col("parent").alias("entry"), F.col("parent_seq").alias("want")).join(table, "entry", "left")
    state = parents
    if past is not None:
        old = F.array(F.struct(F.lit(0).alias("ord"), "name", "parent", "parent_seq"))
        state = state.join(past.select(F.col("file").alias("entry"), F.col("file_seq").alias("want"), old.alias("old")), ["entry", "want"], "left")
    else:
        state = state.withColumn("old", F.lit(None).cast("array<struct<ord: int, name: string, parent: bigint, parent_seq: int>>"))
    moved = F.col("seq") != F.col("want")
    fault = (
        F.when(F.col("seq").isNull(), F.format_string(f"<Parent %d Error {MISSING}>", "entry"))
        .when(F.col("error").isNotNull(), F.format_string("<Parent %d Error %s>", "entry", "error"))
        .when(moved & F.col("old").isNull(), F.format_string("<Parent %d-%d need %d>", "entry", "seq", "want"))
    )
    state = keep(state.withColumns({"fault": fault, "names": F.when(moved, F.col("old")).otherwise(F.col("names"))}).select("entry", "want", "fault", "names"))
    # the parents' own names, keyed by parent and sequence, through the resolver
    own = state.where("fault is null").select(F.struct("entry", "want").alias("entry"), F.inline("names"))
    found = paths(own, table, options, past).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("k", "components"))).alias("p"))
    found = found.select("entry.entry", "entry.want", F.transform("p", lambda p: linked(p["components"])).alias("above"))
    marked = F.array(F.concat(F.lit(ERR + "\\"), F.col("fault")))
    unnamed = F.array(F.lit(f"{ERR}\\<UnknownEntry>"))
    up = state.join(found, ["entry", "want"], "left").select(
        F.col("entry").alias("parent"), F.col("want").alias("parent_seq"), F.when(F.col("fault").isNotNull(), marked).otherwise(F.coalesce("above", unnamed)).alias("above")
    )
    out = records.join(up, ["parent", "parent_seq"], "left").withColumn("links", F.transform("above", lambda p: F.concat(p, F.lit("\\"), F.col("name"))))
    return out.withColumn("full_path", F.get("links", F.lit(0))).drop("above")
