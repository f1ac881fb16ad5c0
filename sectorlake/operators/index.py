"""Directory indexes: entries of roots and pages, deleted ones in the slack included; listings; paths by index."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrow, kernels
from ..functions.columns import filetime, path_parts
from ..functions.layout import CLUSTER, INDEX_ALLOCATION, INDEX_ROOT, PAGE_SIZE, ROOT
from ..session import keep
from ..sources.storage import Image
from . import extents
from .records import attributes, name_type

_ENTRY = [("dir", pa.int64()), ("page", pa.int64()), *kernels.INDEX_FIELDS]


def _entries(df: DataFrame, roots: bool) -> DataFrame:
    """(dir, page, data) to index entries."""
    decode = kernels.index_roots if roots else kernels.index_pages

    def kernel(part: pa.RecordBatch) -> dict:
        row, values = decode(arrow.columns(part, "data")[0])
        return {"dir": arrow.numbers(part, "dir")[row], "page": arrow.numbers(part, "page")[row], **values}

    return arrow.mapped(df.select("dir", "page", "data"), _ENTRY, kernel, rows=512)


def page_entries(pages: DataFrame) -> DataFrame:
    """(page, data) of a raw index stream, page its offset, to live and slack entries
    that are valid: their four times lie between 2001 and 2033."""
    return _entries(pages.select(F.lit(None).cast("long").alias("dir"), "page", "data"), False).where("valid")


def nodes(records: DataFrame, disk: DataFrame | Image | None = None, cluster: int = CLUSTER) -> DataFrame:
    """All index entries of directories: those of the root, page -1, and those of
    the pages of the allocation, which lie in ``disk``, (lcn, data) or an image."""
    rows = attributes(records)
    roots = rows.where((F.col("type") == INDEX_ROOT) & F.col("resident")).select(F.col("entry").alias("dir"), F.lit(-1).cast("long").alias("page"), F.col("content").alias("data"))
    found = extents.paged(extents.chunks(rows.where(F.col("type") == INDEX_ALLOCATION), disk, cluster), PAGE_SIZE)
    pages = found.select(F.col("entry").alias("dir"), F.col("offset").alias("page"), "data")
    return _entries(roots, True).unionByName(_entries(pages, False))


def file_info(entries: DataFrame) -> DataFrame:
    """Entries as file rows.  The three labels of times are those that users of
    such listings know: mtime is the record's change, ctime the creation, btime
    the file's modification; the columns fn_* are named for what they are.
    Entries of pages have to be valid, those of roots need not."""
    live = entries.where("valid or page = -1")
    fn = {f"fn_{k}": filetime(F.col(k)) for k in ("created", "modified", "mft_modified", "accessed")}
    return live.select(
        "dir", "page", F.col("entry").cast("string").alias("mft_id"), filetime(F.col("mft_modified")).alias("mtime"), filetime(F.col("accessed")).alias("atime"),
        filetime(F.col("created")).alias("ctime"), filetime(F.col("modified")).alias("btime"), "name", name_type(F.col("type")).alias("name_type"), "size",
        F.col("allocated").alias("allocated_size"), "is_slack", F.when(F.col("is_slack"), F.greatest(F.col("page"), F.lit(0)) + F.col("offset")).otherwise(0).cast("long").alias("slack_offset"),
        *[v.alias(k) for k, v in fn.items()],
    )


def _listed(entries: DataFrame) -> DataFrame:
    return entries.where("not is_slack")


def children(entries: DataFrame) -> DataFrame:
    """(dir, entry, ord): each entry of a directory once, where it comes first."""
    first = Window.partitionBy("dir", "entry").orderBy("page", "ord")
    return _listed(entries).withColumn("k", F.row_number().over(first)).where("k = 1").select("dir", "entry", "page", "ord")


def list_dir(entries: DataFrame, stat_rows: DataFrame) -> DataFrame:
    """Stat rows of the children of every directory: entries whose record is
    unreadable or has none are left out."""
    return children(entries).withColumnRenamed("ord", "at").join(stat_rows, "entry").select("dir", "page", "at", *stat_rows.columns)


def open_path(asked: DataFrame, entries: DataFrame, root: int = ROOT) -> DataFrame:
    """(id, entry) for paths (id, path) that exist: a step through the indexes for
    each component, in any case; / and \\ separate, and a stream's name after a
    colon is left out.  The number of steps is that of the longest path."""
    now = _asked(asked, root)
    known = _known(entries)
    for i in range(_steps(now)):
        now = _step(now, known, i)
    return now.select("id", "entry")


def open_few(asked: DataFrame, load: Callable[[list[int]], DataFrame], root: int = ROOT) -> DataFrame:
    """open_path for a few paths: before each step, ``load`` gives the index entries
    of the directories that are reached, so no others are read."""
    now = keep(_asked(asked, root))
    for i in range(_steps(now)):
        now = keep(_step(now, _known(load([r[0] for r in now.select("entry").distinct().collect()])), i))
    return now.select("id", "entry")


def _asked(asked: DataFrame, root: int) -> DataFrame:
    return asked.select("id", path_parts(F.col("path")).alias("parts"), F.lit(root).cast("long").alias("entry"))


def _steps(now: DataFrame) -> int:
    return now.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]


def _known(entries: DataFrame) -> DataFrame:
    """(dir, key, child): the first entry of each name in any case."""
    first = Window.partitionBy("dir", "key").orderBy("page", "ord")
    return _listed(entries).withColumn("key", F.lower("name")).withColumn("k", F.row_number().over(first)).where("k = 1").select("dir", "key", F.col("entry").alias("child"))


def _step(now: DataFrame, known: DataFrame, i: int) -> DataFrame:
    part = F.get("parts", F.lit(i))
    met = now.join(known, [F.col("entry") == known["dir"], F.lower(part) == known["key"]], "left").where(part.isNull() | F.col("child").isNotNull())
    return met.select("id", "parts", F.when(part.isNull(), F.col("entry")).otherwise(F.col("child")).alias("entry"))
