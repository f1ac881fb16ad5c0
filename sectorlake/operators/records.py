"""File records as rows: decode, attribute lists, highlights, stat rows, models, streams, audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrow, kernels
from ..functions.columns import filetime, flag_text, inode
from ..functions.layout import (
    ATTRIBUTE_LIST, ATTRIBUTE_TYPES, DATA, FILE_FLAGS, INDEX_ALLOCATION, INDEX_ROOT, LONG_NAMES, NAME_TYPES, SI, WILD_ATTR, WILD_STREAM,
)

_RECORD = [("entry", pa.int64()), *kernels.RECORD_FIELDS]


def decoding(bodies: bool = True, lists: bool = False) -> arrow.Step:
    """The step of ``decode``, for a chain that begins with another."""

    def kernel(part: pa.RecordBatch) -> dict:
        entry, body = arrow.columns(part, "entry", "raw")
        return {"entry": entry, **kernels.records(body, bodies, lists)}

    return arrow.Step(_RECORD, kernel)


def decode(raw: DataFrame, bodies: bool = True, lists: bool = False) -> DataFrame:
    """(entry, raw) to decoded records, attributes as an array in their order: one
    pass, no shuffle.  Names, times and sizes need no ``bodies`` (contents, runs),
    ``expand`` only ``lists`` (contents of attribute lists)."""
    return arrow.chained(raw.select(F.col("entry").cast("long"), F.col("raw").cast("binary")), decoding(bodies, lists))


def _of(kind: int, attributes: Column | str = "attributes") -> Column:
    return F.filter(attributes, lambda a: a["type"] == kind)


def _first_piece(a: Column) -> Column:
    return a["resident"] | (a["vcn_start"] == 0)


def is_long(name: Column) -> Column:
    return name["type"].isin(*LONG_NAMES)


def _label(kind: Column, names: dict[int, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, n in names.items() for x in (F.lit(k).cast("long"), F.lit(n))]), kind.cast("long")), F.lit("Unknown"))


def name_type(kind: Column) -> Column:
    return _label(kind, NAME_TYPES)


def attribute_type(kind: Column) -> Column:
    return _label(kind, ATTRIBUTE_TYPES)


def with_parts(records: DataFrame) -> DataFrame:
    """records with ``si`` (the last), ``names`` and ``data`` (streams), in attribute order."""
    infos = F.filter("attributes", lambda a: (a["type"] == SI) & a["info"].isNotNull())
    named = F.filter("attributes", lambda a: a["fn"].isNotNull())
    names = F.transform(named, lambda a: F.struct(a["ord"].alias("ord"), *(a["fn"][n].alias(n) for n, _ in kernels.NAME_FIELDS)))
    return records.withColumns({"si": F.try_element_at(infos, F.lit(-1))["info"], "names": names, "data": _of(DATA)})


# ---- attribute lists -------------------------------------------------------

_WANT = [("pos", pa.int32()), ("type", pa.int64()), ("attr", pa.int32())]
_MEMBERS = [("entry", pa.int64()), ("list_ord", pa.int32()), ("ref", pa.int64()), ("wants", pa.list_(pa.struct(_WANT)))]


def list_members(lists: DataFrame) -> DataFrame:
    """(entry, number, list_ord, content) of attribute lists to what they name in other
    records: one row for each list and record, ``wants`` in the list's order."""

    def kernel(part: pa.RecordBatch) -> dict:
        entry, number, list_ord = (arrow.numbers(part, c) for c in ("entry", "number", "list_ord"))
        found = kernels.list_entries(arrow.columns(part, "content")[0])
        other = np.flatnonzero(found["ref"] != number[found["row"]])
        other = other[np.lexsort((found["pos"][other], found["ref"][other], found["row"][other]))]
        row, ref = found["row"][other], found["ref"][other]
        head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(ref, prepend=-1) != 0))
        wants = pa.StructArray.from_arrays([pa.array(found[k][other], t) for k, t in _WANT], fields=[pa.field(k, t) for k, t in _WANT])
        bound = pa.array(np.append(head, len(other)), pa.int32())
        return {"entry": entry[row[head]], "list_ord": list_ord[row[head]], "ref": ref[head], "wants": pa.ListArray.from_arrays(bound, wants)}

    return arrow.mapped(lists.select("entry", "number", "list_ord", "content"), _MEMBERS, kernel)


def expand(records: DataFrame, list_contents: DataFrame | None = None) -> DataFrame:
    """Records with the attributes that their attribute lists name in other
    records, each list's before the list itself.  From the first entry that
    cannot be found on, the rest of a list is left out, as is every attribute
    list of the other record.

    ``list_contents`` (entry, list_ord, content) holds lists that lie outside
    their record.  ``records`` is read three times, so it had better be kept;
    only records with lists, and whole records that may be named, are shuffled,
    once for each list and record and not for each attribute.
    """
    lists = F.filter("attributes", lambda a: a["type"] == ATTRIBUTE_LIST)
    plain, listed = records.where(F.size(lists) == 0), records.where(F.size(lists) > 0)
    found = listed.select("entry", "number", F.explode(lists).alias("l")).select("entry", "number", F.col("l.ord").alias("list_ord"), F.col("l.content").alias("content"))
    if list_contents is not None:
        outside = list_contents.select("entry", "list_ord", F.col("content").alias("outside"))
        found = found.join(outside, ["entry", "list_ord"], "left").withColumn("content", F.coalesce("content", "outside"))
    wanted = list_members(found).hint("merge")
    have = records.where("error is null").select(F.col("entry").alias("ref"), "attributes")
    pick = lambda w: F.struct(F.col("list_ord").alias("k1"), w["pos"].alias("k2"), F.get(F.filter("attributes", lambda a: (a["type"] == w["type"]) & (a["attr"] == w["attr"])), F.lit(0)).alias("a"))
    met = wanted.join(have, "ref", "left").select("entry", F.transform("wants", pick).alias("met"))
    children = met.groupBy("entry").agg(F.flatten(F.collect_list("met")).alias("met"))
    missed = F.filter("met", lambda m: m["a"].isNull())
    children = children.withColumn("missed", missed).select("entry", F.when(F.size("missed") == 0, F.col("met")).otherwise(
        F.filter("met", lambda c: ~F.exists("missed", lambda m: (m["k1"] == c["k1"]) & (m["k2"] <= c["k2"])))).alias("children"))
    own = F.transform("attributes", lambda a: F.struct(a["ord"].alias("k1"), F.lit(1 << 30).alias("k2"), a.alias("a")))
    every = F.array_sort(F.when(F.col("children").isNull(), own).otherwise(F.concat("children", own)))
    numbered = F.transform(every, lambda x, i: x["a"].withField("ord", i))
    whole = listed.join(children, "entry", "left").withColumn("attributes", numbered).drop("children")
    return plain.unionByName(whole)


# ---- highlights ------------------------------------------------------------

def display_name(names: Column) -> Column:
    """First Win32, DOS+Win32 or POSIX name, else the last other."""
    return F.coalesce(F.get(F.filter(names, is_long), F.lit(0))["name"], F.try_element_at(names, F.lit(-1))["name"])


def highlights(records: DataFrame) -> DataFrame:
    """One flat row for each readable record that has times and a name; first names give parents and 0x30 times."""
    si, fn = F.col("si"), F.get("names", F.lit(0))
    bare = lambda c: F.pmod(c, F.lit(10_000_000)) == 0
    sized = F.get(F.filter("data", lambda s: s["size"] != 0), F.lit(0))["size"]
    unnamed = F.get(F.filter("data", lambda s: (s["size"] != 0) & (s["name"] == "")), F.lit(0))["size"]
    rows = with_parts(records).where("error is null and si is not null and size(names) > 0")
    return rows.select(
        "entry", F.col("number").alias("entry_number"), F.col("number").cast("string").alias("inode"), F.col("seq").alias("sequence_number"),
        (F.col("flags").bitwiseAND(1) != 0).alias("in_use"), fn["parent"].alias("parent_entry_number"), fn["parent_seq"].alias("parent_sequence_number"),
        F.transform("names", lambda n: n["name"]).alias("file_names"), F.transform("names", lambda n: name_type(n["type"])).alias("file_name_types"),
        display_name(F.col("names")).alias("file_name"), F.coalesce(sized, F.lit(0)).cast("long").alias("file_size"), F.col("links").cast("long").alias("reference_count"),
        (F.col("flags").bitwiseAND(2) != 0).alias("is_dir"), F.exists("data", lambda s: s["name"] != "").alias("has_ads"),
        (si["created"] < fn["created"]).alias("si_lt_fn"), (bare(si["created"]) | bare(si["modified"])).alias("usec_zeros"), (si["created"] > si["modified"]).alias("copied"),
        flag_text(si["flags"], FILE_FLAGS).alias("si_flags"),
        *[x for k, label in (("created", "created"), ("modified", "last_modified"), ("mft_modified", "last_record_change"), ("accessed", "last_access")) for n, s in (("0x10", si), ("0x30", fn))
          for x in (filetime(s[k]).alias(f"{label}_{n}"), s[k].alias(f"{label}_{n}_ft"))],
        F.when(F.col("lsn") < 0, F.col("lsn").cast("decimal(20,0)") + F.expr("18446744073709551616BD")).otherwise(F.col("lsn").cast("decimal(20,0)")).cast("decimal(20,0)").alias("log_file_seq_num"),
        F.filter("data", lambda s: (s["name"] != "") & _first_piece(s)).alias("ads"), F.coalesce(unnamed, F.lit(0)).cast("long").alias("unnamed_size"),
    )


def with_streams(rows: DataFrame) -> DataFrame:
    """Highlights, each followed by one row for every alternate stream: names and
    inode end in the stream's name, the size is the stream's; the file's own row
    has that of the unnamed stream, 0 without one."""
    keep = [c for c in rows.columns if c not in ("ads", "file_names", "file_name", "file_size", "unnamed_size", "is_dir", "inode")]
    own = F.struct(F.lit(0).alias("ord"), F.lit("").alias("stream"), F.col("unnamed_size").alias("size"), F.col("is_dir").alias("dir"))
    others = F.transform("ads", lambda s, i: F.struct((i + 1).alias("ord"), s["name"].alias("stream"), s["size"].alias("size"), F.lit(False).alias("dir")))
    out = rows.select(*keep, "file_names", "file_name", "inode", F.explode(F.concat(F.array(own), others)).alias("s"))
    tail = F.when(F.col("s.stream") == "", F.lit("")).otherwise(F.concat(F.lit(":"), F.col("s.stream")))
    return out.select(
        *keep, F.col("s.ord").alias("stream_ord"), F.transform("file_names", lambda n: F.concat(n, tail)).alias("file_names"), F.concat("file_name", tail).alias("file_name"),
        F.col("s.size").alias("file_size"), F.col("s.dir").alias("is_dir"), F.concat("inode", tail).alias("inode"),
    )


# ---- streams and attributes --------------------------------------------------

def attributes(records: DataFrame) -> DataFrame:
    """One row for each attribute of readable records."""
    return records.where("error is null").select("entry", "number", F.inline("attributes")).drop("info", "fn")


def streams(records: DataFrame) -> DataFrame:
    """One row for each $DATA stream at its first piece, with its inode."""
    rows = records.where("error is null").select("entry", "number", _of(DATA).alias("data"))
    firsts = rows.withColumn("data", F.filter("data", _first_piece))
    labelled = F.transform("data", lambda s, i: F.struct(s.alias("s"), (F.size(F.filter(F.slice("data", F.lit(1), i), lambda o: o["attr"] == s["attr"])) + 1).alias("repeat")))
    out = firsts.select("entry", "number", F.explode(labelled).alias("x")).select("entry", "number", "x.s.*", "x.repeat")
    return out.withColumn("inode", inode(F.col("number"), F.col("type"), F.col("attr"), F.col("name"), F.col("repeat"))).drop("info", "fn")


def select_stream(requests: DataFrame, records: DataFrame) -> DataFrame:
    """The attribute that each request (id, entry, type, attr, stream) means: its
    columns, null for what is not found.

    attr WILD_ATTR stands for any; then stream WILD_STREAM is the unnamed one,
    else the first, and any other name the first of that name.  With an attr,
    WILD_STREAM is the first of that attr.  Only first pieces count.
    """
    rows = attributes(records).where("resident or vcn_start = 0").withColumnRenamed("entry", "at")
    r = requests.select(F.col("id").alias("id"), F.col("entry").alias("want_entry"), F.col("type").alias("want_type"), F.col("attr").alias("want_attr"), F.col("stream").alias("want_stream"))
    any_name = F.col("want_stream") == WILD_STREAM
    fits = (F.col("at") == F.col("want_entry")) & (F.col("type") == F.col("want_type")) & ((F.col("want_attr") == WILD_ATTR) | (F.col("attr") == F.col("want_attr"))) & (any_name | (F.col("name") == F.col("want_stream")))
    late = F.when((F.col("want_attr") == WILD_ATTR) & any_name & (F.col("name") != ""), 1).otherwise(0)
    best = Window.partitionBy("id").orderBy("late", "ord")
    # records shrink to few bytes in their tables and are never broadcast; dealt by number, partitions are not merged until a task grows with the input
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r, rows = r.repartition(n, "want_entry", "want_type"), rows.repartition(n, "at", "type")
    met = r.join(rows.hint("merge"), fits, "left").repartition(n, "id").withColumn("late", late).withColumn("k", F.row_number().over(best)).where("k = 1")
    return met.select("id", F.col("want_entry").alias("entry"), *[c for c in rows.columns if c not in ("at", "number")])


# ---- stat rows and models ----------------------------------------------------

def stat(records: DataFrame) -> DataFrame:
    """Rows of a listing: one for the index of a directory, one for every stream,
    and before each a copy under any further name that is no short one.

    Records without times or a long name have none.  ord numbers the rows of a
    record.  fn_mtime is the name's own modification time.
    """
    rows = with_parts(records).where("error is null")
    rows = rows.withColumns({
        "long": F.try_element_at(F.filter("names", is_long), F.lit(-1)), "others": F.transform(F.filter("names", lambda n: ~is_long(n)), lambda n: n["name"]),
        "last_name": F.try_element_at("names", F.lit(-1)), "index": F.try_element_at(F.filter("attributes", lambda a: a["type"].isin(INDEX_ROOT, INDEX_ALLOCATION)), F.lit(-1)),
        "data": F.filter("data", _first_piece), "dir": F.col("flags").bitwiseAND(2) != 0,
    }).where("si is not null and long is not null")
    made = F.when(F.col("index").isNotNull(), F.array(F.struct(
        F.concat_ws("-", F.col("number").cast("string"), F.col("index.type").cast("string"), F.col("index.attr").cast("string")).alias("mft_id"), F.lit("").alias("ads"), F.lit(0).cast("long").alias("size")
    ))).otherwise(F.array().cast("array<struct<mft_id: string, ads: string, size: bigint>>"))
    repeat = lambda s, i: F.size(F.filter(F.slice("data", F.lit(1), i), lambda o: (o["attr"] == s["attr"]) & (o["type"] == s["type"]))) + 1
    data = F.transform("data", lambda s, i: F.struct(
        inode(F.col("number"), s["type"], s["attr"], s["name"], repeat(s, i)).alias("mft_id"),
        F.when(s["name"].isin("", "$I30"), F.lit("")).otherwise(F.concat(F.lit(":"), s["name"])).alias("ads"), s["size"].alias("size"),
    ))
    rows = rows.withColumn("base", F.concat(made, data))
    copied = F.filter("others", lambda n: ~F.contains(n, F.lit("~")))

    def group(b: Column) -> Column:
        copies = F.transform(copied, lambda n: F.struct(b["mft_id"].alias("mft_id"), b["size"].alias("size"), F.concat(n, b["ads"]).alias("name"), F.array(F.concat(F.col("long.name"), b["ads"])).alias("extra_names"), F.col("dir").alias("is_dir")))
        own = F.struct(b["mft_id"].alias("mft_id"), b["size"].alias("size"), F.concat(F.col("long.name"), b["ads"]).alias("name"), F.transform("others", lambda n: F.concat(n, b["ads"])).alias("extra_names"), (F.col("dir") & (b["ads"] == "")).alias("is_dir"))
        return F.concat(copies, F.array(own))

    out = rows.select("entry", "number", "seq", "si", "long", "last_name", F.posexplode(F.flatten(F.transform("base", group))).alias("ord", "r"))
    return out.select(
        "entry", "ord", "r.mft_id", F.col("seq").alias("sequence_number"), filetime(F.col("si.modified")).alias("mtime"), filetime(F.col("si.accessed")).alias("atime"),
        filetime(F.col("si.mft_modified")).alias("ctime"), filetime(F.col("si.created")).alias("btime"), filetime(F.col("last_name.created")).alias("fn_btime"),
        filetime(F.col("last_name.modified")).alias("fn_mtime"), "r.name", name_type(F.col("long.type")).alias("name_type"), "r.extra_names", "r.is_dir", "r.size",
        F.lit(0).cast("long").alias("allocated_size"), F.lit(False).alias("is_slack"), F.lit(0).cast("long").alias("slack_offset"),
    )


def _times(s: Column) -> Column:
    pairs = (("create_time", "created"), ("file_modified_time", "modified"), ("mft_modified_time", "mft_modified"), ("accessed_time", "accessed"))
    return F.struct(*(filetime(s[k]).alias(n) for n, k in pairs))


def model(records: DataFrame, paths: DataFrame) -> DataFrame:
    """One nested row for each readable record: times, names, first pieces of all
    attributes, links.  ``paths`` is what operators.paths gives for them.  The size
    is that of the first $DATA attribute that has any, a named one too."""
    rows = with_parts(records).where("error is null")
    rows = rows.withColumn("shown", F.filter("attributes", _first_piece)).withColumn("first_si", F.get(F.filter("attributes", lambda a: (a["type"] == SI) & a["info"].isNotNull()), F.lit(0))["info"])
    repeat = lambda a, i: F.size(F.filter(F.slice("shown", F.lit(1), i), lambda o: (o["attr"] == a["attr"]) & (o["type"] == a["type"]))) + 1
    filenames = F.transform("names", lambda n: F.struct(_times(n).alias("times"), name_type(n["type"]).alias("type"), n["name"].alias("name"), n["parent"].alias("parent_entry_number"), n["parent_seq"].alias("parent_sequence_number")))
    shown = F.transform("shown", lambda a, i: F.struct(
        attribute_type(a["type"]).alias("type"), a["type"].alias("type_id"), a["attr"].cast("long").alias("id"),
        inode(F.col("number"), a["type"], a["attr"], a["name"], repeat(a, i)).alias("inode"), a["size"].alias("size"), a["name"].alias("name"), a["resident"].alias("resident"),
    ))
    sized = F.get(F.filter("data", lambda s: s["size"] != 0), F.lit(0))["size"]
    links = paths.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("k", "components"))).alias("ways"))
    full = F.get("ways", F.lit(0))["components"]
    from .paths import joined

    return rows.join(links, "entry", "left").select(
        "entry", F.when(full.isNull(), F.lit("/")).otherwise(joined(full)).alias("full_path"), F.col("number").alias("mft_id"), F.col("seq").alias("sequence_number"),
        F.coalesce(sized, F.lit(0)).cast("long").alias("size"), (F.col("flags").bitwiseAND(1) != 0).alias("allocated"), (F.col("flags").bitwiseAND(2) != 0).alias("is_dir"),
        F.when(F.col("first_si").isNotNull(), _times(F.col("first_si"))).alias("si_times"), filenames.alias("filenames"), shown.alias("attributes"),
        F.coalesce(F.transform("ways", lambda l: F.array_join(l["components"], "\\")), F.array().cast("array<string>")).alias("hardlinks"),
    )


# ---- audits ------------------------------------------------------------------

def audit(records: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Faults of records of a range of entries: unreadable, misplaced, or without a name."""
    if first is not None:
        records = records.where(F.col("entry") >= first)
    if last is not None:
        records = records.where(F.col("entry") < last)
    named = F.exists("attributes", lambda a: a["fn"].isNotNull())
    fault = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("number") != F.col("entry"), "NumberMismatch").when(~named, "NoName")
    return records.withColumn("fault", fault).where("fault is not null").select("entry", "fault")


def hash_window(streams: DataFrame, records: DataFrame, least: int = 1024, most: int = 100 << 20) -> DataFrame:
    """Attributes worth comparing with another tool: of records in use that extend
    no other, with a size inside the window."""
    good = records.where("error is null and base = 0 and (flags & 1) <> 0").select("entry")
    return streams.where(F.col("size").between(least, most)).join(good, "entry", "left_semi")


def compare(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which two tables differ: a key only one has, or other values; ``side`` says which."""
    values = [c for c in ours.columns if c not in keys]
    a = ours.select(*keys, F.struct(*values).alias("ours"), F.lit(True).alias("here"))
    b = theirs.select(*keys, F.struct(*values).alias("theirs"), F.lit(True).alias("there"))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("here").isNull(), "theirs").when(F.col("there").isNull(), "ours").when(~F.col("ours").eqNullSafe(F.col("theirs")), "both")
    return both.withColumn("side", side).where("side is not null").select(*keys, "side", "ours", "theirs")
