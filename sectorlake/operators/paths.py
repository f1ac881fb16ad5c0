"""Paths of entries through their parents: links, error markers, history, options.

Every parent that any name refers to is resolved once, as a chain of names
towards the root; chains grow by doubling (a chain that ends at an open parent
takes that parent's chain), so twenty levels take five joins of directories.
Files then join their parents' chains once.

What stops a chain is written into the path, outermost first, under ``<Err>``:
the error of an unreadable parent, ``<Parent E-S need N>`` where the parent's
sequence S is not the N that the name wants (and the history has no such
parent), ``<UnknownEntry>`` for a parent without names, ``<DirTooDeep>``.  A
parent numbered 5 or 0 is the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.layout import MAX_DEPTH, MAX_LINKS, ROOTS
from ..session import keep
from .records import is_long, with_parts

ERR = "<Err>"
MISSING = "EntryTooShortError"  # what reading an entry past the end of the table says


@dataclass(frozen=True)
class PathOptions:
    """short_names: short names lead to links too; max_links, max_depth: bounds of
    one entry's links and of the parents above it; prefix: components before every
    path; resolve: without it, a journal row's path is its name."""

    short_names: bool = False
    max_links: int = MAX_LINKS
    max_depth: int = MAX_DEPTH
    prefix: tuple[str, ...] = ()
    resolve: bool = True


def _shown(names: Column, short_names: bool) -> Column:
    """The names that lead to links, the long one first."""
    if short_names:
        first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
        swapped = F.concat(F.array(second, first), F.slice(names, F.lit(3), F.greatest(F.size(names) - 2, F.lit(0))))
        return F.when((F.size(names) > 1) & (first["type"] == 2), swapped).otherwise(names)
    long = F.filter(names, is_long)
    return F.when(F.size(long) > 0, long).otherwise(names)


def summaries(records: DataFrame, options: PathOptions = PathOptions()) -> DataFrame:
    """(entry, seq, is_dir, error, names): what path resolution reads of a record."""
    names = F.transform(_shown(F.col("names"), options.short_names), lambda n, i: F.struct(i.alias("ord"), n["name"].alias("name"), n["parent"].alias("parent"), n["parent_seq"].alias("parent_seq")))
    return with_parts(records).select("entry", "seq", (F.col("flags").bitwiseAND(2) != 0).alias("is_dir"), "error", F.when(F.col("error").isNull(), names).alias("names"))


def edges(table: DataFrame) -> DataFrame:
    """(entry, seq, is_dir, ord, name, parent, parent_seq) of every name of ``summaries``."""
    return table.where("error is null").select("entry", "seq", "is_dir", F.inline("names"))


def chains(table: DataFrame, refs: DataFrame, options: PathOptions = PathOptions(), past: DataFrame | None = None) -> DataFrame:
    """(ref, ref_seq, key, names, tail) for parents: names from the parent
    outwards, tail the error marker if any.  key orders the chains of one parent.

    ``refs`` (parent, parent_seq) are the parents asked for; those on the way come
    from ``table``.  ``past`` (file, file_seq, name, parent, parent_seq) is what a
    journal remembers, for parents whose sequence has moved on.
    """
    every = refs.select("parent", "parent_seq").unionByName(edges(table).select("parent", "parent_seq"))
    if past is not None:
        every = every.unionByName(past.select("parent", "parent_seq"))
    every = every.where(~F.col("parent").isin(*ROOTS)).distinct().toDF("ref", "ref_seq")
    have = table.select(F.col("entry").alias("ref"), "seq", "error", "names")
    met = every.join(have, "ref", "left")
    if past is not None:
        one = F.array(F.struct(F.lit(0).alias("ord"), "name", "parent", "parent_seq"))
        met = met.join(past.select(F.col("file").alias("ref"), F.col("file_seq").alias("ref_seq"), one.alias("old")), ["ref", "ref_seq"], "left")
    else:
        met = met.withColumn("old", F.lit(None).cast("array<struct<ord: int, name: string, parent: bigint, parent_seq: int>>"))
    moved = F.col("seq") != F.col("ref_seq")
    names = F.when(moved, F.col("old")).otherwise(F.col("names"))
    marker = (
        F.when(F.col("seq").isNull(), F.lit(MISSING)).when(F.col("error").isNotNull(), F.col("error"))
        .when(moved & F.col("old").isNull(), F.format_string("<Parent %d-%d need %d>", "ref", "seq", "ref_seq"))
        .when(F.size(names) == 0, F.lit("<UnknownEntry>"))
    )
    none = F.struct(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("parent"), F.lit(0).alias("parent_seq"))
    met = met.withColumn("marker", marker).select("ref", "ref_seq", "marker", F.explode(F.when(F.col("marker").isNull(), names).otherwise(F.array(none))).alias("n"))
    inner = F.col("marker").isNull() & ~F.col("n.parent").isin(*ROOTS)
    state = met.select(
        "ref", "ref_seq", F.array(F.col("n.ord")).alias("key"), F.when(F.col("marker").isNull(), F.array("n.name")).otherwise(F.array().cast("array<string>")).alias("names"),
        F.when(F.col("marker").isNotNull(), F.array("marker", F.lit(ERR))).otherwise(F.array().cast("array<string>")).alias("tail"),
        F.when(inner, F.col("n.parent")).alias("next"), F.when(inner, F.col("n.parent_seq")).alias("next_seq"),
    )
    rank = Window.partitionBy("ref", "ref_seq").orderBy("key")
    while True:
        state = keep(state)
        # chains that are longer than any path may be need no end
        ended = F.col("next").isNull() | (F.size("names") > options.max_depth)
        open_ = state.where(~ended)
        if open_.isEmpty():
            break
        above = state.select(F.col("ref").alias("next"), F.col("ref_seq").alias("next_seq"), *(F.col(c).alias(f"above_{c}") for c in ("key", "names", "tail", "next", "next_seq")))
        grown = open_.join(above, ["next", "next_seq"]).select(
            "ref", "ref_seq", *(F.concat(c, f"above_{c}").alias(c) for c in ("key", "names")), *(F.col(f"above_{c}").alias(c) for c in ("tail", "next", "next_seq"))
        )
        state = state.where(ended).unionByName(grown).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= options.max_links).drop("k")
    deep = F.size("names") > options.max_depth
    return state.select(
        "ref", "ref_seq", "key", F.slice("names", F.lit(1), F.lit(options.max_depth)).alias("names"),
        F.when(deep, F.array(F.lit("<DirTooDeep>"), F.lit(ERR))).otherwise(F.col("tail")).alias("tail"),
    )


def paths(links: DataFrame, table: DataFrame, options: PathOptions = PathOptions(), past: DataFrame | None = None) -> DataFrame:
    """links (entry, ord, name, parent, parent_seq and others) with their paths:
    ``components`` from the root, k the link's number, at most max_links of an
    entry.  ``table`` holds the summaries of all records."""
    up = chains(table, links.select("parent", "parent_seq"), options, past)
    top = links.where(F.col("parent").isin(*ROOTS)).withColumns({"key": F.array().cast("array<int>"), "above": F.array().cast("array<string>")})
    below = links.where(~F.col("parent").isin(*ROOTS)).join(up.select(F.col("ref").alias("parent"), F.col("ref_seq").alias("parent_seq"), "key", F.concat("names", "tail").alias("above")), ["parent", "parent_seq"])
    every = top.unionByName(below)
    prefix = F.array(*[F.lit(p) for p in options.prefix]) if options.prefix else F.array().cast("array<string>")
    every = every.withColumn("components", F.concat(prefix, F.reverse(F.concat(F.array("name"), "above"))))
    rank = Window.partitionBy("entry").orderBy("ord", "key")
    return every.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= options.max_links).drop("key", "above")


def of_records(records: DataFrame, options: PathOptions = PathOptions(), past: DataFrame | None = None) -> DataFrame:
    """Paths of all readable records."""
    table = keep(summaries(records, options))
    return paths(edges(table), table, options, past)


def joined(components: Column) -> Column:
    """/a/b/c, without empty and . components, and with .. taking one back; a lone . stays."""
    step = lambda a, c: (
        F.when(c.isin("", "."), a)
        .when((c == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
        .when(c == "..", a)
        .otherwise(F.concat(a, F.array(c)))
    )
    plain = ~F.exists(components, lambda c: c.isin("", ".", ".."))
    clean = F.when(plain, components).otherwise(F.aggregate(components, F.array().cast("array<string>"), step))
    return F.concat(F.lit("/"), F.when((F.size(clean) == 0) & F.array_contains(components, "."), F.lit(".")).otherwise(F.array_join(clean, "/")))


def linked(components: Column) -> Column:
    return F.array_join(components, "\\")


def with_stream(components: Column, stream: Column) -> Column:
    """The last component takes the stream's name."""
    last = F.size(components) - 1
    return F.when(stream == "", components).otherwise(F.transform(components, lambda c, i: F.when(i == last, F.concat(c, F.lit(":"), stream)).otherwise(c)))
