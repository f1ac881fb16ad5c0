"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct k-word shingles.  Documents
with equal sets form one node, so copies never meet as pairs.

Signatures.  Sizes are cut into bands whose largest size is 8/5 of the
smallest.  A set signs for the instance of its own band and, if similar sets
may be that large, for the next.  In an instance, the domain (the hash) is
partitioned into n parts in a fixed order, and a set's projections on single
parts are its signatures (subsets of one part: larger ones would be more
signatures).  A set x differs from any similar set of the instance in at most
k(x) elements, k from its own size, so at most k(x) of its m parts with
elements differ, and the rest agree: in any order of signatures common to all
sets, the first agreeing one is among the first k(x) + 1 of either set.  That
order is by the number of nodes with the signature.  Those of one node alone
come first and lead nowhere, so a set goes on with the rarest s - (m - k(x) - 1)
of the s signatures that it shares, and a set with more than k(x) of its own is
similar to none: documents that have a passage in common drop out here.  Only a
set with m <= k(x) (few, and small ones) also sends its empty parts, for others
of that kind.

Candidates.  All nodes of a signature are checked against one centre, the node
that shares most signatures with others: a star, not all pairs.  The check
yields the difference D(x) between the node's set and its centre's.  Links form
components; two nodes x, y of one star that are in different components still
may be similar.  As |x - y| = |D(x)| + |D(y)| - 2|D(x) & D(y)|, they then share
at least c elements of their small difference sets, so they meet in a prefix
join over these, rarest elements first, and only such pairs are checked, of those whose remaining
elements suffice.  No
link between components is lost, a group of m near copies costs about m checks
instead of m*m, and checks compare whole sets.

Defined results: null and empty texts, and texts of white space, have an empty
set and no links; fewer words than k give one shingle of all words; rows that
repeat a doc_id are joined as one document if their sets are equal, else each
keeps its set; a null doc_id counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Words, _WORD_MUL, chunked, column, i64, ids_of, keep, mix64, run_hash
from .graph import components

BAND_RATIO = Fraction(8, 5)
ROWS_OUT = 1 << 18
MEMBERS_A_RUN = 500


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, and where each begins."""
    _, value = words.grams(k)
    count = np.diff(words.first)
    size = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = run_hash(words.hash, words.first[short], words.first[short + 1], _WORD_MUL)
        at = np.cumsum(size)[short]  # these have no run of k words yet
        value, size[short] = np.insert(value, at, whole), 1
    bound = np.concatenate([[0], np.cumsum(size)])
    edges = bound.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    new[bound[:-1][size > 0]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[bound]


def set_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets, equal ids."""
    return run_hash(value, first[:-1], first[1:], U64(0x8CB92BA72F3D8DD7))


class Bands:
    """Bands of set sizes for one threshold; band i ends with size last[i]."""

    def __init__(self, threshold: Fraction):
        self.num, self.den = threshold.numerator, threshold.denominator
        self.ratio = max(BAND_RATIO, 1 / threshold)
        self.last = [0]  # band 0 holds the empty set

    def grow(self, top: int) -> None:
        """Bands up to the one after that of size ``top``."""
        while self.last[-1] < top or len(self.last) < 2 or self.last[-2] < top:
            low = self.last[-1] + 1
            self.last.append(max(low, int(low * self.ratio)))

    def distance(self, a, b):
        """Most elements in which two similar sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)


def signatures(value: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, document index and way of all non-empty sets: way holds the
    instance and, in its lower half, how many of the signatures may be spared."""
    size = np.diff(first)
    bands.grow(int(size.max(initial=0)))
    last = np.array(bands.last)
    own = np.searchsorted(last, size)
    largest = size * bands.den // bands.num  # the largest similar set
    out_sig, out_doc, out_way = [], [], []
    for instance in sorted({*own[size > 0], *(own[(size > 0) & (largest > last[own])] + 1)}):
        top = int(last[instance])
        here = (size > 0) & ((own == instance) | (own == instance - 1) & (largest > last[instance - 1]))
        most = bands.distance(size, np.minimum(largest, top))
        docs = np.flatnonzero(here & (most > 0))  # others are similar to equal sets only, and those are one node
        if not len(docs):
            continue
        need, count = most[docs] + 1, size[docs]
        n = bands.distance(top, top) * 6 // 5 + 3
        salt = U64(int(instance) * 0xA0761D6478BD642F % (1 << 64))
        rows = np.repeat(first[docs], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        v = value[rows]
        # the hash's high half picks the part
        slot = np.repeat(np.arange(len(docs)), count) * n + ((v >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
        # values ascend within a document and so do its slots: each slot is one run
        new = np.ones(len(slot), dtype=bool)
        new[1:] = slot[1:] != slot[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(slot))
        of, part = np.divmod(slot[begin], n)
        runs = np.bincount(of, minlength=len(docs))
        way = (int(instance) << 32) + np.maximum(runs - need, 0)
        sig = run_hash(v, begin, end, U64(0xE7037ED1A0B428DB))
        out_sig.append(mix64(sig + part.astype(U64) * U64(0x9E3779B97F4A7C15) + salt))
        out_doc.append(docs[of])
        out_way.append(way[of])
        for d in np.flatnonzero(runs < need):
            lack = np.setdiff1d(np.arange(n), part[of == d]).astype(U64)
            out_sig.append(mix64(U64(0x589965CC75374CC3) + lack * U64(0x9E3779B97F4A7C15) + salt))
            out_doc.append(np.full(len(lack), docs[d]))
            out_way.append(np.full(len(lack), way[d]))
    if not out_sig:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # 48 bits are enough, as candidates are checked, and shuffle as fewer bytes
    return np.concatenate(out_sig) >> U64(16), np.concatenate(out_doc), np.concatenate(out_way)


def _nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            w, ids = Words(column(part, "text"), lower=True), ids_of(part)
            value, first = shingle_sets(w, k)
            yield pa.RecordBatch.from_arrays([ids, i64(set_ids(value, first)), np.diff(first)], names=["doc_id", "node", "n_shingles"])

    return run


def _node_texts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            text = column(part, "text")
            yield pa.RecordBatch.from_arrays([i64(set_ids(*shingle_sets(Words(text, lower=True), k))), text], names=["node", "text"])

    return run


def _signed(k: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for part in chunked(batches):
            w = Words(column(part, "text"), lower=True)
            value, first = shingle_sets(w, k)
            node = set_ids(value, first)
            _, one = np.unique(node, return_index=True)  # copies in a chunk sign once
            keep_doc = np.zeros(len(node), dtype=bool)
            keep_doc[one] = True
            sig, doc, way = signatures(value, first, bands)
            ok = keep_doc[doc]
            sig, doc, way = sig[ok], doc[ok], way[ok]
            for a in range(0, len(sig), ROWS_OUT):
                b = a + ROWS_OUT
                yield pa.RecordBatch.from_arrays([i64(sig[a:b]), i64(node[doc[a:b]]), way[a:b]], names=["sig", "node", "way"])

    return run


def _compared(k: int, threshold: Fraction):
    """Rows (a, b, text), where each run of equal a begins with the centre itself
    (b null), to (a, b, size_a, size_b, linked, delta): delta holds what only one
    of the two sets has.  The centre's set is kept from one chunk to the next."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, U64)
        for part in chunked(batches, limit=1 << 20):
            a, b = column(part, "a").to_numpy(), column(part, "b")
            member = b.is_valid().to_numpy(zero_copy_only=False)
            value, first = shingle_sets(Words(column(part, "text"), lower=True), k)
            deltas, sizes = [], []
            for i, is_member in enumerate(member.tolist()):
                mine = value[first[i] : first[i + 1]]
                if not is_member:
                    centre = mine.copy()
                    continue
                both = np.concatenate([centre, mine])
                both.sort()
                twice = both[1:] == both[:-1]
                alone = np.ones(len(both), dtype=bool)
                alone[1:] &= ~twice
                alone[:-1] &= ~twice
                deltas.append(both[alone])
                sizes.append((len(centre), len(mine), len(deltas[-1])))
            if not deltas:
                continue
            na, nb, size = (np.array(x, dtype=np.int64) for x in zip(*sizes, strict=True))
            union, common = (na + nb + size) // 2, (na + nb - size) // 2
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(i64(np.concatenate(deltas))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[member]), b.filter(pa.array(member)), pa.array(na), pa.array(nb), pa.array(den * common >= num * union), flat],
                names=["a", "b", "size_a", "size_b", "linked", "delta"],
            )

    return run


def _star_rows(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text) in runs of a, each led by the centre's own text.

    A centre's text travels once for every MEMBERS_A_RUN of its members, which
    are dealt by a salt, so a star of any size spreads over many tasks.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_RUN).alias("salts"))
    salted = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    members = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "salt", "text")
    centres = spread.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.unionByName(centres).repartition(n, "a", "salt")
    return dealt.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).select("a", "b", "text")


def _second_links(stars: DataFrame, labels: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) of similar nodes that share a centre but, so far, no component."""
    num, den = threshold.numerator, threshold.denominator
    ratio = (1 - threshold) / (1 + threshold)
    p, q = ratio.numerator, ratio.denominator
    named = stars.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    open_ = named.groupBy("a").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("a")
    named = keep(named.join(open_, "a").where(F.size("delta") > 0))
    # the least number of elements that a partner in another component shares with this node's difference
    reach = F.floor(F.col("size_b") * (den - num) / F.lit(num) + F.lit(1e-9))
    d = F.size("delta").cast("long")
    apart = F.ceil((d + F.greatest(d - reach, F.lit(1)) - reach) / 2)
    near = F.ceil((d + 1 - F.greatest(F.lit(0), F.ceil((F.col("size_b") - F.col("size_a")) * p / F.lit(q) - 1e-9))) / 2)
    least = F.greatest(F.lit(1), F.when(F.col("linked"), near).otherwise(apart))
    rows = named.select("a", "b", "label", (d - least + 1).alias("take"), F.explode("delta").alias("e"))
    often = named.select("a", F.explode("delta").alias("e")).groupBy("a", "e").agg(F.count("*").alias("n")).where("n > 1")
    # elements that one node alone has come first, and lead to no partner
    ranked = (
        rows.join(often, ["a", "e"])
        .groupBy("a", "b", "label", "take")
        .agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
        .join(named.select("a", "b", d.alias("d"), F.col("size_b").alias("n")), ["a", "b"])
        .withColumn("take", F.col("take") - (F.col("d") - F.size("es")))
        .where("take > 0")
        .select("a", "b", "label", "d", "n", F.size("es").alias("held"), F.posexplode(F.slice("es", F.lit(1), F.col("take").cast("int"))).alias("at", "s"))
        .select("a", "b", "label", "d", "n", (F.col("held") - F.col("at")).alias("rest"), F.col("s.e").alias("e"))
    )
    ranked = keep(ranked)
    other = ranked.select("a", "e", *(F.col(c).alias(f"{c}_c") for c in ("b", "label", "d", "n", "rest")))
    # at their first common element, two nodes have no more in common than either has from there on
    enough = (2 * F.least("rest", "rest_c") - F.col("d") - F.col("d_c")) * (den + num) + (F.col("n") + F.col("n_c")) * (den - num) >= 0
    near = (F.least("n", "n_c") * den >= F.greatest("n", "n_c") * num) & enough
    met = ranked.join(other, ["a", "e"]).where((F.col("label") < F.col("label_c")) & near).select("a", "b", F.col("b_c").alias("c")).distinct()
    x = named.select("a", "b", F.col("size_b").alias("n_b"), F.col("delta").alias("d_b"))
    y = named.select("a", F.col("b").alias("c"), F.col("size_b").alias("n_c"), F.col("delta").alias("d_c"))
    gap = F.size("d_b") + F.size("d_c") - 2 * F.size(F.array_intersect("d_b", "d_c"))
    return (
        met.join(x, ["a", "b"]).join(y, ["a", "c"])
        .withColumn("gap", gap)
        .where((F.col("n_b") + F.col("n_c") - F.col("gap")) * den >= (F.col("n_b") + F.col("n_c") + F.col("gap")) * num)
        .select(F.col("b").alias("a"), F.col("c").alias("b"))
        .distinct()
    )


def jaccard_groups(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string"))
    nodes = keep(docs.mapInArrow(_nodes(k), "doc_id long, node long, n_shingles long"))
    reps = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    signed = docs.mapInArrow(_signed(k, threshold), "sig long, node long, way long")
    # one exchange serves both the count of a signature's nodes and the join with it
    # (the filters, which drop nothing, are there as both sides must ask for the same rows and columns)
    signed = signed.where("sig is not null and node is not null").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig")
    shared = signed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"), F.min("way").alias("way")).where("lo < hi and way >= 0")
    met = keep(signed.join(shared.select("sig", "n"), "sig").select("sig", "node", "way", "n").distinct())
    # a signature that one node alone has leads nowhere: what else is to send, rarest first
    whole = Window.partitionBy("node", "way")
    met = met.withColumn("rank", F.row_number().over(whole.orderBy("n", "sig"))).withColumn("of", F.count("*").over(whole))
    met = keep(met.where(F.col("rank") <= F.col("of") - F.col("way").bitwiseAND(0xFFFFFFFF)).select("sig", "node"))
    shared = met.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    members = keep(met.join(shared, "sig"))
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    members = members.join(score, "node")
    centres = members.groupBy("sig").agg(F.max_by("node", F.struct("score", "node")).alias("centre"))
    pairs = keep(members.join(centres, "sig").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("node").join(reps, "node").select("node", F.col("rep").alias("doc_id"))
    # rows that repeat a doc_id may differ in their sets: the text itself says which node it is of
    near = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    texts = keep(near.mapInArrow(_node_texts(k), "node long, text string").join(wanted.select("node"), "node").dropDuplicates(["node"]))
    stars = keep(_star_rows(pairs, texts).mapInArrow(_compared(k, threshold), "a long, b long, size_a long, size_b long, linked boolean, delta array<long>"))
    edges = stars.where("linked").select("a", "b")
    labels = components(edges)
    more = keep(_second_links(stars, labels, threshold))
    if not more.isEmpty():
        labels = components(edges.union(more))
    named = nodes.where("n_shingles > 0").select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    named = named.join(reps, "node")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "label").select("node", "component_id")
    return nodes.join(of, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
