"""Document fingerprints by SpotSigs, in DataFrame expressions alone.

A spot is a common word (an anchor) with the next CHAIN words that are not
anchors.  Text that people write is full of them and boilerplate is not, so the
set of a document's distinct spots stands for its running text.  The
fingerprint is that set as text: the spots' 64-bit hashes in hexadecimal, in
order, so equal texts have equal fingerprints and likeness is the Jaccard
measure of two fingerprints.

``similar`` finds near copies among all documents: fingerprints are partitioned by
set length and compared through a pruned Jaccard measure.

Defined results: a null text counts as empty; a text without any spot (empty
ones too) has one signature, the hash of its normal form; rows that repeat a
doc_id are ordered by their text's hash; a null doc_id counts as 0; the
successor of the last document is the first, of an only document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHAIN = 2
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "der die das und zu den von mit ist im des dem nicht ein eine auf für sich als auch "
    "le la les de du des et un une est en que dans pas sur avec au pour qui ce "
    "el los las y una con por se del para lo como su al es no"
).split()
DOCS_A_BUCKET = 5000
MOST_CUTS = 512
BUCKETS_TO_SEND = 50_000  # of 24 bytes each: as many borders may go to every task


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def with_spots(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sorted distinct hashes of a text's spots.

    Steps are columns of their own, so that no step is evaluated anew for each
    element of the next.
    """
    body, words, others, at = f"{name}_body", f"{name}_words", f"{name}_others", f"{name}_at"
    df = df.withColumn(body, normal(F.col(text)))
    df = df.withColumn(words, F.split(F.trim(F.col(body)), " "))
    common = lambda w: w.isin(*dict.fromkeys(ANCHORS))
    df = df.withColumn(others, F.filter(words, lambda w: ~common(w)))
    df = df.withColumn(at, F.filter(F.transform(words, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull()))
    # the j-th anchor, at word i, has i - j words before it that are not anchors, however many anchors follow
    last = F.size(others) - CHAIN
    kept = F.filter(F.transform(at, lambda i, j: F.when(i - j <= last, F.struct(F.get(words, i).alias("anchor"), (i - j).alias("next")))), lambda s: s.isNotNull())
    spots = F.transform(kept, lambda s: F.xxhash64(F.concat_ws(" ", s["anchor"], *(F.get(others, s["next"] + k) for k in range(CHAIN)))))
    df = df.withColumn(name, F.sort_array(F.array_distinct(spots)))
    df = df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.xxhash64(body))))
    return df.drop(body, words, others, at)


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two sorted sets of spots.  Sets whose ranges of hashes do
    not overlap have none in common, which is seen without comparing them."""
    common = F.size(F.array_intersect(a, b))
    exact = (common / (F.size(a) + F.size(b) - common)).cast("double")
    apart = (F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1))
    return F.when(a == b, F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(exact)


def _cut(bounds: list[int], lo: int, hi: int) -> Column:
    """How many of the sorted bounds[lo:hi] are at most doc_id, plus lo: a tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col("doc_id") < F.lit(bounds[mid]), _cut(bounds, lo, mid)).otherwise(_cut(bounds, mid + 1, hi))


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with a bucket that ascends with doc_id, and how many there may be:
    quantiles of the id, each cut evenly again where many rows need it."""
    found = docs.agg(F.count("*").alias("n")).first()["n"]
    cuts = min(MOST_CUTS, max(1, -(-found // DOCS_A_BUCKET)))
    finer = max(1, -(-found // (DOCS_A_BUCKET * cuts)))
    bounds: list[int] = []
    if cuts > 1:
        shares = [i / cuts for i in range(1, cuts)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20_000)).first()[0]))
    out = docs.withColumn("cut", _cut(bounds, 0, len(bounds)).cast("long"))
    if finer == 1:
        return out.withColumnRenamed("cut", "bucket"), cuts
    edge = F.array(*[F.lit(b) for b in [-(1 << 62), *bounds, 1 << 62]])
    low, high = F.get(edge, F.col("cut").cast("int")), F.get(edge, (F.col("cut") + 1).cast("int"))
    inner = F.floor((F.col("doc_id") - low).cast("double") * finer / (high - low).cast("double"))
    return out.withColumn("bucket", F.col("cut") * finer + F.greatest(F.lit(0), F.least(F.lit(finer - 1), inner))).drop("cut"), cuts * finer


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text and next_spots, the next document's.

    Each bucket also gets the first document of the following one, so a window
    inside buckets suffices and no task sees all rows.
    """
    body, buckets = _bucketed(docs)
    body = body.withColumn("tie", F.xxhash64("text"))
    firsts = body.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f"))
    # one row for each bucket
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("f.doc_id", "f.tie", F.coalesce(F.lag("bucket").over(order), last).alias("bucket"))
    before = F.broadcast(before) if buckets <= BUCKETS_TO_SEND else before
    border = body.drop("bucket").join(before, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    rows = body.withColumn("border", F.lit(0)).unionByName(border.select("doc_id", "text", "bucket", "tie", F.lit(1).alias("border")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_spots(rows.repartition(n, "bucket"), "text", "spots")
    w = Window.partitionBy("bucket").orderBy("border", "doc_id", "tie")
    return (
        rows.withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_spots", F.lead("spots").over(w))
        .where("border = 0")
        .select("doc_id", "text", "spots", "next_text", "next_spots")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars/2) code points
    replaced by as many first ones of the next document.
    """
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = with_next(body).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    return (
        with_spots(rows, "edited", "edited_spots")
        .select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
            likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        )
    )


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) between classes of equal fingerprints, and membership (doc_id, class).

    Sets are partitioned by length: partition i holds lengths from t**-i on, so
    similar sets lie in the same or in neighbouring ones.  In each, sets meet at
    the elements of their prefixes, rarest first, that any similar pair must share,
    and only where their lengths allow the threshold; each pair is compared once.
    Classes that meet at one element are compared with all others there, so their
    number there is what the cost grows with; copies are one class.
    """
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    body = with_spots(body, "text", "spots").select("doc_id", "spots")
    classes = body.groupBy("spots").agg(F.min("doc_id").alias("class"))
    members = body.join(classes, "spots").select("doc_id", "class")
    n = F.size("spots")
    sets = classes.select(F.xxhash64("spots").alias("node"), "class", "spots", n.alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    take = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1)
    each = sets.select("node", "n", band.alias("band"), take.alias("take"), F.explode("spots").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("node").orderBy("df", "s")
    keyed = each.join(often, "s").withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("take"))
    a = keyed.where("df > 1").select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "s")
    b = keyed.where("df > 1").select(F.col("node").alias("b"), F.col("n").alias("nb"), "band", "s")
    fits = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9
    met = a.join(b, ["band", "s"]).where(F.col("a") != F.col("b")).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = sets.select(F.col("node").alias("a"), F.col("class").alias("ca"), F.col("spots").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("class").alias("cb"), F.col("spots").alias("sb"))
    pairs = met.join(x, "a").join(y, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-12), members
