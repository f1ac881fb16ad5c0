"""A corpus pipeline of five of the training-data operators.

Each stage takes the documents that the stage before kept and returns
documents (doc_id, text, lang, source, n_chars); the last returns packed pieces.
Results of stages are written as Parquet and read again.

Defined results of every stage: a null doc_id counts as 0 from then on; a row goes
or stays for its own text, not for another row's of the same doc_id, and rows that
are alike in both share their fate; null and empty texts go in the first stage,
and any later one would keep them; texts of any length are handled whole; an empty
table gives an empty one; columns other than the five are left out.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.llm import decontaminate, language, packing
from sectorlake.llm.common import keep
from sectorlake.llm.jaccard import jaccard_groups
from sectorlake.llm.substrings import dedup_substrings
from sectorlake.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: no letter (null and empty
    texts too), or two languages alike.  Without labelled texts to learn from, all go."""
    ship(spark)
    model, docs = language.train(docs), _rows(docs)
    found = language.identify(docs.withColumn("doc_id", F.col("row")), model)
    rejected = found.where("lang_pred = 'und' or ambiguous").select(F.col("doc_id").alias("row")).distinct()
    return docs.join(rejected, "row", "left_anti").select(COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with the key ``row`` of each id and text."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), *COLUMNS[1:])
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the
    smallest doc_id stays, with every row that repeats it in the group.  Texts without
    words are in no group."""
    ship(spark)
    docs = _rows(docs)
    groups = jaccard_groups(docs.select(F.col("row").alias("doc_id"), "text"), 5, Fraction(4, 5))
    named = groups.select(F.col("doc_id").alias("row"), "component_id").distinct().join(docs.select("row", "doc_id").distinct(), "row")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    copies = named.join(least, "component_id").where("doc_id > least").select("row").distinct()
    return docs.join(copies, "row", "left_anti").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has go; texts
    of which nothing is left go too.  Texts that lose nothing stay byte for byte, others
    are their words with one space between them."""
    ship(spark)
    rest = dedup_substrings(docs, keep_text=True, carry=("lang", "source"))
    rest = rest.where("n_removed = 0 or n_removed < n_words")
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty items match none."""
    ship(spark)
    docs = _rows(docs)
    found = decontaminate.contaminated(docs.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids by best fit; rows that repeat a doc_id are packed each."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("contamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Tokenization and fitted models cannot be said in SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs)
    return docs
