"""Token ids with the tokenizers library, and their files in ORC.

A tokenizer that splits on white space gives a text the ids of its words one after
another.  Probes find out whether one does, whether it folds case, and whether it
splits off full stops and commas.  If it does, the distinct words of a chunk are
encoded once, many in one call with a special token between them, and the ids are
then dealt to the words; a worker remembers the words it met.  Texts that may hold
a special token, and all texts of other tokenizers, are encoded whole.

The path of the vocabulary file is a parameter.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import until_exit
from .common import _BYTE_MUL, _TABLE, U64, Words, chunked, column, fresh_path, ids_of, keep, run_hash

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WORDS_A_CALL = 512
_PROBE = "It's the 3rd  \tÉté-été,\nnaïve... don't! x1y22  áb | ÀÇ"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Tokenizer:
    """A tokenizer and what probes say of it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [(t.content, i) for i, t in self.tok.get_added_tokens_decoder().items()]
        self.pattern = "|".join(re.escape(c) for c, _ in self.specials)
        words = [w.decode() for w in _PROBE.encode().split()]
        parts = [self.ids(w) for w in words]
        self.folds = self._normal(string.ascii_uppercase) == self._normal(string.ascii_lowercase)
        self.tails = all(self._alike(w + t, [w, t]) for w in ("word", "x1", "9", "Ab") for t in ".,")
        self.mark = next(((c, i) for c, i in self.specials if self.ids(c.join(words) + c) == [x for p in parts for x in (*p, i)]), None)
        self.by_words = self.mark is not None and self._alike(_PROBE, words)

    def _normal(self, text: str) -> str:
        return self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text

    def _pieces(self, text: str) -> list[str]:
        """What the model is given, whether it knows it or not."""
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self._normal(text))] if self.tok.pre_tokenizer else [text]

    def _alike(self, text: str, parts: list[str]) -> bool:
        return self.ids(text) == [i for p in parts for i in self.ids(p)] and self._pieces(text) == [x for p in parts for x in self._pieces(p)]

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


def encode(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk of texts (null: no ids), and where each text's begin."""
    t = _tokenizer(path)
    if not t.by_words:
        out = [e.ids for e in t.tok.encode_batch(text.fill_null("").to_pylist(), add_special_tokens=False)]
        size = np.array([len(x) for x in out], dtype=np.int64)
        return np.fromiter((i for x in out for i in x), np.uint32, int(size.sum())), np.concatenate([[0], np.cumsum(size)])
    text = text.fill_null("")
    marked = pc.match_substring_regex(text, t.pattern, ignore_case=True).to_numpy(zero_copy_only=False)
    if marked.any():  # may hold a special token: encode these whole
        flat, first = encode(pc.if_else(pa.array(marked), "", text), path)
        whole = {int(i): t.ids(text[int(i)].as_py()) for i in np.flatnonzero(marked)}
        parts = [np.array(whole[i], np.uint32) if i in whole else flat[first[i] : first[i + 1]] for i in range(len(text))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    w = Words(text, lower=t.folds, hashed=False)
    start, end, first = _without_tails(w) if t.tails else (w.start, w.end, w.first)
    value = run_hash(_TABLE[w.buf], start, end, _BYTE_MUL)
    one, begin, back = np.unique(value, return_index=True, return_inverse=True)
    known = _known.get(path)
    if known is None or known.full():
        known = _known[path] = _Known()
    at = known.find(one)
    if (new := np.flatnonzero(at < 0)).size:
        raw = w.buf.tobytes()
        words = [raw[a:b].decode() for a, b in zip(start[begin[new]].tolist(), end[begin[new]].tolist(), strict=True)]
        known.add(one[new], *_encode_words(words, t.tok, t.mark))
        at = known.find(one)
    begin, n = known.begin[at][back], known.size[at][back]
    total = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(begin - total[:-1], n) + np.arange(total[-1])
    return known.flat[rows], total[first]


def _without_tails(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a full stop or comma after a letter or digit as a word of its
    own: the tokenizer splits there, and fewer distinct words remain."""
    inner = np.zeros(256, dtype=bool)
    inner[[*range(97, 123), *range(65, 91), *range(48, 58)]] = True
    last = w.buf[w.end - 1]
    tail = np.flatnonzero(((last == 46) | (last == 44)) & (w.end - w.start > 1) & inner[w.buf[w.end - 2]])
    end = w.end.copy()
    end[tail] -= 1
    start = np.insert(w.start, tail + 1, end[tail])
    end = np.insert(end, tail + 1, w.end[tail])
    return start, end, w.first + np.searchsorted(tail, w.first)


def _encode_words(words: list[str], tok, special: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and how many each has."""
    mark, mark_id = special
    calls = [mark.join(words[i : i + WORDS_A_CALL]) + mark for i in range(0, len(words), WORDS_A_CALL)]
    flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in tok.encode_batch(calls, add_special_tokens=False)])
    stops = np.flatnonzero(flat == mark_id)
    return np.delete(flat, stops), np.diff(np.concatenate([[-1], stops])) - 1


class _Known:
    """Ids of the words this worker has met, at most MOST of them: then it starts anew."""

    MOST = 1 << 20

    def __init__(self):
        self.hash, self.begin, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(value), -1)
        at = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        return np.where(self.hash[at] == value, at, -1)

    def add(self, value: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        begin = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        value, begin, size = (np.concatenate(x) for x in ((self.hash, value), (self.begin, begin), (self.size, size)))
        order = np.argsort(value, kind="stable")
        self.hash, self.begin, self.size = value[order], begin[order], size[order]

    def full(self) -> bool:
        return len(self.hash) > self.MOST


_known: dict[str, _Known] = {}


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            flat, first = encode(column(part, "text"), path)
            flat, first = append_end(flat, first, end_id)
            ids = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(part)), ids], names=["doc_id", "ids"])

    return run


def append_end(flat: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.insert(flat, first[1:], np.uint32(end_id))
    return out, first + np.arange(len(first))


def write_orc(docs: DataFrame, out: str, path: str, end_id: int = END_ID) -> None:
    """Token ids of whole texts as ORC in ``out``: one row for each document in
    ascending doc_id order, across files too (part numbers ascend).

    ids are an array of ints (run-length encoded), with row indexes every
    10,000 rows and a Bloom filter on doc_id, so a reader prunes stripes by
    their statistics and reads the others in parallel.
    """
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string"))
    # the text's hash lets rows that repeat one id spread over files
    tie = F.xxhash64("text")
    placed = body.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    (
        placed.mapInArrow(_encoded(path, end_id), "doc_id long, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(16 << 20))
        .orc(out)
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        ids = column(part, "ids")
        flat, edge = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        edge = edge - edge[0] if len(edge) else edge
        body = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
        crcs = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [column(part, "file"), column(part, "doc_id"), pa.array(np.diff(edge), pa.int64()), pa.array(crcs, pa.int64())],
            names=["file", "doc_id", "n_tokens", "ids_crc32"],
        )


def read_orc(spark, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    Files hold ascending ranges of doc_id, so start is the total of the files
    before plus a running sum inside the file.  Rows that repeat a doc_id follow
    one another in order of length and digest.
    """
    schema = "doc_id long, ids array<int>"
    raw = spark.read.schema(schema).orc(out).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids")
    rows = keep(raw.mapInArrow(_digests, "file string, doc_id long, n_tokens long, ids_crc32 long"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"))
    # one row for each file: as many as the writer had partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("file", before.alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("inside", inside)
        .join(totals, "file")
        .select("doc_id", (F.col("before") + F.col("inside") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ORC files to a fresh folder of the shared store and reads them back."""
    spark = docs.sparkSession
    out = fresh_path(spark, "tokens-orc")
    write_orc(docs, out, path or vocabulary_path(), end_id)
    until_exit(spark, out)
    return read_orc(spark, out)


def read_ids(spark, out: str, low: int, high: int) -> DataFrame:
    """(doc_id, ids) of a range of documents.  The filter reaches the ORC reader:
    files and stripes whose statistics exclude the range are not read, and for a
    single document the Bloom filters rule out row groups too."""
    return spark.read.schema("doc_id long, ids array<int>").orc(out).where(F.col("doc_id").between(low, high) if low != high else F.col("doc_id") == low)
