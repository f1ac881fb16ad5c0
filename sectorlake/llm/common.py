"""Text kernels and small Spark helpers shared by the training-data operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A chunk of
documents is handled as one byte buffer with NumPy, so the cost per word is a
few machine operations and the memory per task is bounded by ``CHUNK_BYTES``
of text (or by one document, when a single document is longer).
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import until_exit

CHUNK_BYTES = 2 << 20
TRIM_BYTES = 16 << 20
U64 = np.uint64
_BYTE_MUL = U64(0x9E3779B97F4A7C15)
_WORD_MUL = U64(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (xor-shift-multiply), as uint64."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown once per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        full = np.full(size, base, dtype=U64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, mul: U64) -> np.ndarray:
    """Hash of values[s:e] for every (s, e), by content only.

    A prefix sum of value * mul**-i makes every run's polynomial available in
    constant time; multiplying by mul**e cancels the position.
    """
    n = len(values)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * powers(_inverse(int(mul)), n), out=prefix[1:])
    body = (prefix[ends] - prefix[starts]) * powers(int(mul), n + 1)[ends]
    return mix64(body + (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of a chunk of documents.

    buf: uint8 bytes; start, end: byte range of each word; first: index of
    each document's first word (with one entry more than documents); hash: a
    64-bit hash of each word.
    """

    def __init__(self, text: pa.Array, lower: bool = False, separators: bytes = b"", hashed: bool = True):
        text = text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text
        n = len(text)
        _, offs, data = text.buffers()
        bound = np.frombuffer(offs, dtype=np.int64, count=n + 1 + text.offset)[text.offset :].copy() if n else np.zeros(1, np.int64)
        if text.null_count:  # a null's slot may hold bytes: close it up
            text = text.fill_null("")
            _, offs, data = text.buffers()
            bound = np.frombuffer(offs, dtype=np.int64, count=n + 1 + text.offset)[text.offset :].copy()
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = raw[bound[0] : bound[-1]]
        self.bound = bound - bound[0]
        table = np.arange(256, dtype=np.uint8)
        if lower:
            table[65:91] += 32
        blank = np.zeros(256, dtype=bool)
        blank[[32, 9, 10, 11, 12, 13, *separators]] = True
        if lower:
            self.buf = table[self.buf]
        space = blank[self.buf]
        size = len(space)
        before = np.ones(size, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(size, dtype=bool)
        after[:-1] = space[1:]
        inner = self.bound[(self.bound > 0) & (self.bound < size)]
        before[inner] = True
        after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, self.bound)
        self.space = space
        self.hash = run_hash(_TABLE[self.buf], self.start, self.end, _BYTE_MUL) if hashed else None

    @property
    def docs(self) -> int:
        return len(self.bound) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of k words inside one document."""
        n = len(self.start)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        at = np.flatnonzero(left >= k)
        return at, run_hash(self.hash, at, at + k, _WORD_MUL)


def give_back() -> None:
    """Freed memory goes back to the system: workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``limit`` bytes of text and ``rows`` rows each, or of one row.
    Memory that was freed goes back after every TRIM_BYTES of text and at the end."""
    seen = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.float64))
        group = (np.cumsum(sizes) // limit).astype(np.int64) * n + np.arange(n) // rows
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
                seen += sizes[a:b].sum()
                if seen > TRIM_BYTES:
                    seen = 0
                    give_back()
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return column(batch, name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset
    (tests, one machine) a folder beside the warehouse is set and used."""
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        have = spark.conf.get("spark.checkpoint.dir", None)
        if not have:
            have = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(have)
        have = spark.sparkContext.getCheckpointDir() or have
    return have


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the
    lineage and survives the loss of any executor.  The folder goes when the
    driver's JVM ends."""
    path = fresh_path(df.sparkSession, "kept")
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(mod: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo mod: the fold that splits learning from testing."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(mod)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
