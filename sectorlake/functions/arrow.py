"""Arrow kernels as steps of a DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PORTION = 1 << 18
_NAMES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}


def type_name(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return "struct<" + ", ".join(f"{f.name}: {type_name(f.type)}" for f in kind) + ">"
    if pa.types.is_list(kind):
        return f"array<{type_name(kind.value_type)}>"
    return _NAMES[kind]


def ddl(kinds: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"`{n}` {type_name(t)}" for n, t in kinds)


def batch(kinds: list[tuple[str, pa.DataType]], values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for (_, t), v in ((k, values[k[0]]) for k in kinds)], names=[n for n, _ in kinds])


def columns(part: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [part.column(part.schema.get_field_index(n)) for n in names]


def numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
    return columns(part, name)[0].fill_null(0).to_numpy(zero_copy_only=False)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so a kernel's working memory is bounded."""
    for part in batches:
        for a in range(0, part.num_rows, rows):
            yield part.slice(a, rows)


def portions(batches: Iterator[pa.RecordBatch], rows: int, column: str, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices as above in which a binary column has at most ``size`` bytes, or one row."""
    for part in pieces(batches, rows):
        past = np.cumsum(pc.fill_null(pc.binary_length(columns(part, column)[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a, before = 0, 0
        while a < part.num_rows:
            b = max(a + 1, int(np.searchsorted(past, before + size, "right")))
            yield part.slice(a, b - a)
            a, before = b, past[b - 1]


class Step(NamedTuple):
    """A kernel that gives the columns ``kinds`` for a slice of rows; with ``weigh``,
    slices are bounded by the bytes of that binary column too."""

    kinds: list[tuple[str, pa.DataType]]
    kernel: Callable[[pa.RecordBatch], dict]
    rows: int = 4096
    weigh: str | None = None

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, self.rows, self.weigh) if self.weigh else pieces(batches, self.rows):
            yield batch(self.kinds, self.kernel(part))


def mapped(df: DataFrame, kinds: list[tuple[str, pa.DataType]], kernel: Callable[[pa.RecordBatch], dict], rows: int = 4096, weigh: str | None = None) -> DataFrame:
    """df through one step."""
    return chained(df, Step(kinds, kernel, rows, weigh))


def chained(df: DataFrame, *steps: Step) -> DataFrame:
    """df through steps in one Python worker: each takes what the step before gives,
    a slice at a time.  Steps mapped apart have a worker each, and whole Arrow
    batches between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step.run(batches)
        return batches

    return df.mapInArrow(run, ddl(steps[-1].kinds))
