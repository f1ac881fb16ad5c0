"""Byte address spaces on any storage that Arrow's file systems reach.

A space is a file, or a folder of files named by the offset of their first byte
(``0x0012f000.bin``, ``65536.usn``): split images, recorded pages, ranges of a
journal.  What no file holds, and what lies past the end, reads as zeros.

A name with a size too (``0x0012f000-65536.packed``) is that of a packed file: so
many bytes as blocks of PACKED_BLOCK, each compressed alone, then the blocks'
sizes and their number as 32-bit integers.  Any range of it can be read.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs

_NAME = re.compile(r"^(0x[0-9a-fA-F]+|\d+)(?:-(\d+)\.packed|\.[a-z]+)$")
OPEN_FILES, PACKED_BLOCK = 8, 64 << 10


@dataclass(frozen=True)
class Segment:
    base: int
    path: str
    size: int
    packed: bool = False

    @property
    def end(self) -> int:
        return self.base + self.size


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def segments(path: str) -> list[Segment]:
    """The files of a space, ascending.  A path that does not exist raises."""
    fs, place = file_system(path)
    info = fs.get_file_info(place)
    if info.type == arrow_fs.FileType.File:
        return [Segment(0, place, info.size)]
    if info.type != arrow_fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = [(f, _NAME.match(f.base_name)) for f in fs.get_file_info(arrow_fs.FileSelector(place)) if f.type == arrow_fs.FileType.File]
    return sorted((Segment(int(m[1], 0 if m[1][:2].lower() == "0x" else 10), f.path, int(m[2]) if m[2] else f.size, bool(m[2])) for f, m in found if m), key=lambda s: s.base)


class Packer:
    """Writes a packed file block by block, so no more than a block is held."""

    def __init__(self, sink):
        self.sink, self.codec, self.held, self.size, self.blocks = sink, pa.Codec("zstd", 3), bytearray(), 0, []

    def add(self, data: bytes) -> None:
        self.held += data
        self.size += len(data)
        while len(self.held) >= PACKED_BLOCK:
            self._block(PACKED_BLOCK)

    def _block(self, n: int) -> None:
        body = self.codec.compress(bytes(self.held[:n]), asbytes=True)
        del self.held[:n]
        self.sink.write(body)
        self.blocks.append(len(body))

    def close(self) -> None:
        if self.held:
            self._block(len(self.held))
        self.sink.write(struct.pack(f"<{len(self.blocks)}II", *self.blocks, len(self.blocks)))
        self.sink.close()


class _Unpacked:
    """Random reads of a packed file; the last block stays unpacked."""

    def __init__(self, file, size: int):
        self.file, self.size, self.codec, self.last = file, size, pa.Codec("zstd"), (-1, b"")
        whole = file.size()
        count = int.from_bytes(file.read_at(4, whole - 4), "little")
        sizes = np.frombuffer(file.read_at(4 * count, whole - 4 - 4 * count), "<u4").astype(np.int64)
        self.bound = [0, *np.cumsum(sizes).tolist()]

    def read_at(self, n: int, offset: int) -> bytes:
        end, out = min(offset + n, self.size), bytearray()
        if offset >= end:
            return b""
        first, stop = offset // PACKED_BLOCK, -(-end // PACKED_BLOCK)
        begin = self.bound[first]
        body = None
        for k in range(first, stop):
            if self.last[0] != k:
                body = self.file.read_at(self.bound[stop] - begin, begin) if body is None else body
                size = min(PACKED_BLOCK, self.size - k * PACKED_BLOCK)
                self.last = k, self.codec.decompress(body[self.bound[k] - begin : self.bound[k + 1] - begin], size, asbytes=True)
            at = k * PACKED_BLOCK
            out += self.last[1][max(offset - at, 0) : end - at]
        return bytes(out)

    def close(self) -> None:
        self.file.close()


class Space:
    """Random reads of a space; ``shift`` is where its first byte lies in the files."""

    def __init__(self, path: str, shift: int = 0, parts: list[Segment] | None = None):
        self.fs, _ = file_system(path)
        self.parts = segments(path) if parts is None else parts
        self.shift, self.open = shift, {}
        self._bases = [s.base for s in self.parts]
        self._ends = list(accumulate((s.end for s in self.parts), max))  # files may overlap

    @property
    def size(self) -> int:
        return max((s.end for s in self.parts), default=0) - self.shift

    def dense(self) -> list[tuple[int, int]]:
        """(begin, end) of what files hold, joined where they touch."""
        out: list[tuple[int, int]] = []
        for s in self.parts:
            a, b = max(0, s.base - self.shift), s.end - self.shift
            if b <= a:
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _file(self, part: Segment):
        if part.path not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.pop(next(iter(self.open))).close()
            file = self.fs.open_input_file(part.path)
            self.open[part.path] = _Unpacked(file, part.size) if part.packed else file
        return self.open[part.path]

    def _near(self, begin: int, end: int) -> list[Segment]:
        """The segments that may hold bytes of a range, in order: found by search, as a volume may have thousands."""
        first = bisect_right(self._ends, begin)
        return self.parts[first : bisect_left(self._bases, end)]

    def read(self, offset: int, size: int) -> bytes:
        """``size`` bytes; before the space there is nothing."""
        if offset < 0:
            return b""
        begin = offset + self.shift
        out = None
        for s in self._near(begin, begin + size):
            a, b = max(begin, s.base), min(begin + size, s.end)
            if a >= b:
                continue
            body = self._file(s).read_at(b - a, a - s.base)
            if a == begin and b == begin + size and len(body) == size:
                return body
            out = bytearray(size) if out is None else out
            out[a - begin : a - begin + len(body)] = body
        return bytes(size) if out is None else bytes(out)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()


@dataclass(frozen=True)
class Image:
    """The disk of a volume: tasks read from the space what they need of it."""

    path: str
    shift: int = 0


def bounds(filters: list, column: str, low: int, high: int) -> tuple[int, int, list]:
    """The closed range of an integer column that pushed filters leave, and the
    filters that are not of this kind."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

    rest = []
    for f in filters:
        kind = type(f)
        if getattr(f, "attribute", None) != (column,) or kind not in (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual):
            rest.append(f)
        elif kind is In:
            low, high = max(low, min(f.value)), min(high, max(f.value))
            rest.append(f)  # the range has more than these
        else:
            low = max(low, f.value + (kind is GreaterThan)) if kind in (EqualTo, GreaterThan, GreaterThanOrEqual) else low
            high = min(high, f.value - (kind is LessThan)) if kind in (EqualTo, LessThan, LessThanOrEqual) else high
    return low, high, rest
