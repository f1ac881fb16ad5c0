"""Column expressions over raw values: integers in binary, times, flags, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import EPOCH


def little(data: Column, at: int, width: int) -> Column:
    """Unsigned little-endian integer whose first byte is byte ``at``, counted from 1 (8 bytes: two's complement)."""
    digits = F.concat(*[F.hex(F.substring(data, at + width - 1 - i, 1)) for i in range(width)])
    return F.conv(digits, 16, -10).cast("bigint")


def filetime(ft: Column) -> Column:
    """Timestamp of a count of 100 ns since 1601; null for 0."""
    micros = F.floor(F.try_subtract(ft, F.lit(EPOCH)) / F.lit(10).cast("decimal(20,0)")).cast("bigint")
    return F.when(ft != 0, F.timestamp_micros(micros).cast("timestamp_ntz"))


def to_filetime(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(EPOCH)


def flag_names(value: Column, names: dict[int, str], bits: bool = False) -> Column:
    """Sorted names of the flags that are set."""
    made = [F.when(value.bitwiseAND(F.lit(1 << k if bits else k).cast("bigint")) != 0, F.lit(n)) for k, n in names.items()]
    return F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull()))


def flag_text(value: Column, names: dict[int, str]) -> Column:
    return F.concat(value.cast("string"), F.lit(" ("), F.array_join(flag_names(value, names), ","), F.lit(")"))


def guid(data: Column) -> Column:
    """{8-4-4-4-12} in lower case; the first three groups are little-endian."""
    byte = lambda i: F.lower(F.hex(F.substring(data, i + 1, 1)))
    groups = ((3, 2, 1, 0), (5, 4), (7, 6), (8, 9), (10, 11, 12, 13, 14, 15))
    return F.concat(F.lit("{"), F.concat_ws("-", *[F.concat(*[byte(i) for i in g]) for g in groups]), F.lit("}"))


def inode(entry: Column, kind: Column, attr: Column, name: Column, repeat: Column) -> Column:
    """id-type-attribute; the stream's name only from the second of equal ones on."""
    base = F.concat_ws("-", entry.cast("string"), kind.cast("string"), attr.cast("string"))
    return F.when((repeat > 1) & (name != ""), F.concat(base, F.lit(":"), name)).otherwise(base)


def parse_inode(text: Column) -> dict[str, Column]:
    """entry[-type[-id]][:stream] with defaults 128, 0xffff and :*: ; nulls where malformed."""
    shape = r"^(\d+)(?:-(\d+)(?:-(\d+))?)?(?::(.*))?$"
    ok = text.rlike(shape)
    part = lambda i, default: F.when(ok, F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit(default)))
    return {"entry": part(1, "0").cast("bigint"), "type": part(2, "128").cast("bigint"), "attr": part(3, "65535").cast("bigint"), "stream": part(4, ":*:")}


def capped(value: Column, most: int) -> Column:
    return F.least(value, F.lit(most).cast("bigint"))


def ended_text(data: Column) -> Column:
    """Latin-1 text up to its first zero byte."""
    return F.substring_index(F.decode(data, "ISO-8859-1"), "\0", 1)


def path_parts(path: Column) -> Column:
    """Components of a path with / or \\ between them, without a stream's name."""
    plain = F.regexp_replace(F.substring_index(path, ":", 1), r"\\", "/")
    return F.filter(F.split(plain, "/"), lambda c: ~c.isin("", "."))
