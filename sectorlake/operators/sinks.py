"""Rows as text: journal blocks, JSON, CSV, tables, dumps; bytes to a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import EPOCH, RECORD_FLAGS, STRUCTS

ZERO_TIME = "0001-01-01 00:00:00 +0000 UTC"


def time_text(ft: Column) -> Column:
    """A count of 100 ns as 2023-06-23 02:04:24.8404724 +0000 UTC, without zeros at the end of the fraction."""
    seconds = F.floor(F.try_subtract(ft, F.lit(EPOCH)) / F.lit(10_000_000).cast("decimal(20,0)")).cast("bigint")
    fraction = F.regexp_replace(F.format_string(".%07d", F.pmod(ft, F.lit(10_000_000))), r"\.?0+$", "")
    stamp = F.date_format(F.timestamp_seconds(seconds).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return F.when(ft != 0, F.concat(stamp, fraction, F.lit(" +0000 UTC"))).otherwise(F.lit(ZERO_TIME))


def journal_text(records: DataFrame) -> DataFrame:
    """One block of text for each record of journal.named with ``full_path``."""
    listed = lambda c: F.regexp_replace(c, ",", ", ")
    lines = F.format_string(
        "\nUSN ID: %x @ %x\nFilename: %s\nFullPath: %s\nTimestamp: %s\nReason: %s\nFileAttributes: %s\nSourceInfo: %s\n",
        "usn", "offset", "name", "full_path", time_text(F.col("time")), listed("reasons"), listed("file_attributes"), listed("sources"),
    )
    return records.withColumn("text", lines)


def slack_label(name: Column, is_slack: Column, offset: Column) -> Column:
    """Names of entries in the slack say where."""
    return F.when(is_slack, F.format_string("%s (slack @ 0x%x)", name, offset)).otherwise(name)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def index_csv(info: DataFrame) -> DataFrame:
    """The columns of a listing of index entries, as they go to ``write.csv(header=True)``."""
    return info.select(
        slack_label(F.col("name"), F.col("is_slack"), F.col("slack_offset")).alias("Name"), F.col("name_type").alias("NameType"), F.col("size").cast("string").alias("Size"),
        F.col("allocated_size").cast("string").alias("AllocatedSize"), *[F.col(c.lower()).cast("string").alias(c) for c in ("Mtime", "Atime", "Ctime", "Btime")],
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines of CSV."""
    return rows.select(F.to_csv(F.struct(*rows.columns)).alias("value"))


def listing(rows: DataFrame) -> DataFrame:
    """The columns of a directory's table, of stat rows with ``full_path``; show() draws it."""
    return rows.select(F.col("mft_id").alias("MFT Id"), F.col("full_path").alias("FullPath"), F.col("size").alias("Size"), F.col("mtime").alias("Mtime"), F.col("is_dir").alias("IsDir"), F.col("name").alias("Filename"))


def table_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines of a table whose columns are as wide as their widest value: one
    aggregate finds the widths, a join of one row brings them."""
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    widths = text.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.char_length(f"c{i}")), F.lit(0))).alias(f"w{i}") for i, c in enumerate(rows.columns)]).first()
    cells = [F.concat(F.col(f"c{i}"), F.repeat(F.lit(" "), F.lit(widths[i]) - F.char_length(f"c{i}"))) for i in range(len(rows.columns))]
    return text.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def record_text(records: DataFrame) -> DataFrame:
    """Headers of decoded records as lines of text."""
    values = {
        "Fixup_offset": "fixup_offset", "Fixup_count": "fixup_count", "Logfile_sequence_number": "lsn", "Sequence_value": "seq", "Link_count": "links", "Attribute_offset": "attr_offset",
        "Flags": "flags", "Mft_entry_size": "used", "Mft_entry_allocated": "allocated", "Base_record_reference": None, "Next_attribute_id": "next_id", "Record_number": "number",
    }
    lines = [F.lit("struct MFT_ENTRY @ 0x0:")]
    for field in STRUCTS["MFT_ENTRY"]:
        if field == "Magic":
            continue
        value = (F.col("base") + F.col("base_seq").cast("long") * (1 << 48)) if values[field] is None else F.col(values[field])
        if field == "Flags":
            names = F.array_join(F.filter(F.array(*[F.when(value.bitwiseAND(1 << b) != 0, F.lit(n)) for b, n in RECORD_FLAGS.items()]), lambda x: x.isNotNull()), ",")
            shown = F.concat(value.cast("string"), F.lit(" ("), names, F.lit(")"))
        else:
            shown = F.concat(F.lit("0x"), F.lower(F.hex(value.cast("long"))))
        lines.append(F.concat(F.lit(f"  {field}: "), shown))
    return records.where("error is null").select("entry", F.concat_ws("\n", *lines).alias("text"))


def hex_dump(data: Column, limit: int = 100) -> Column:
    """The first bytes in lines of sixteen: offset, hexadecimal, printable characters."""
    body = F.substring(data, 1, limit)
    size = F.octet_length(body)

    def line(i: Column) -> Column:
        part = F.substring(body, i * 16 + 1, F.lit(16))
        n = F.octet_length(part)
        byte = lambda k: F.substring(part, k + 1, F.lit(1))
        spots = F.sequence(F.lit(0), F.lit(15))
        cells = F.transform(spots, lambda k: F.concat(F.when(k < n, F.lower(F.hex(byte(k)))).otherwise("  "), F.when(k == 7, "  ").otherwise(" ")))
        code = lambda k: F.conv(F.hex(byte(k)), 16, 10).cast("int")
        shown = F.transform(F.slice(spots, F.lit(1), n), lambda k: F.when(code(k).between(32, 126), F.char(code(k))).otherwise("."))
        return F.concat(F.lower(F.lpad(F.hex(i * 16), 8, "0")), F.lit("  "), F.array_join(cells, ""), F.lit(" |"), F.array_join(shown, ""), F.lit("|"))

    lines = F.transform(F.sequence(F.lit(0), F.ceil(size / 16).cast("int") - 1), line)
    return F.when(size > 0, F.array_join(lines, "\n")).otherwise("")


def write_bytes(chunks: DataFrame, path: str, offset: int = 0) -> int:
    """(offset, data) chunks of one stream from ``offset`` on to a local file, in
    order, one partition at a time in memory."""
    with open(path, "wb") as f:
        for row in chunks.where(F.col("offset") + F.octet_length("data") > offset).orderBy("offset").select("offset", "data").toLocalIterator():
            f.seek(max(0, row.offset - offset))
            f.write(row.data[max(0, offset - row.offset) :])
        return f.tell()
