"""Structures as columns, boot sectors, snapshot catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filetime, guid, little
from ..functions.layout import STRUCTS, VSS_FLAG_PREFIX, VSS_FLAGS, VSS_RECORDS

_BYTES = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i32": 4, "ft": 8, "ref": 6}


def struct_fields(name: str, data: Column, at: int = 0) -> dict[str, Column]:
    """The fields of a structure that begins at byte ``at``, as column expressions."""
    out = {}
    for field, (offset, kind) in STRUCTS[name].items():
        begin = at + offset + 1
        if kind == "guid":
            out[field] = guid(F.substring(data, begin, 16))
        elif kind[0] == "b":
            out[field] = F.substring(data, begin, int(kind[1:]))
        else:
            value = little(data, begin, _BYTES[kind])
            if kind[0] == "i":
                top = 1 << (8 * _BYTES[kind] - 1)
                value = F.when(value >= top, value - 2 * top).otherwise(value)
            out[field] = value
    return out


def struct_text(name: str, data: Column, at: int = 0) -> Column:
    """A structure as lines of text, integers in hexadecimal."""
    lines = [F.lit(f"struct {name} @ {at:#x}:")]
    for field, value in struct_fields(name, data, at).items():
        kind = STRUCTS[name][field][1]
        if kind[0] == "b":
            continue
        shown = value if kind == "guid" else filetime(value).cast("string") if kind == "ft" else F.concat(F.lit("0x"), F.lower(F.hex(value)))
        lines.append(F.concat(F.lit(f"  {field}: "), F.coalesce(shown, F.lit("0"))))
    return F.concat_ws("\n", *lines)


def boot(sectors: DataFrame) -> DataFrame:
    """Boot sectors (data, other columns) with what they say of the volume, and
    what is wrong with them."""
    f = struct_fields("NTFS_BOOT_SECTOR", F.col("data"))
    rows = sectors.withColumns({f"_{k}": v for k, v in f.items()})
    size = F.col("__cluster_size") * F.col("_Sector_size")
    record = F.when(F.col("__mft_record_size") > 0, F.col("__mft_record_size") * F.col("cluster_size")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (-F.col("__mft_record_size")).cast("int")))
    rows = rows.withColumns({"sector_size": F.col("_Sector_size"), "cluster_size": size, "volume_sectors": F.col("__volume_size")})
    rows = rows.withColumns({
        "block_count": F.when(F.col("cluster_size") > 0, F.floor(F.col("volume_sectors") * F.col("sector_size") / F.col("cluster_size"))).cast("long"),
        "record_size": record, "mft_offset": F.col("__mft_cluster") * F.col("cluster_size"), "serial": F.hex("_Serial"),
    })
    error = (
        F.when(F.col("_Magic") != 0xAA55, F.lit("Invalid magic"))
        .when(~F.col("cluster_size").isin(*[1 << i for i in range(17)]), F.concat(F.lit("Invalid cluster size "), F.lower(F.hex("cluster_size"))))
        .when((F.col("sector_size") == 0) | (F.col("sector_size") % 512 != 0), F.lit("Invalid sector_size"))
        .when(F.coalesce("block_count", F.lit(0)) == 0, F.lit("Volume size is 0"))
    )
    return rows.withColumn("error", error).drop(*[f"_{k}" for k in f])


def snapshot_entries(blocks: DataFrame) -> DataFrame:
    """128-byte entries of snapshot catalogues (catalog, identifier, offset, data) by
    their type: 2 a store's volume, 3 where a store lies, others."""
    two, three = struct_fields("VSS_CATALOG_ENTRY_2", F.col("data")), struct_fields("VSS_CATALOG_ENTRY_3", F.col("data"))
    kind = two["EntryType"]
    of = lambda t, c: F.when(F.col("entry_type") == t, c)
    rows = blocks.withColumn("entry_type", kind)
    store = F.when(F.col("entry_type").isin(2, 3), two["StoreGUID"])
    return rows.select(
        "catalog", "offset", "entry_type", store.alias("store_guid"), of(2, two["VolumeSize"]).alias("volume_size"), of(2, filetime(two["CreationTime"])).alias("created"),
        *[of(3, three[k]).alias(n) for k, n in (("StoreBlockListOffset", "block_list"), ("StoreHeaderOffset", "header"), ("StoreBlockRangeListOffset", "ranges"), ("StoreBitmapOffset", "bitmap"),
                                                ("NTFSFileReference", "file_reference"), ("AllocatedSize", "allocated_size"), ("StorePreviousBitmapOffset", "previous_bitmap"))],
        of(2, F.concat(F.lit("System Volume Information/"), store, F.col("identifier"))).alias("store_path"),
    )


def snapshot_stores(stores: DataFrame) -> DataFrame:
    """Store files (id, data: their first bytes) to their block header and description."""
    head, info = struct_fields("VSS_STORE_BLOCK_HEADER", F.col("data")), struct_fields("VSS_STORE_INFORMATION", F.col("data"), 128)
    kinds = F.create_map(*[x for k, n in VSS_RECORDS.items() for x in (F.lit(k).cast("long"), F.lit(n))])
    flags = [F.when(info["AttributeFlags"].bitwiseAND(m) != 0, F.lit(VSS_FLAG_PREFIX + n)) for m, n in VSS_FLAGS.items()]
    return stores.select(
        "id", head["Identifier"].alias("identifier"), head["Version"].alias("version"), F.coalesce(F.try_element_at(kinds, head["RecordType"]), F.lit("Unknown")).alias("record_type"),
        head["SizeOfStore"].alias("size"), info["ShadowCopyGUID"].alias("copy_guid"), info["ShadowCopySetGUID"].alias("set_guid"), info["SnapshotContext"].alias("context"),
        F.array_join(F.array_sort(F.filter(F.array(*flags), lambda x: x.isNotNull())), ",").alias("flags"),
    )
