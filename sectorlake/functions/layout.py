"""Fixed values of the on-disk format: field offsets, enumerations, flags, limits."""

from __future__ import annotations

# Offset and kind of the fields of each structure.  Kinds: uN and
# iN are little-endian integers of N bits, ref the low 48 bits of a reference,
# ft a count of 100 ns since 1601, guid 16 bytes, bN N raw bytes.
STRUCTS: dict[str, dict[str, tuple[int, str]]] = {
    "NTFS_BOOT_SECTOR": {
        "Oemname": (3, "b8"), "Sector_size": (11, "u16"), "_cluster_size": (13, "u8"), "_volume_size": (40, "u64"), "_mft_cluster": (48, "u64"),
        "_mirror_mft_cluster": (56, "u64"), "_mft_record_size": (64, "i8"), "Index_record_size": (68, "u8"), "Serial": (72, "b8"), "Magic": (510, "u16"),
    },
    "MFT_ENTRY": {
        "Magic": (0, "b4"), "Fixup_offset": (4, "u16"), "Fixup_count": (6, "u16"), "Logfile_sequence_number": (8, "u64"), "Sequence_value": (16, "u16"),
        "Link_count": (18, "u16"), "Attribute_offset": (20, "u16"), "Flags": (22, "u16"), "Mft_entry_size": (24, "u16"), "Mft_entry_allocated": (28, "u16"),
        "Base_record_reference": (32, "u64"), "Next_attribute_id": (40, "u16"), "Record_number": (44, "u32"),
    },
    "NTFS_ATTRIBUTE": {
        "Type": (0, "u32"), "Length": (4, "u32"), "Resident": (8, "u8"), "name_length": (9, "u8"), "name_offset": (10, "u16"), "Flags": (12, "u16"),
        "Attribute_id": (14, "u16"), "Content_size": (16, "u32"), "Content_offset": (20, "u16"), "Runlist_vcn_start": (16, "u64"), "Runlist_vcn_end": (24, "u64"),
        "Runlist_offset": (32, "u16"), "Compression_unit_size": (34, "u16"), "Allocated_size": (40, "u64"), "Actual_size": (48, "u64"), "Initialized_size": (56, "u64"),
    },
    "NTFS_RESIDENT_ATTRIBUTE": {
        "Type": (0, "u32"), "Length": (4, "u32"), "Resident": (8, "u8"), "name_length": (9, "u8"), "name_offset": (10, "u16"), "Flags": (12, "u16"),
        "Attribute_id": (14, "u16"), "content_size": (16, "u32"), "content_offset": (20, "u16"),
    },
    "STANDARD_INFORMATION": {
        "Create_time": (0, "ft"), "File_altered_time": (8, "ft"), "Mft_altered_time": (16, "ft"), "File_accessed_time": (24, "ft"), "Flags": (32, "u32"),
        "Max_versions": (36, "u32"), "Version": (40, "u32"), "Class_id": (44, "u32"), "Owner_id": (48, "u32"), "Sid": (52, "u32"), "Quota": (56, "u64"), "Usn": (64, "u32"),
    },
    "FILE_NAME": {
        "MftReference": (0, "ref"), "Seq_num": (6, "u16"), "Created": (8, "ft"), "File_modified": (16, "ft"), "Mft_modified": (24, "ft"), "File_accessed": (32, "ft"),
        "Allocated_size": (40, "u64"), "FilenameSize": (48, "u64"), "Flags": (56, "u32"), "Reparse_value": (60, "u32"), "_length_of_name": (64, "u8"), "NameType": (65, "u8"),
    },
    "ATTRIBUTE_LIST_ENTRY": {
        "Type": (0, "u32"), "Length": (4, "u16"), "Name_length": (6, "u8"), "Offset_to_name": (7, "u8"), "Starting_vcn": (8, "u64"), "MftReference": (16, "ref"), "Attribute_id": (24, "u16"),
    },
    "INDEX_ROOT": {"Type": (0, "u32"), "Collation_rule": (4, "u32"), "Idxalloc_size_b": (8, "u32"), "Idx_size_c": (12, "u32")},
    "STANDARD_INDEX_HEADER": {"Magicnumber": (0, "b4"), "Fixup_offset": (4, "u16"), "Fixup_count": (6, "u16"), "Logfile_sequence_number": (8, "u64"), "VcnOfINDX": (16, "u64")},
    "INDEX_NODE_HEADER": {"Offset_to_index_entry": (0, "u32"), "Offset_to_end_index_entry": (4, "u32"), "SizeOfEntriesAlloc": (8, "i32")},
    "INDEX_RECORD_ENTRY": {"MftReference": (0, "ref"), "Seq_num": (6, "u16"), "SizeOfIndexEntry": (8, "u16"), "FilenameOffset": (10, "u16"), "Flags": (12, "u32")},
    "USN_RECORD_V2": {
        "RecordLength": (0, "u32"), "MajorVersion": (4, "u16"), "MinorVersion": (6, "u16"), "FileReferenceNumberID": (8, "ref"), "FileReferenceNumberSequence": (14, "u16"),
        "ParentFileReferenceNumberID": (16, "ref"), "ParentFileReferenceNumberSequence": (22, "u16"), "Usn": (24, "u64"), "TimeStamp": (32, "ft"), "Reason": (40, "u32"),
        "SourceInfo": (44, "u32"), "SecurityId": (48, "u32"), "FileAttributes": (52, "u32"), "FileNameLength": (56, "u16"), "FileNameOffset": (58, "u16"),
    },
    "GUID": {"Data1": (0, "u32"), "Data2": (4, "u16"), "Data3": (6, "u16"), "Data4": (8, "b8")},
    "VSS_VOLUME_HEADER": {
        "Identifier": (0, "guid"), "Version": (16, "u32"), "RecordType": (20, "u32"), "CurrentOffset": (24, "u64"), "CatalogOffset": (48, "u64"), "MaxSize": (56, "u64"),
        "VolumeGUID": (64, "guid"), "ShadowVolumeGUID": (80, "guid"),
    },
    "VSS_CATALOG_HEADER": {"Identifier": (0, "guid"), "Version": (16, "u32"), "RecordType": (20, "u32"), "RelativeOffset": (24, "u64"), "CurrentOffset": (32, "u64"), "NextOffset": (40, "u64")},
    "VSS_CATALOG_ENTRY_1": {"EntryType": (0, "u64")},
    "VSS_CATALOG_ENTRY_2": {"EntryType": (0, "u64"), "VolumeSize": (8, "u64"), "StoreGUID": (16, "guid"), "CreationTime": (48, "ft")},
    "VSS_CATALOG_ENTRY_3": {
        "EntryType": (0, "u64"), "StoreBlockListOffset": (8, "u64"), "StoreGUID": (16, "guid"), "StoreHeaderOffset": (32, "u64"), "StoreBlockRangeListOffset": (40, "u64"),
        "StoreBitmapOffset": (48, "u64"), "NTFSFileReference": (56, "u64"), "AllocatedSize": (64, "u64"), "StorePreviousBitmapOffset": (72, "u64"),
    },
    "VSS_STORE_BLOCK_HEADER": {
        "Identifier": (0, "guid"), "Version": (16, "u32"), "RecordType": (20, "u32"), "RelativeOffset": (24, "u64"), "CurrentOffset": (32, "u64"), "NextOffset": (40, "u64"), "SizeOfStore": (48, "u64"),
    },
    "VSS_STORE_INFORMATION": {"ShadowCopyGUID": (16, "guid"), "ShadowCopySetGUID": (32, "guid"), "SnapshotContext": (48, "u64"), "AttributeFlags": (56, "u32")},
}
# Attribute types.
ATTRIBUTE_TYPES = {
    16: "$STANDARD_INFORMATION", 32: "$ATTRIBUTE_LIST", 48: "$FILE_NAME", 64: "$OBJECT_ID", 80: "$SECURITY_DESCRIPTOR", 96: "$VOLUME_NAME",
    112: "$VOLUME_INFORMATION", 128: "$DATA", 144: "$INDEX_ROOT", 160: "$INDEX_ALLOCATION", 176: "$BITMAP", 192: "$REPARSE_POINT",
    208: "$EA_INFORMATION", 224: "$EA", 256: "$LOGGED_UTILITY_STREAM",
}
SI, ATTRIBUTE_LIST, FILE_NAME, DATA, INDEX_ROOT, INDEX_ALLOCATION = 16, 32, 48, 128, 144, 160
NAME_TYPES = {0: "POSIX", 1: "Win32", 2: "DOS", 3: "DOS+Win32"}
LONG_NAMES = (0, 1, 3)
# Flags of a record and of an attribute (bits).
RECORD_FLAGS = {0: "ALLOCATED", 1: "DIRECTORY"}
ATTRIBUTE_FLAGS = {0: "COMPRESSED", 14: "ENCRYPTED", 15: "SPARSE"}
COMPRESSED, SPARSE = 1, 1 << 15
# File flags (masks).
FILE_FLAGS = {
    1: "READ_ONLY", 2: "HIDDEN", 4: "SYSTEM", 32: "ARCHIVE", 64: "DEVICE", 128: "NORMAL", 256: "TEMPORARY", 512: "SPARSE",
    1024: "REPARSE_POINT", 2048: "COMPRESSED", 4096: "OFFLINE", 8192: "NOT_INDEXED", 16384: "ENCRYPTED",
}
# Journal reasons (bits).
USN_REASONS = {
    0: "DATA_OVERWRITE", 1: "DATA_EXTEND", 2: "DATA_TRUNCATION", 4: "NAMED_DATA_OVERWRITE", 5: "NAMED_DATA_EXTEND", 6: "NAMED_DATA_TRUNCATION",
    8: "FILE_CREATE", 9: "FILE_DELETE", 10: "EA_CHANGE", 11: "SECURITY_CHANGE", 12: "RENAME_OLD_NAME", 13: "RENAME_NEW_NAME",
    14: "INDEXABLE_CHANGE", 15: "BASIC_INFO_CHANGE", 16: "HARD_LINK_CHANGE", 17: "COMPRESSION_CHANGE", 18: "ENCRYPTION_CHANGE",
    19: "OBJECT_ID_CHANGE", 20: "REPARSE_POINT_CHANGE", 21: "STREAM_CHANGE", 31: "CLOSE",
}
# Sources of a change, and attributes of the changed file (bits).
USN_SOURCES = {0: "DATA_MANAGEMENT", 1: "AUXILIARY_DATA", 2: "REPLICATION_MANAGEMENT"}
USN_ATTRIBUTES = {
    0: "READONLY", 1: "HIDDEN", 2: "SYSTEM", 4: "DIRECTORY", 5: "ARCHIVE", 6: "DEVICE", 7: "NORMAL", 8: "TEMPORARY", 9: "SPARSE_FILE", 10: "REPARSE_POINT",
    11: "COMPRESSED", 12: "OFFLINE", 13: "NOT_CONTENT_INDEXED", 14: "ENCRYPTED", 15: "INTEGRITY_STREAM", 16: "VIRTUAL", 17: "NO_SCRUB_DATA",
}
# Kinds of a snapshot's blocks, and a snapshot's attributes (masks).
VSS_RECORDS = {1: "VolumeHeader", 2: "CatalogBlockHeader", 3: "BlockDescriptorList", 4: "StoreHeader", 5: "StoreBlockRangesList", 6: "StoreBitmap"}
VSS_FLAGS = {
    1: "PERSISTENT", 2: "NO_AUTORECOVERY", 4: "CLIENT_ACCESSIBLE", 8: "NO_AUTO_RELEASE", 16: "NO_WRITERS", 32: "TRANSPORTABLE", 64: "NOT_SURFACED", 128: "NOT_TRANSACTED",
    65536: "HARDWARE_ASSISTED", 131072: "DIFFERENTIAL", 262144: "PLEX", 524288: "IMPORTED", 1048576: "EXPOSED_LOCALLY", 2097152: "EXPOSED_REMOTELY",
    4194304: "AUTORECOVER", 8388608: "ROLLBACK_RECOVERY", 16777216: "DELAYED_POSTSNAPSHOT", 33554432: "TXF_RECOVERY",
}
VSS_FLAG_PREFIX = "VSS_VOLSNAP_ATTR_"
VSS_HEADER, VSS_BLOCK, VSS_ENTRY = 0x1E00, 0x4000, 128

RECORD_SIZE, PAGE_SIZE, SECTOR, CLUSTER = 1024, 4096, 512, 4096
ROOT = 5
ROOTS = (5, 0)  # a name whose parent has one of these numbers ends a path
EPOCH = 116_444_736_000_000_000  # 1970 in units of 100 ns since 1601
MAX_LINKS, MAX_DEPTH, MAX_PIECES = 20, 20, 21
MAX_UNIT, MAX_RUNLIST, MAX_RECORD, LEAST_RECORD = 1_000_000, 1_000_000, 32 << 10, 0x100
WILD_ATTR, WILD_STREAM = 0xFFFF, ":*:"
