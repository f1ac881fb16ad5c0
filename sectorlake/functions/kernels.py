"""Decoders of binary columns, a whole Arrow batch at a time with NumPy.

They never raise on any bytes and never read outside the row they are given:
what is missing reads as zero, eight-byte integers are two's complement, and
what is wrong with a row is a text beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .layout import ATTRIBUTE_LIST, COMPRESSED, EPOCH, FILE_NAME, LEAST_RECORD, MAX_RECORD, MAX_RUNLIST, SECTOR, SI, SPARSE, STRUCTS

_WIDTH = {"u8": 1, "i8": 1, "u16": 2, "u32": 4, "i32": 4, "u64": 8, "ft": 8, "ref": 6}
_FN = STRUCTS["FILE_NAME"]
_NODE = 24  # where the node header of an index page lies


class Rows:
    """The rows of a binary column in one writable buffer: row i is buf[start[i]:end[i]]."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        column = pa.concat_arrays([column])
        n = len(column)
        bound = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        body = np.frombuffer(data, np.uint8)[bound[0] : bound[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.buf = np.concatenate([body, np.zeros(16, np.uint8)])
        bound = bound - bound[0]
        self.start, self.end = bound[:-1].copy(), bound[1:].copy()

    def __len__(self) -> int:
        return len(self.start)


def integers(buf: np.ndarray, at: np.ndarray, width: int, end: np.ndarray) -> np.ndarray:
    """Little-endian integers as int64; 0 where they are not whole before ``end``."""
    ok = (at >= 0) & (at + width <= end)
    at = np.where(ok, at, 0)
    out = buf[at].astype(np.uint64)
    for i in range(1, width):
        out |= buf[at + i].astype(np.uint64) << np.uint64(8 * i)
    return np.where(ok, out, np.uint64(0)).view(np.int64)


def fields(struct: str, buf: np.ndarray, at: np.ndarray, end: np.ndarray, *names: str) -> dict[str, np.ndarray]:
    out = {}
    for name in names:
        offset, kind = STRUCTS[struct][name]
        value = integers(buf, at + offset, _WIDTH[kind], end)
        if kind[0] == "i":
            bits = 64 - 8 * _WIDTH[kind]
            value = value << bits >> bits
        out[name] = value
    return out


def gather(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after another."""
    total = np.cumsum(size)
    return buf[np.repeat(at - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


def binaries(buf: np.ndarray, at: np.ndarray, size: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Ranges as a binary array; null where not valid."""
    size = np.where(valid, size, 0)
    bound = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(at), [mask, pa.py_buffer(bound.tobytes()), pa.py_buffer(gather(buf, at, size).tobytes())])


def wide_texts(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[str]:
    """UTF-16 texts of byte ranges; what is no text becomes U+FFFD."""
    n = len(at)
    if not n:
        return []
    if not (size & 1).any():
        units = size // 2
        place = np.cumsum(units) - units
        flat = np.zeros(int(units.sum()) + n, np.uint16)
        flat[np.repeat(np.arange(n), units) + np.arange(int(units.sum()))] = gather(buf, at, size).view("<u2")
        flat[place + units + np.arange(n)] = 0
        parts = flat.tobytes().decode("utf-16-le", "replace").split("\0")
        if len(parts) == n + 1:
            return parts[:-1]
    raw = buf.tobytes()
    return [raw[a : a + s].decode("utf-16-le", "replace") for a, s in zip(at.tolist(), size.tolist(), strict=True)]


def _apply_fixups(rows: Rows, size: np.ndarray, table_at: np.ndarray, count: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Restores the last word of each sector from the update sequence array, in
    place; (rows whose table does not fit, rows with a wrong word)."""
    buf, start = rows.buf, rows.start
    table = start + table_at
    words = np.minimum(2 * count, size) // 2
    short = active & (count > 0) & (table + 2 * words > rows.end)
    active = active & ~short & (words > 0)
    mark = integers(buf, table, 2, rows.end)
    wrong = np.zeros(len(rows), dtype=bool)
    for i in range(1, int(words[active].max(initial=1))):
        mine = np.flatnonzero(active & ~wrong & (i < words))
        if not len(mine):
            break
        at = start[mine] + i * SECTOR - 2
        bad = (i * SECTOR > size[mine]) | (integers(buf, at, 2, rows.end[mine]) != mark[mine])
        wrong[mine[bad]] = True
        at, mine = at[~bad], mine[~bad]
        for k in (0, 1):
            buf[at + k] = buf[table[mine] + 2 * i + k]
    return short, wrong


def fix_records(rows: Rows) -> tuple[list[str | None], np.ndarray]:
    """Fixups of file records, in place: (what is wrong with each, whether a table was applied)."""
    f = fields("MFT_ENTRY", rows.buf, rows.start, rows.end, "Fixup_offset", "Fixup_count", "Mft_entry_allocated", "Record_number")
    size = np.minimum(f["Mft_entry_allocated"], MAX_RECORD)
    small = size < LEAST_RECORD
    cut = ~small & (rows.end - rows.start < size)
    short, wrong = _apply_fixups(rows, size, f["Fixup_offset"], f["Fixup_count"], ~small & ~cut)
    errors: list[str | None] = [None] * len(rows)
    for mask, text in ((small, "EntryTooShortError"), (cut, "ShortReadError"), (short, "Short read")):
        for i in np.flatnonzero(mask):
            errors[i] = text
    for i in np.flatnonzero(wrong):
        errors[i] = f"Fixup error with MFT {f['Record_number'][i]}"
    return errors, ~(small | cut | short | wrong) & (f["Fixup_count"] > 0)


def runs(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, cluster on disk, offset relative to the run before, clusters) of all
    run lists, in order; relative 0: without a place of its own."""
    at, lcn, out = at.copy(), np.zeros(len(at), np.int64), []
    live = np.arange(len(at))
    while len(live):
        head = np.where(at[live] < end[live], buf[np.minimum(at[live], len(buf) - 1)], 0).astype(np.int64)
        live, head = live[head != 0], head[head != 0]
        if not len(live):
            break
        wide, deep = np.minimum(head & 15, 8), np.minimum(head >> 4, 8)
        length, move = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
        for i in range(8):
            for value, base, size in ((length, at[live] + 1, wide), (move, at[live] + 1 + wide, deep)):
                spot = base + i
                byte = np.where((i < size) & (spot < end[live]), buf[np.minimum(spot, len(buf) - 1)], 0).astype(np.uint64)
                value |= byte << np.uint64(8 * i)
        up = (64 - 8 * deep).astype(np.int64)
        rel = np.where(deep > 0, move.view(np.int64) << np.minimum(up, 63) >> np.minimum(up, 63), 0)
        lcn[live] += rel
        out.append((live, lcn[live], rel, np.maximum(length.view(np.int64), 0)))
        at[live] += 1 + wide + deep
    if not out:
        return (np.zeros(0, np.int64),) * 4
    owner, place, rel, length = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(owner, kind="stable")
    return owner[order], place[order], rel[order], length[order]


def runlist(raw: bytes) -> list[tuple[int, int, int]]:
    """One run list: (cluster on disk, relative offset, clusters)."""
    buf = np.frombuffer(raw[:MAX_RUNLIST] + b"\0" * 16, np.uint8)
    _, lcn, rel, length = runs(buf, np.zeros(1, np.int64), np.array([min(len(raw), MAX_RUNLIST)]))
    return list(zip(lcn.tolist(), rel.tolist(), length.tolist(), strict=True))


def file_names(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray | list[str]]:
    """The fields of $FILE_NAME bodies."""
    f = fields("FILE_NAME", buf, at, end, *_FN)
    size = np.clip(end - at - 66, 0, 2 * f["_length_of_name"])
    return {
        "parent": f["MftReference"], "parent_seq": f["Seq_num"], "created": f["Created"], "modified": f["File_modified"], "mft_modified": f["Mft_modified"],
        "accessed": f["File_accessed"], "allocated": f["Allocated_size"], "size": f["FilenameSize"], "flags": f["Flags"], "type": f["NameType"], "name": wide_texts(buf, at + 66, size),
    }


NAME_FIELDS = [
    ("parent", pa.int64()), ("parent_seq", pa.int32()), ("created", pa.int64()), ("modified", pa.int64()), ("mft_modified", pa.int64()), ("accessed", pa.int64()),
    ("allocated", pa.int64()), ("size", pa.int64()), ("flags", pa.int64()), ("type", pa.int32()), ("name", pa.string()),
]
INFO_FIELDS = [(n, pa.int64()) for n in ("created", "modified", "mft_modified", "accessed", "flags", "max_versions", "version", "class_id", "owner_id", "sid", "quota", "usn")]
RUN_FIELDS = [(n, pa.int64()) for n in ("lcn", "rel", "len")]
ATTRIBUTE_FIELDS = [
    ("ord", pa.int32()), ("type", pa.int64()), ("attr", pa.int32()), ("name", pa.string()), ("resident", pa.bool_()), ("flags", pa.int32()), ("size", pa.int64()),
    ("allocated", pa.int64()), ("initialized", pa.int64()), ("vcn_start", pa.int64()), ("vcn_end", pa.int64()), ("unit", pa.int32()), ("content", pa.binary()),
    ("runs", pa.list_(pa.struct(RUN_FIELDS))), ("info", pa.struct(INFO_FIELDS)), ("fn", pa.struct(NAME_FIELDS)),
]
RECORD_FIELDS = [
    ("number", pa.int64()), ("seq", pa.int32()), ("links", pa.int32()), ("flags", pa.int32()), ("lsn", pa.int64()), ("base", pa.int64()), ("base_seq", pa.int32()),
    ("next_id", pa.int32()), ("fixup_offset", pa.int32()), ("fixup_count", pa.int32()), ("attr_offset", pa.int32()), ("used", pa.int32()), ("allocated", pa.int32()),
    ("error", pa.string()), ("magic_ok", pa.bool_()), ("is_fixed", pa.bool_()), ("attributes", pa.list_(pa.struct(ATTRIBUTE_FIELDS))),
]


def _structs(kinds: list, values: dict, valid: np.ndarray | None = None) -> pa.StructArray:
    arrays = [values[n] if isinstance(values[n], pa.Array) else pa.array(values[n], t) for n, t in kinds]
    mask = None if valid is None else pa.array(~valid)
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in kinds], mask=mask)


def _spread(kinds: list, values: dict, where: np.ndarray, n: int) -> pa.StructArray:
    """Structs of some of n rows; null for the others."""
    to = np.full(n, -1)
    to[where] = np.arange(len(where))
    made = _structs(kinds, values)
    return made.take(pa.array(to, mask=to < 0))


def _walk(rows: Rows, first: np.ndarray, used: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, order, place) of all attributes.  A record ends at a length that
    cannot hold a header, at the end mark, or at the size that it states."""
    found, at, step = [], rows.start + first, 0
    while len(live):
        here, end = at[live], rows.end[live]
        kind, length = integers(rows.buf, here, 4, end), integers(rows.buf, here + 4, 4, end)
        ok = (length >= 16) & (here - rows.start[live] + length <= used[live]) & (kind != 0xFFFFFFFF) & (here + 16 <= end)
        live, length = live[ok], length[ok]
        found.append((live, np.full(len(live), step), at[live]))
        at[live] += length
        step += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    record, order, place = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(record, kind="stable")
    return record[by], order[by], place[by]


def records(column: pa.Array, bodies: bool = True, lists: bool = False) -> dict[str, pa.Array]:
    """The RECORD_FIELDS of each row.  Without ``bodies``, contents and runs of attributes
    stay null; with ``lists``, attribute lists have their contents all the same."""
    rows = Rows(column)
    buf, n = rows.buf, len(rows)
    errors, fixed = fix_records(rows)
    head = fields("MFT_ENTRY", buf, rows.start, rows.end, *(k for k in STRUCTS["MFT_ENTRY"] if k != "Magic"))
    magic = integers(buf, rows.start, 4, rows.end) == int.from_bytes(b"FILE", "little")
    fine = np.array([e is None for e in errors], dtype=bool)
    record, order, at = _walk(rows, head["Attribute_offset"], head["Mft_entry_size"], np.flatnonzero(fine))
    end = rows.end[record]
    a = fields("NTFS_ATTRIBUTE", buf, at, end, *STRUCTS["NTFS_ATTRIBUTE"])
    resident = a["Resident"] == 0
    name_at = at + a["name_offset"]
    name_size = np.clip(end - name_at, 0, 2 * a["name_length"])
    body = at + a["Content_offset"]
    body_size = np.clip(end - body, 0, np.minimum(a["Content_size"], MAX_RECORD))
    kind = a["Type"]
    si, fn = np.flatnonzero(resident & (kind == SI)), np.flatnonzero(resident & (kind == FILE_NAME))
    info = fields("STANDARD_INFORMATION", buf, body[si], body[si] + body_size[si], *STRUCTS["STANDARD_INFORMATION"])
    info = dict(zip((k for k, _ in INFO_FIELDS), info.values(), strict=True))
    names = file_names(buf, body[fn], body[fn] + body_size[fn])
    m = len(at)
    if bodies:
        content = binaries(buf, body, body_size, resident)
        mapped = np.flatnonzero(~resident)
        start = at[mapped] + a["Runlist_offset"][mapped]
        limit = np.minimum(end[mapped], start + np.minimum(a["Length"][mapped], MAX_RUNLIST))
        owner, *run = runs(buf, np.minimum(start, end[mapped]), limit)
        counts = np.zeros(m, np.int64)
        counts[mapped] = np.bincount(owner, minlength=len(mapped))
        run_structs = _structs(RUN_FIELDS, dict(zip(("lcn", "rel", "len"), run, strict=True)))
        run_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), run_structs)
    else:
        content = binaries(buf, body, body_size, resident & (kind == ATTRIBUTE_LIST)) if lists else pa.nulls(m, pa.binary())
        run_lists = pa.nulls(m, pa.list_(pa.struct(RUN_FIELDS)))
    size = np.where(resident, a["Content_size"], a["Actual_size"])
    attributes = _structs(
        ATTRIBUTE_FIELDS,
        {
            "ord": order, "type": kind, "attr": a["Attribute_id"], "name": wide_texts(buf, np.minimum(name_at, end), name_size), "resident": resident, "flags": a["Flags"],
            "size": size, "allocated": np.where(resident, size, a["Allocated_size"]), "initialized": np.where(resident, size, a["Initialized_size"]),
            "vcn_start": np.where(resident, 0, a["Runlist_vcn_start"]), "vcn_end": np.where(resident, 0, a["Runlist_vcn_end"]), "unit": np.where(resident, 0, a["Compression_unit_size"]),
            "content": content, "runs": run_lists, "info": _spread(INFO_FIELDS, info, si, m), "fn": _spread(NAME_FIELDS, names, fn, m),
        },
    )
    bound = np.concatenate([[0], np.cumsum(np.bincount(record, minlength=n))])
    base = head["Base_record_reference"]
    values = {
        "number": head["Record_number"], "seq": head["Sequence_value"], "links": head["Link_count"], "flags": head["Flags"], "lsn": head["Logfile_sequence_number"],
        "base": base & 0xFFFFFFFFFFFF, "base_seq": (base.view(np.uint64) >> np.uint64(48)).astype(np.int64), "next_id": head["Next_attribute_id"],
        "fixup_offset": head["Fixup_offset"], "fixup_count": head["Fixup_count"], "attr_offset": head["Attribute_offset"], "used": head["Mft_entry_size"],
        "allocated": head["Mft_entry_allocated"], "error": errors, "magic_ok": magic, "is_fixed": fixed,
        "attributes": pa.ListArray.from_arrays(pa.array(bound, pa.int32()), attributes),
    }
    return {k: v if isinstance(v, pa.Array) else pa.array(v, t) for (k, t), v in ((f, values[f[0]]) for f in RECORD_FIELDS)}


def record(raw: bytes) -> dict:
    """One record as plain values."""
    return {k: v[0].as_py() for k, v in records(pa.array([raw], pa.binary())).items()}


def list_entries(column: pa.Array) -> dict[str, np.ndarray]:
    """Entries of attribute lists: row, pos, type, attr, ref, vcn."""
    rows = Rows(column)
    at, live, found, pos = rows.start.copy(), np.flatnonzero(rows.end > rows.start), [], 0
    while len(live):
        f = fields("ATTRIBUTE_LIST_ENTRY", rows.buf, at[live], rows.end[live], "Type", "Length", "Starting_vcn", "MftReference", "Attribute_id")
        found.append((live, np.full(len(live), pos), f["Type"], f["Attribute_id"], f["MftReference"], f["Starting_vcn"]))
        step = f["Length"]
        at[live] += step
        live = live[(step > 0) & (at[live] < rows.end[live])]
        pos += 1
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 6
    return dict(zip(("row", "pos", "type", "attr", "ref", "vcn"), cols, strict=True))


# ---- directory indexes -----------------------------------------------------

INDEX_FIELDS = [
    ("ord", pa.int32()), ("offset", pa.int32()), ("is_slack", pa.bool_()), ("valid", pa.bool_()), ("entry", pa.int64()), ("seq", pa.int32()), *NAME_FIELDS,
]
_LEAST_TIME, _MOST_TIME = EPOCH + 10**9 * 10**7, EPOCH + 2 * 10**9 * 10**7 + 10**7 - 1


def _index_rows(rows: Rows, row: np.ndarray, at: np.ndarray, base: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, dict]:
    """Index entries at the given places, in order of row, place and kind."""
    by = np.lexsort((at, slack, row))
    row, at, slack = row[by], at[by], slack[by]
    end = rows.end[row]
    f = fields("INDEX_RECORD_ENTRY", rows.buf, at, end, "MftReference", "Seq_num")
    names = file_names(rows.buf, at + 16, end)
    valid = np.ones(len(at), dtype=bool)
    for k in ("created", "modified", "mft_modified", "accessed"):
        valid &= (names[k] >= _LEAST_TIME) & (names[k] <= _MOST_TIME)
    ord_ = np.arange(len(row)) - np.searchsorted(row, row)
    return row, {"ord": ord_, "offset": at - base[row], "is_slack": slack.astype(bool), "valid": valid, "entry": f["MftReference"], "seq": f["Seq_num"], **names}


def _node_entries(rows: Rows, node: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the live entries of nodes."""
    f = fields("INDEX_NODE_HEADER", rows.buf, node, rows.end, "Offset_to_index_entry", "Offset_to_end_index_entry")
    at, stop = node + f["Offset_to_index_entry"], node + f["Offset_to_end_index_entry"]
    found = []
    while len(live):
        live = live[(at[live] + 66 < stop[live]) & (at[live] + 16 <= rows.end[live])]
        found.append((live, at[live]))
        step = fields("INDEX_RECORD_ENTRY", rows.buf, at[live], rows.end[live], "SizeOfIndexEntry")["SizeOfIndexEntry"]
        at[live] += step
        live = live[step > 0]
    row, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return row, place


def index_roots(column: pa.Array) -> tuple[np.ndarray, dict]:
    """(row, INDEX_FIELDS) of the entries of index roots."""
    rows = Rows(column)
    row, at = _node_entries(rows, rows.start + 16, np.flatnonzero(rows.end - rows.start > 28))
    return _index_rows(rows, row, at, rows.start, np.zeros(len(row), np.int64))


def index_pages(column: pa.Array) -> tuple[np.ndarray, dict]:
    """(row, INDEX_FIELDS) of the live entries of index pages, and of valid ones
    at any eighth byte of their slack, where entries begin: between those, shifted
    bytes of four equal times may be times too.  Pages with a wrong fixup have no entries."""
    rows = Rows(column)
    n = len(rows)
    head = fields("STANDARD_INDEX_HEADER", rows.buf, rows.start, rows.end, "Fixup_offset", "Fixup_count")
    size = rows.end - rows.start
    whole = size >= _NODE + 12
    short, wrong = _apply_fixups(rows, size, head["Fixup_offset"], head["Fixup_count"], whole)
    wrong |= 2 * head["Fixup_count"] > size
    fine = whole & ~short & ~wrong
    node = rows.start + _NODE
    row, at = _node_entries(rows, node, np.flatnonzero(fine))
    f = fields("INDEX_NODE_HEADER", rows.buf, node, rows.end, "Offset_to_end_index_entry", "SizeOfEntriesAlloc")
    lo = np.minimum(node + f["Offset_to_end_index_entry"], rows.end)
    hi = np.minimum(node + f["SizeOfEntriesAlloc"] - 0x52, rows.end - 0x52)
    rows_found, places = [row], [at]
    for i in np.flatnonzero(fine & (lo < hi)):
        first = lo[i] + (rows.start[i] - lo[i]) % 8
        count = max(0, int(hi[i] - first))
        spots = np.lib.stride_tricks.sliding_window_view(rows.buf[first : rows.end[i] + 8], 8)
        ok = np.ones(-(-count // 8), dtype=bool)
        for t in (24, 32, 40, 48):
            ft = np.ascontiguousarray(spots[t : t + count : 8]).view("<i8")[:, 0]
            ok &= (ft >= _LEAST_TIME) & (ft <= _MOST_TIME)
        hit = np.flatnonzero(ok)
        rows_found.append(np.full(len(hit), i))
        places.append(first + 8 * hit)
    slack = np.concatenate([np.zeros(len(row), np.int64), np.ones(sum(map(len, places[1:])), np.int64)])
    if not n:
        return np.zeros(0, np.int64), _index_rows(rows, row, at, rows.start, slack)[1]
    return _index_rows(rows, np.concatenate(rows_found), np.concatenate(places), rows.start, slack)


# ---- journal ---------------------------------------------------------------

USN_FIELDS = [
    ("offset", pa.int64()), ("length", pa.int64()), ("major", pa.int32()), ("minor", pa.int32()), ("file", pa.int64()), ("file_seq", pa.int32()), ("parent", pa.int64()),
    ("parent_seq", pa.int32()), ("usn", pa.int64()), ("time", pa.int64()), ("reason", pa.int64()), ("source", pa.int64()), ("security", pa.int64()), ("attributes", pa.int64()), ("name", pa.string()),
]
_USN = STRUCTS["USN_RECORD_V2"]
_STEP = 8


def _usn_rows(rows: Rows, row: np.ndarray, at: np.ndarray, base: np.ndarray) -> dict:
    end = rows.end[row]
    f = fields("USN_RECORD_V2", rows.buf, at, end, *_USN)
    stop = np.minimum(end, at + f["RecordLength"])
    name_at = at + f["FileNameOffset"]
    name = wide_texts(rows.buf, np.minimum(name_at, end), np.clip(stop - name_at, 0, f["FileNameLength"]))
    values = list(f.values())[:13]
    return dict(zip((k for k, _ in USN_FIELDS), (base[row] + at - rows.start[row], *values, name), strict=True))


def usn_offsets(rows: Rows, i: int) -> np.ndarray:
    """Places of the records of one stretch, each next to the one before or, after
    a gap, the next valid one.  A record that is not whole is none."""
    a, b = int(rows.start[i]), int(rows.end[i])
    places = np.arange(a, max(a, b - 59), _STEP)
    if not len(places):
        return places
    end = np.full(len(places), b)
    f = fields("USN_RECORD_V2", rows.buf, places, end, "RecordLength", "MajorVersion", "Usn", "FileNameLength", "FileNameOffset")
    length = f["RecordLength"]
    ok = (length >= 60) & (places + length <= b) & (f["MajorVersion"] == 2) & (f["Usn"] > 0) & (f["FileNameOffset"] + f["FileNameLength"] <= length)
    n = len(places)
    following = np.where(ok, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1].tolist()
    steps = (-(-length // _STEP)).tolist()
    out, k = [], 0
    while k < n and (k := following[k]) < n:
        out.append(k)
        k += steps[k]
    return places[out]


def usn_records(base: np.ndarray, column: pa.Array) -> dict:
    """USN_FIELDS of all records of stretches (row i begins at base[i])."""
    rows = Rows(column)
    found = [usn_offsets(rows, i) for i in range(len(rows))]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    return _usn_rows(rows, row, np.concatenate([np.zeros(0, np.int64), *found]), base)


# Earliest and latest time of a carved record, seconds of 2020 and 2040.
CARVE_FROM, CARVE_TO = 1577836800, 2208988800


def carve_usn(base: np.ndarray, column: pa.Array, least: int = CARVE_FROM, most: int = CARVE_TO) -> dict:
    """USN_FIELDS of whole records at any 16th byte of raw bytes, by their version, sizes and time."""
    rows = Rows(column)
    count = np.maximum(-(-(rows.end - rows.start - 16) // 16), 0)
    row = np.repeat(np.arange(len(rows)), count)
    at = rows.start[row] + 16 * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    hit = integers(rows.buf, at + 4, 4, rows.end[row]) == 2  # the cheap test first
    row, at = row[hit], at[hit]
    f = fields("USN_RECORD_V2", rows.buf, at, rows.end[row], "RecordLength", "FileNameLength", "FileNameOffset", "TimeStamp")
    size = f["RecordLength"]
    ok = (size >= 64) & (size <= 1024) & (f["FileNameLength"] <= 255) & (f["FileNameOffset"] <= 255) & (at + size <= rows.end[row])
    ok &= (f["TimeStamp"] >= EPOCH + least * 10**7) & (f["TimeStamp"] <= EPOCH + most * 10**7)
    return _usn_rows(rows, row[ok], at[ok], base)


# ---- mappings --------------------------------------------------------------

def mapping(run: list[tuple[int, int, int]], flags: int, unit: int, cluster: int, size: int, initialized: int) -> list[tuple]:
    """The extents of a stream from the runs of all its pieces.

    Rows (cluster of the file, clusters, place on disk, sparse, clusters of the
    compressed unit or 0, those it is stored in, first of them that this row
    holds, offset in bytes, length in bytes): the last two end at the initialised
    size, after which one sparse row reaches to the size.  A compressed unit that
    lies in several places has one row for each.
    """
    if unit >= 63:
        return []
    out, at = [], 0
    compressed, sparse_too = bool(flags & COMPRESSED), bool(flags & SPARSE)

    def add(first: int, clusters: int, place: int, sparse: bool, wide: int = 0, stored: int = 0, part: int = 0) -> None:
        begin = first * cluster
        length = max(0, min((wide or clusters) * cluster, initialized - begin))
        out.append((first, clusters, place, sparse, wide, stored, part, begin, length))

    left = [[lcn, rel == 0, n] for lcn, rel, n in run if n > 0]
    if not compressed:
        for lcn, bare, n in left:
            add(at, n, lcn, bare and sparse_too)
            at += n
    else:
        wide, i = 1 << unit, 0
        while i < len(left):
            lcn, bare, n = left[i]
            if n >= wide:  # whole units in one run are as they are
                take = n - n % wide
                add(at, take, lcn, bare)
                at += take
                left[i] = [lcn + (0 if bare else take), bare, n - take]
                i += n == take
                continue
            parts, total = [], 0
            while i < len(left) and total < wide:
                lcn, bare, n = left[i]
                take = min(n, wide - total)
                parts.append((lcn, bare, take))
                total += take
                left[i] = [lcn + (0 if bare else take), bare, n - take]
                i += n == take
            real = [p for p in parts if not p[1]]
            if real and len(real) < len(parts) and total == wide:
                stored, part = sum(p[2] for p in real), 0
                for lcn, _, n in real:
                    add(at, n, lcn, False, wide, stored, part)
                    part += n
                at += wide
            else:
                for lcn, bare, n in parts:
                    add(at, n, lcn, bare)
                    at += n
    covered = min(at * cluster, initialized)
    for begin, end in ((covered, initialized), (max(initialized, 0), size)):
        if end > begin:
            out.append((-1, 0, 0, True, 0, 0, 0, begin, end - begin))
    return out


