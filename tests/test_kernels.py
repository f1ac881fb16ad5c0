"""Hand-made bytes: decoders must not raise, and say what is wrong."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from codec_vectors import VECTORS
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorlake.functions import codecs, kernels
from sectorlake.plans import encode

T0 = (132_000_000_000_000_000,) * 4


@pytest.mark.parametrize("name, huffman, data, text, size", VECTORS, ids=[v[0].split(":")[0] for v in VECTORS])
def test_vectors(name, huffman, data, text, size):
    want = (text * (size // len(text) + 1))[:size]
    raw = bytes.fromhex(data)
    assert (codecs.xpress_huffman(raw, size) if huffman else codecs.xpress(raw)) == (want, None)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trips(data):
    assert codecs.lznt1(codecs.lznt1_encode(data)) == (data, None)
    assert codecs.xpress(codecs.xpress_encode(data)) == (data, None)
    assert codecs.xpress_huffman(codecs.xpress_huffman_encode(data), len(data)) == (data, None)


def everything(rows):
    column = pa.array(rows, pa.binary())
    kernels.records(column)
    kernels.records(column, bodies=False)
    kernels.list_entries(column)
    kernels.index_pages(column)
    kernels.index_roots(column)
    kernels.usn_records(np.arange(len(rows)), column)
    kernels.carve_usn(np.arange(len(rows)), column)
    for r in rows:
        kernels.mapping(kernels.runlist(r or b""), 1, 4, 512, 5000, 4000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=1500)), max_size=4))
def test_nothing_raises(rows):
    everything(rows)
    everything([b"FILE" + r if r else r for r in rows])
    for r in rows:
        codecs.lznt1(r or b"")
        codecs.xpress(r or b"")
        codecs.xpress_huffman(r or b"", 100)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1023), st.binary(min_size=1, max_size=8)), max_size=12))
def test_damaged_records(changes):
    """A good record with bytes changed anywhere."""
    data = encode.mapped(3, "", [(50, 3), (None, 4), (9, 1)], (0, 7), 30_000, 29_000, flags=1, unit=2)
    raw = bytearray(encode.record(7, 1, T0, [encode.name_body(5, 5, T0, 0, "näme")], [data, encode.index_root([(9, 1, encode.name_body(7, 1, T0, 0, "x"))])], lists=[encode.attribute_list([(128, 3, 9, 0)])]))
    for at, new in changes:
        raw[at : at + len(new)] = new[: 1024 - at]
    everything([bytes(raw)])


def test_large_integers():
    """Times, sizes and numbers with the top bit set are two's complement."""
    body = encode.name_body(5, 5, ((1 << 64) - 1,) * 4, (1 << 64) - 2, "a")
    raw = encode.record(7, 1, ((1 << 64) - 1, 1 << 63, 0, 1), [body], [encode.mapped(3, "", [(50, 3)], (0, 2), (1 << 64) - 5)])
    got = kernels.record(raw)
    assert got["error"] is None and got["attributes"][0]["info"]["created"] == -1 and got["attributes"][0]["info"]["modified"] == -(1 << 63)
    assert got["attributes"][1]["fn"]["size"] == -2 and got["attributes"][2]["size"] == -5


def crafted(attribute, tail=b""):
    out = bytearray(1024)
    struct.pack_into("<4sHH", out, 0, b"FILE", 0x30, 0)
    struct.pack_into("<HxxHxxH", out, 20, 0x38, 1024, 1024)
    out[0x38 : 0x38 + len(attribute)] = attribute
    out[1024 - len(tail) :] = tail
    return bytes(out)


def test_crafted_lists():
    """An attribute list with an impossible compression unit, and one whose run list is cut off by the record's end."""
    head = struct.pack("<IIBBHHHQQHHIQQQ", 32, 80, 1, 0, 0, 1, 0, 0, 0, 64, 64, 0, 0, 100, 100)
    got = kernels.record(crafted(head + b"\x11\x01\x01\x11\x01\x01\0"))["attributes"][0]
    assert [r["lcn"] for r in got["runs"]] == [1, 2] and kernels.mapping([(1, 1, 1), (2, 1, 1)], 1, got["unit"], 4096, 100, 100) == []
    head = struct.pack("<IIBBHHHQQHHIQQQ", 32, 100, 1, 0, 0, 0, 0, 0, 0, 1022 - 0x38, 4, 0, 0, 0, 0)
    assert [r["len"] for r in kernels.record(crafted(head, b"\x11\x05"))["attributes"][0]["runs"]] == [5]


def test_page_with_a_wrapping_fixup_count():
    page = bytearray(encode.index_page([(9, 1, encode.name_body(5, 5, T0, 0, "x"))], []))
    assert len(kernels.index_pages(pa.array([bytes(page)]))[0]) == 1
    page[6:8] = b"\0\x80"
    assert len(kernels.index_pages(pa.array([bytes(page)]))[0]) == 0


def test_lznt1_errors():
    assert codecs.lznt1(bytes.fromhex("02800041"))[1] == "truncated chunk"
    assert codecs.lznt1(bytes.fromhex("018000"))[1] and codecs.lznt1(bytes.fromhex("018001"))[1]
    assert codecs.lznt1(struct.pack("<H", 0xB002) + b"\x01\xff\xff")[1] == "bad back reference"
    assert codecs.lznt1(bytes([3, 0x80, 2, 0x41, 0xFF, 0x0F]) * 10_000)[1] == "too large"


def test_xpress_too_large():
    raw = struct.pack("<I", 1 << 30) + b"a" + struct.pack("<H", 7) + b"\x0f\xff" + struct.pack("<H", 0) + struct.pack("<I", 2_000_000)
    assert codecs.xpress(raw)[1] == "too large"


def test_xpress_huffman_long_runs_and_errors():
    for n in (18, 272, 273, 274, 70_000):
        assert codecs.xpress_huffman(codecs.xpress_huffman_encode(b"a" * n), n) == (b"a" * n, None)
    raw = codecs.xpress_huffman_encode(b"abcabcabcabc")
    assert codecs.xpress_huffman(raw, 5)[1] == "corrupt stream"
    assert codecs.xpress_huffman(raw[:257], 12)[1] == "end of stream"
    assert codecs.xpress_huffman(b"\0" * 300, 12)[1] == "bad code"


def test_runlist_sparse_and_backwards():
    assert [r[::2] for r in kernels.runlist(encode.runs_of([(500, 3), (None, 7), (20, 300)]))] == [(500, 3), (500, 7), (20, 300)]


def plain_mapping(run, unit, size):
    """Cluster by cluster: (place or None, stored clusters of its unit or 0)."""
    flat = [(lcn + i if rel else None) for lcn, rel, n in run for i in range(n)]
    out = []
    for a in range(0, len(flat), unit):
        part = flat[a : a + unit]
        real = [x for x in part if x is not None]
        out.append((tuple(part), len(real) if len(part) == unit and 0 < len(real) < unit else 0))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 40)), min_size=1, max_size=10))
def test_compressed_mapping(shape):
    """Units from runs of any lengths, against a cluster by cluster version."""
    run, at = [], 100
    for sparse, n in shape:
        run.append((at, 0, n) if sparse else (at, 1, n))
        at += n + 3
    clusters = sum(n for _, _, n in run)
    rows = kernels.mapping(run, 1, 4, 512, clusters * 512, clusters * 512)
    assert all(r[-1] >= 0 for r in rows) and sum(r[-1] for r in rows if r[6] == 0) == clusters * 512
    units = plain_mapping(run, 16, clusters)
    for i, (part, stored) in enumerate(units):
        mine = [r for r in rows if r[4] and r[0] == i * 16]
        if stored:
            assert [r[2] + k for r in mine for k in range(r[1])] == [x for x in part if x is not None] and {r[5] for r in mine} == {stored}
        else:
            flat = {r[0] + k: None if r[3] else r[2] + k for r in rows if not r[4] for k in range(r[1])}
            assert not mine and tuple(flat[i * 16 + k] for k in range(len(part))) == part


def test_fixup_mismatch():
    raw = encode.record(7, 1, (0,) * 4, [encode.name_body(5, 5, (0,) * 4, 0, "a")], broken=True)
    assert kernels.record(raw)["error"] == "Fixup error with MFT 7"
    assert kernels.record(b"FILE")["error"] == "EntryTooShortError"
    assert kernels.record(raw[:600])["error"] == "ShortReadError"


def test_journal_resumes_after_a_gap():
    a, b = (encode.usn(i, 1, 5, 5, 8 * i, T0[0], 256, f"f{i}") for i in (1, 2))
    got = kernels.usn_records(np.array([100]), pa.array([a + b"\0" * 40 + b]))
    assert got["file"].tolist() == [1, 2] and got["offset"].tolist() == [100, 100 + len(a) + 40] and got["name"] == ["f1", "f2"]


def test_wide_texts():
    raw = ["plain", "", "ünï", "𝄞x", "nul\0in"]
    body = [t.encode("utf-16-le") for t in raw] + [b"\x00\xd8", b"a\0\x00\xdc"]
    buf = np.frombuffer(b"".join(body) + b"\0" * 16, np.uint8)
    size = np.array([len(b) for b in body])
    want = [*raw, "\ufffd", "a\ufffd"]
    assert kernels.wide_texts(buf, np.cumsum(size) - size, size) == want
    keep = [0, 1, 2, 3, 5, 6]  # without a zero inside, all are decoded at once
    assert kernels.wide_texts(buf, (np.cumsum(size) - size)[keep], size[keep]) == [want[i] for i in keep]
