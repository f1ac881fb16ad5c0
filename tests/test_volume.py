"""Records, streams, paths, sources: values known from recorded volumes, on inputs made here."""

import pytest
from pyspark.sql import functions as F

from sectorlake.functions import kernels
from sectorlake.operators import extents, index, journal, paths, records, sinks
from sectorlake.plans import encode
from sectorlake.sources import mft, pages, snapshots
from sectorlake.sources.storage import Space

T = 133_000_000_000_000_000
T0 = (T,) * 4


def decoded(spark, rows):
    return records.decode(spark.createDataFrame(rows, "entry long, raw binary"))


def name(text, parent=5, seq=5, kind=0):
    return encode.name_body(parent, seq, T0, 0, text, kind)


def record_38():
    """A file whose streams 111 and 333 have one number and lie in other records, and the $Secure file."""
    data = lambda number, n, size, lcn: encode.mapped(number, n, [(lcn, 2)], (0, 1), size)
    own = encode.record(38, 2, T0, [name("Nine.txt")], [encode._attribute(64, 4, "", bytes(16)), data(3, "", 5000, 904), encode.resident(7, "222", b"2" * 56)], lists=[
        encode.attribute_list([(16, 0, 38, 0), (128, 0, 39, 0), (128, 0, 40, 0), (48, 2, 38, 0), (64, 4, 38, 0), (128, 3, 38, 0), (128, 7, 38, 0)], 10)], ids=2)
    return [
        (38, own), (39, encode.record(39, 1, None, [], [data(0, "111", 5005, 914)])), (40, encode.record(40, 1, None, [], [data(0, "333", 6005, 924)])),
        (9, encode.record(9, 9, T0, [name("$Secure")], [encode.mapped(8, "$SDS", [(7, 65)], (0, 64), 263_264), encode.index_root([], 9)])),
        (5, encode.record(5, 5, T0, [name(".")], [encode.index_root([], 8)], directory=True)),
    ]


def disk_38(spark):
    body = {904: b"9" * 5000, 914: b"1" * 5005, 924: b"3" * 6005}
    return spark.createDataFrame([(lcn + k, b[k * 4096 : (k + 1) * 4096].ljust(4096, b"\0")) for lcn, b in body.items() for k in (0, 1)], "lcn long, data binary")


def test_streams_of_one_number(spark):
    rows = records.expand(decoded(spark, record_38())).cache()
    got = {r.mft_id: r for r in records.model(rows, paths.of_records(rows)).collect()}
    shown = [(a.inode, a.name, a.size, a.resident) for a in got[38].attributes]
    assert shown == [
        ("38-16-0", "", 72, True), ("38-128-0", "111", 5005, False), ("38-128-0:333", "333", 6005, False), ("38-32-10", "", 224, True), ("38-48-2", "", 82, True),
        ("38-64-4", "", 16, True), ("38-128-3", "", 5000, False), ("38-128-7", "222", 56, True),
    ]
    assert (got[38].size, got[38].full_path, got[38].hardlinks, got[38].filenames[0].type) == (5005, "/Nine.txt", ["Nine.txt"], "POSIX")
    assert got[5].full_path == "/."
    listed = {r.mft_id: (r.name, r.size, r.is_dir) for r in records.stat(rows).collect()}
    assert listed["9-144-9"] == ("$Secure", 0, False) and listed["9-128-8"] == ("$Secure:$SDS", 263_264, False) and listed["5-144-8"] == (".", 0, True)
    assert listed["38-128-0"][0] == "Nine.txt:111" and listed["38-128-0:333"][0] == "Nine.txt:333" and listed["38-128-3"][0] == "Nine.txt"

    from sectorlake.functions.columns import parse_inode

    asked = ["38-128-0", "38", "38:111", "38-128-0:333", "38-128-3", "38-128", "38-128-3:111", "9"]
    q = spark.createDataFrame(list(enumerate(asked)), "id long, inode string").select("id", *[c.alias(k) for k, c in parse_inode(F.col("inode")).items()])
    chosen = records.select_stream(q, rows)
    want = {0: ("111", 5005), 1: ("", 5000), 2: ("111", 5005), 3: ("333", 6005), 4: ("", 5000), 5: ("", 5000), 6: (None, None), 7: ("$SDS", 263_264)}
    assert {r.id: (r.name, r.size) for r in chosen.collect()} == want
    bytes_ = extents.contents(extents.chunks(chosen.where("id in (1, 2, 3)").drop("id"), disk_38(spark)))
    assert {r.name: bytes(r.data) for r in bytes_.collect()} == {"": b"9" * 5000, "111": b"1" * 5005, "333": b"3" * 6005}


def test_attribute_list_that_breaks_off(spark):
    """From the first entry that cannot be found on, a list is left out."""
    lists = [encode.attribute_list([(48, 1, 50, 0), (48, 1, 51, 0), (48, 1, 52, 0)])]
    rows = [(7, encode.record(7, 1, T0, [], lists=lists)), (50, encode.record(50, 1, None, [name("a")])), (52, encode.record(52, 1, None, [name("c")]))]
    got = records.with_parts(records.expand(decoded(spark, rows))).where("entry = 7").first()
    assert [n.name for n in got.names] == ["a"] and [a.ord for a in got.attributes] == list(range(len(got.attributes)))


def test_paths_that_stop(spark):
    """Missing and unreadable parents, wrong sequences, no names, cycles, depth, parent 0."""
    d = lambda e, text, parent, seq=1: (e, encode.record(e, 1, T0, [name(text, parent, seq)], directory=True))
    rows = [d(100 + i, f"d{i}", 99 + i) for i in range(1, 30)] + [d(100, "d0", 5, 5)]
    rows += [d(200, "a", 201), d(201, "b", 200), d(300, "lost", 11), (301, encode.record(301, 1, T0, [], directory=True)), d(302, "x", 301), d(303, "y", 302), d(304, "zero", 0), d(305, "late", 304, 9)]
    rows += [(306, encode.record(306, 1, T0, [name("q")], broken=True)), d(307, "p", 306)]
    got = {r.entry: paths_text(r.components) for r in paths.of_records(decoded(spark, rows)).collect()}
    assert got[120] == "d0/" + "/".join(f"d{i}" for i in range(1, 21))
    assert got[121] == "<Err>/<DirTooDeep>/" + "/".join(f"d{i}" for i in range(1, 22))
    assert got[129] == "<Err>/<DirTooDeep>/" + "/".join(f"d{i}" for i in range(9, 30))
    assert got[200] == "<Err>/<DirTooDeep>/" + "/".join(["a", "b"] * 10 + ["a"])
    assert got[300] == "<Err>/EntryTooShortError/lost" and got[303] == "<Err>/<UnknownEntry>/x/y" and got[304] == "zero"
    assert got[305] == "<Err>/<Parent 304-1 need 9>/late" and got[307] == "<Err>/Fixup error with MFT 306/p"
    shallow = paths.of_records(decoded(spark, rows), paths.PathOptions(max_depth=2, prefix=("C:",)))
    assert {r.entry: paths_text(r.components) for r in shallow.collect()}[103] == "C:/<Err>/<DirTooDeep>/d1/d2/d3"


def paths_text(components):
    return "/".join(components)


def test_joined_paths(spark):
    rows = spark.createDataFrame([(["a", "", ".", "b", "..", "c"],), (["."],), (["..", "x"],)], "c array<string>")
    assert [r[0] for r in rows.select(paths.joined(F.col("c"))).collect()] == ["/a/c", "/.", "/x"]
    assert rows.select(paths.with_stream(F.col("c"), F.lit("s"))).first()[0][-1] == "c:s"


def test_large_file_small_start(spark):
    """One cluster is initialised, the rest of the megabyte is not."""
    rows = decoded(spark, [(46, encode.record(46, 1, T0, [name("f")], [encode.mapped(1, "", [(69787, 256)], (0, 255), 1 << 20, 4096)]))])
    found = extents.extents(records.attributes(rows))
    assert [(r.offset, r.length, r.is_sparse) for r in extents.ranges(found).orderBy("offset").collect()] == [(0, 4096, False), (4096, (1 << 20) - 4096, True)]
    assert extents.range_size(found).first().end == 1 << 20
    assert [r.text for r in extents.run_text(extents.run_info(found)).orderBy("ord", "sub").collect()] == [
        " 0 MappedReader: FileOffset 0 -> DiskOffset 0 (Length 4096,  Cluster 1) Delegate RangeReader",
        "  1 MappedReader: FileOffset 0 -> DiskOffset 69787 (Length 256,  Cluster 4096) Delegate PagedReader",
        " 0 MappedReader: FileOffset 4096 -> DiskOffset 0 (Length 1044480, Sparse  Cluster 1) Delegate NullReader",
    ]
    assert len(extents.contents(extents.chunks(records.attributes(rows).where("type = 128"))).first().data) == 1 << 20


def test_stream_at_cluster_zero(spark):
    rows = decoded(spark, [(7, encode.record(7, 1, T0, [name("$Boot")], [encode.mapped(1, "", [(0, 2)], (0, 1), 8192)]))])
    disk = spark.createDataFrame([(0, b"B" * 4096), (1, b"C" * 4096)], "lcn long, data binary")
    got = extents.contents(extents.chunks(records.attributes(rows).where("type = 128"), disk)).first()
    assert bytes(got.data) == b"B" * 4096 + b"C" * 4096


def test_hostile_records(spark):
    """Bytes of any kind pass through all operators of records."""
    import random

    r = random.Random(3)
    good = encode.record(7, 1, T0, [name("a")], [encode.mapped(3, "", [(5, 2), (None, 3)], (0, 4), 9000, flags=1, unit=1), encode.index_root([(9, 1, name("x"))])], lists=[encode.attribute_list([(48, 1, 8, 0)])])
    rows = [(1, None), (2, b""), (3, b"FILE")]
    for i in range(150):
        b = bytearray(good)
        for _ in range(r.randrange(1, 20)):
            b[r.randrange(8, 1024)] = r.randrange(256)
        rows.append((10 + i, bytes(b)))
    one = records.expand(decoded(spark, rows)).cache()
    assert one.count() == len(rows)
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(records.with_streams(records.highlights(one)))
    run(records.stat(one))
    run(records.model(one, paths.of_records(one)))
    assert records.audit(one).count() > 0
    run(index.file_info(index.nodes(one)))
    small = records.attributes(one).where("size between 0 and 100000 and initialized between 0 and 100000")
    run(extents.digests(extents.chunks(small)))
    run(extents.run_text(extents.run_info(extents.extents(records.attributes(one)))))
    none = decoded(spark, [])
    assert records.expand(none).count() == paths.of_records(none).count() == index.nodes(none).count() == 0


def test_space(tmp_path):
    """Reads past the end are zeros, before the start nothing; files are joined; a shift moves the start."""
    (tmp_path / "one.bin").write_bytes(b"abcde")
    one = Space(str(tmp_path / "one.bin"))
    assert one.read(1, 1) == b"b" and one.read(3, 3) == b"de\0" and one.read(30, 3) == b"\0\0\0" and one.read(-1, 3) == b"" and len(one.read(1, 300)) == 300
    assert Space(str(tmp_path / "one.bin"), 2).read(0, 3) == b"cde"
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "0x00000004.bin").write_bytes(b"efgh")
    (folder / "0.bin").write_bytes(b"abcd")
    (folder / "16.bin").write_bytes(b"q")
    many = Space(f"file:{folder}")
    assert many.read(2, 4) == b"cdef" and many.read(6, 11) == b"gh" + bytes(8) + b"q" and many.dense() == [(0, 8), (16, 17)] and many.size == 17
    with pytest.raises(FileNotFoundError):
        Space(str(tmp_path / "none"))


def test_pages(spark, tmp_path):
    rows = [(4096 * i, bytes([i]) * 4096) for i in (0, 1, 2, 40, 41)]
    pages.write_pages(spark.createDataFrame(rows, "offset long, data binary"), str(tmp_path / "p"), 2)
    back = pages.read_pages(spark, str(tmp_path / "p"))
    assert sorted((r.offset, bytes(r.data)) for r in back.collect() if any(r.data)) == rows[1:]
    some = pages.read_pages(spark, str(tmp_path / "p"), partitionBytes=8192).where("offset >= 8192 and offset < 163840 + 4096")
    assert [r.offset for r in some.orderBy("offset").collect() if any(r.data)] == [8192, 163840]
    wide = pages.read_pages(spark, str(tmp_path / "p"), blockSize=8192, overlap=4096).where("offset = 0").first()
    assert bytes(wide.data) == b"\0" * 4096 + b"\x01" * 4096 + b"\x02" * 4096
    clusters = {r.lcn: bytes(r.data) for r in pages.read_disk(spark, str(tmp_path / "p"), 512).where("lcn between 8 and 9").collect()}
    assert clusters == {8: b"\x01" * 512, 9: b"\x01" * 512}


def volume(tmp_path, fragments):
    """A volume of 64 records in fragments of four clusters each, the later ones named by a list in record 3."""
    place = [10 + 8 * (fragments - i) for i in range(fragments)]
    first = encode.mapped(1, "", [(place[0], 4)], (0, 3), fragments * 16384)
    lists = [encode.attribute_list([(128, 1, 0, 0), (128, 2, 3, 4)])] if fragments > 1 else []
    table = {0: encode.record(0, 1, T0, [name("$MFT")], [first], lists=lists), 5: encode.record(5, 5, T0, [name(".")], directory=True)}
    if fragments > 1:
        table[3] = encode.record(3, 1, None, [], [encode.mapped(2, "", [(p, 4) for p in place[1:]], (4, 4 * fragments - 1), 0, 0)])
    for e in range(6, 16 * fragments):
        table[e] = encode.record(e, 1, T0, [name(f"f{e}")])
    image = bytearray(4096 * (10 + 8 * fragments + 8))
    image[:512] = encode.boot_sector(place[0], len(image) // 512)
    for e, raw in table.items():
        at = place[e // 16] * 4096 + e % 16 * 1024
        image[at : at + 1024] = raw
    path = tmp_path / f"image{fragments}"
    path.write_bytes(b"skip" * 128 + bytes(image))
    return str(path), len(table)


@pytest.mark.parametrize("fragments", [1, 4])
def test_volume_source(spark, tmp_path, fragments):
    path, count = volume(tmp_path, fragments)
    rows = records.decode(mft.read_volume(spark, path, imageOffset=512, partitionBytes=4096))
    assert rows.count() == count and rows.where("error is not null or number <> entry").count() == 0
    few = mft.read_volume(spark, path, imageOffset=512).where("entry > 7 and entry <= 9")
    assert [r.entry for r in few.orderBy("entry").collect()] == [8, 9]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "entry" in plan
    _, boot = mft.open_volume(path, 512)
    assert (boot.cluster, boot.record, boot.sector) == (4096, 1024, 512)
    with pytest.raises(ValueError, match="Invalid magic"):
        mft.open_volume(path, 0)


def test_snapshot_chain(spark, tmp_path):
    """Two catalogue blocks that lead to each other are each read once."""
    image = bytearray(0x30000)
    image[0x1E00 : 0x1E00 + 128] = encode.snapshot_header(0x10000)
    for at, to in ((0x10000, 0x20000), (0x20000, 0x10000)):
        image[at : at + 0x4000] = encode.snapshot_block(encode.guid(7), at, to, [encode.snapshot_volume(5, encode.guid(1), T)])
    (tmp_path / "v").write_bytes(bytes(image))
    rows = snapshots.read_snapshots(spark, str(tmp_path / "v"))
    assert rows.count() == 2 * 127 and rows.select("identifier").distinct().first()[0] == snapshots.guid_text(encode.guid(7))


def test_texts(spark):
    one = spark.createDataFrame([(132_000_000_000_000_000,), (132_000_000_001_234_500,), (0,)], "ft long").select(sinks.time_text(F.col("ft")))
    assert [r[0] for r in one.collect()] == ["2019-04-17 18:40:00 +0000 UTC", "2019-04-17 18:40:00.12345 +0000 UTC", "0001-01-01 00:00:00 +0000 UTC"]
    rows = spark.createDataFrame([("a", True, 31), ("b", False, 0)], "n string, s boolean, o long")
    assert [r[0] for r in rows.select(sinks.slack_label(F.col("n"), F.col("s"), F.col("o"))).collect()] == ["a (slack @ 0x1f)", "b"]
    dump = spark.createDataFrame([(b"0123456789abcdef\x00\xff!",)], "d binary").select(sinks.hex_dump(F.col("d"))).first()[0]
    assert dump.split("\n")[0] == "00000000  30 31 32 33 34 35 36 37  38 39 61 62 63 64 65 66  |0123456789abcdef|" and dump.endswith("|..!|")


def test_audit_range(spark):
    rows = decoded(spark, [(1, encode.record(2, 1, T0, [name("a")])), (3, encode.record(3, 1, T0, [])), (4, b"")])
    assert sorted(map(tuple, records.audit(rows).collect())) == [(1, "NumberMismatch"), (3, "NoName"), (4, "EntryTooShortError")]
    assert [r.entry for r in records.audit(rows, 2, 4).collect()] == [3]


def test_journal_merge(spark):
    """What a journal remembers may be chosen: the last name instead of the first."""
    raw = b"".join(encode.usn(7, 1, 5, 5, 10 + i, T, 256, f"n{i}") for i in range(3))
    rows = journal.scan(spark.createDataFrame([(0, raw)], "base long, data binary"))
    assert journal.history(rows).first().name == "n0" and journal.history(rows, F.max_by).first().name == "n2"
    assert journal.with_paths(rows, decoded(spark, []), options=paths.PathOptions(resolve=False)).first().full_path.startswith("n")


def test_records_kernel_matches_schema(spark):
    assert [f.name for f in decoded(spark, []).schema] == ["entry", *(n for n, _ in kernels.RECORD_FIELDS)]
