"""Faults that a review found on larger tables."""

import hashlib
import os
import random
import time

import plain_encoders
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sectorlake.functions import arrow, codecs, kernels
from sectorlake.functions.layout import EPOCH
from sectorlake.operators import extents, index, paths, records
from sectorlake.plans import encode, queries, volume
from sectorlake.plans.volume import build
from sectorlake.sources import pages
from sectorlake.sources.storage import PACKED_BLOCK, Image, Space, segments

T0 = (133_000_000_000_000_000,) * 4


def decoded(spark, rows):
    return records.decode(spark.createDataFrame(rows, "entry long, raw binary"))


def test_clusters_are_not_broadcast(spark):
    """Clusters that compress to nothing are shuffled, whatever their size says."""
    made = [(k, encode.record(k, 1, T0, [], [encode.mapped(1, "", [(k * 10, 3)], (0, 2), 1500, cluster=512)])) for k in range(1, 40)]
    disk = spark.range(400).select(F.col("id").alias("lcn"), F.expr("cast(repeat('x', 512) as binary)").alias("data"))
    data = records.attributes(decoded(spark, made)).where("type = 128")
    found = extents.digests(extents.chunks(data, disk, 512))
    assert found.select("md5").distinct().count() == 1
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_own_size_is_of_the_unnamed_stream(spark):
    """An empty file with a stream has size 0 in its own row."""
    made = [(9, encode.record(9, 1, T0, [encode.name_body(5, 5, T0, 0, "x")], [encode.resident(3, "", b""), encode.resident(4, "side", b"de")]))]
    rows = records.highlights(decoded(spark, made))
    assert [r.file_size for r in rows.collect()] == [2]  # of the first stream that has any
    assert [(r.inode, r.file_size) for r in records.with_streams(rows).orderBy("stream_ord").collect()] == [("9", 0), ("9:side", 2)]


def test_slack_between_entries_is_none():
    """Shifted bytes of four equal times may be times too, but no entry begins there."""
    pages = []
    for page in range(938):
        keys = [k for k in range(page * 16, page * 16 + 16) if k < 15000]
        es = [(k, 1, encode.name_body(5, 5, (EPOCH + (1_500_000_000 + k) * 10**7,) * 4, k * 3, f"Customer#{k:09d}")) for k in keys]
        pages.append(encode.index_page([e for e in es if e[0] % 5], [e for e in es if e[0] % 5 == 0]))
    _, values = kernels.index_pages(pa.array(pages, pa.binary()))
    assert sorted(values["entry"][values["valid"]].tolist()) == list(range(15000))


def test_packed_pages(spark, tmp_path):
    """Any range of packed files, across blocks, gaps and files."""
    rows = [(4096 * i, bytes([i % 251 + 1]) * 4096) for i in range(0, 64)] + [(1 << 30, b"z" * 5000)]
    df = spark.createDataFrame(rows, "offset long, data binary").coalesce(1)
    pages.write_pages(df, str(tmp_path / "p"), packed=True, ordered=True)
    pages.write_pages(df, str(tmp_path / "q"), ordered=True)
    packed, plain = Space(str(tmp_path / "p")), Space(str(tmp_path / "q"))
    assert len(packed.parts) == 2 and packed.dense() == plain.dense() and packed.size == plain.size
    for offset, size in ((0, 10), (PACKED_BLOCK - 5, 10), (100, 3 * PACKED_BLOCK), (4096 * 64 - 3, 9), ((1 << 30) - 4, 8), ((1 << 30) + 4990, 50), (1 << 31, 7)):
        assert packed.read(offset, size) == plain.read(offset, size)


def test_a_volume_is_smaller_than_its_bytes(spark):
    """Records and index pages are mostly zeros; a volume of them took many times its tables."""
    parts = segments(build(spark, "/root/testdata/sf0.001"))
    assert sum(os.path.getsize(s.path) for s in parts) * 5 < sum(s.size for s in parts)


def test_chunks_of_an_image_are_those_of_its_clusters(spark, tmp_path):
    """Fragments, holes and compressed units in several places, read where they lie; no cluster is shuffled."""
    text = b"to be or not to be, that is the question. " * 400
    units = [codecs.lznt1_encode(text[i : i + 8192]).ljust(1024, b"\0") for i in range(0, len(text), 8192)]
    runs, disk = [], {}
    for i, u in enumerate(units):
        runs += [(100 + 10 * i, 1), (500 - 10 * i, 1), (None, 14)]
        disk |= {100 + 10 * i: u[:512], 500 - 10 * i: u[512:]}
    plain = {700 + k: bytes([k + 1]) * 512 for k in range(40)} | {650: b"q" * 512}
    made = [
        (6, encode.record(6, 1, T0, [], [encode.mapped(1, "", runs, (0, 16 * len(units) - 1), len(text), flags=1, unit=4, cluster=512)])),
        (7, encode.record(7, 1, T0, [], [encode.mapped(1, "", [(700, 40), (None, 3), (650, 1), (9000, 1)], (0, 44), 44 * 512 + 5, 44 * 512 + 3, flags=1 << 15, cluster=512), encode.resident(2, "a", b"abc")])),
    ]
    rows = sorted((disk | plain).items())
    pages.write_pages(spark.createDataFrame([(512 * k, v) for k, v in rows], "offset long, data binary"), str(tmp_path / "disk"), packed=True)
    data = records.attributes(decoded(spark, made)).where("type = 128")
    by_rows = extents.digests(extents.chunks(data, spark.createDataFrame(rows, "lcn long, data binary"), 512))
    by_image = extents.digests(extents.chunks(data, Image(str(tmp_path / "disk")), 512))
    assert sorted(by_image.collect()) == sorted(by_rows.collect())
    assert hashlib.md5(text).hexdigest() in [r.md5 for r in by_image.collect()]


def test_few_paths_load_their_directories_alone(spark):
    entries = spark.createDataFrame([(5, 6, "A"), (6, 7, "b"), (5, 9, "other"), (9, 10, "x")], "dir long, entry long, name string").selectExpr("*", "0L AS page", "0 AS ord", "false AS is_slack")
    loaded = []

    def load(dirs):
        loaded.append(dirs)
        return entries.where(F.col("dir").isin(dirs))

    asked = spark.createDataFrame([(1, "a/B"), (2, "\\a\\none"), (3, "/")], "id long, path string")
    assert sorted(map(tuple, index.open_few(asked, load).collect())) == sorted(map(tuple, index.open_path(asked, entries).collect())) == [(1, 7), (3, 5)]
    assert 9 not in sum(loaded, [])


def test_stretches_are_encoded_a_few_at_a_time(monkeypatch, spark):
    """A stretch is 256 events; a thousand of them as Python objects take hundreds of MB."""
    seen, mapped = [], volume.arrow.mapped

    def spy(df, kinds, kernel, rows=4096):
        seen.append(rows)
        return mapped(df, kinds, kernel, rows)

    monkeypatch.setattr(volume.arrow, "mapped", spy)
    assert queries._stretches(spark, "/root/testdata/sf0.001").count() and max(seen) <= 64


@pytest.mark.parametrize("codec", ["lznt1", "xpress", "xpress_huffman"])
def test_encoders_of_many_inputs(codec):
    """Byte for byte what the plain encoder gives, matches of any length, in a fraction of its time."""
    r = random.Random(7)
    words = [bytes(r.choices(b"abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(300)]
    parts = [b"", b"a", b"ab", b"abc", bytes(5000), b"abc" * 30_000, r.randbytes(9000), r.randbytes(70_000) * 3, r.randbytes(300) * 40, b"x" * 4096, b"x" * 4097]
    parts += [b" ".join(r.choices(words, k=r.choice((1, 9, 2000)))) for _ in range(60)]
    plain, many, decode = getattr(plain_encoders, codec + "_encode"), getattr(codecs, codec + "_encode_all"), getattr(codecs, codec)
    assert many([]) == []
    began = time.process_time()
    want = [plain(p) for p in parts]
    slow = time.process_time() - began
    began = time.process_time()
    got = many(parts)
    assert got == want and time.process_time() - began < slow / 1.5
    assert [decode(g, len(p)) if codec == "xpress_huffman" else decode(g) for g, p in zip(got, parts, strict=True)] == [(p, None) for p in parts]


def test_matches_across_blocks(monkeypatch):
    """Matches that begin before a block of the search, and reach beyond it."""
    r = random.Random(5)
    part = b"".join(r.choices([r.randbytes(k) for k in (3, 7, 40, 900)], k=400))
    monkeypatch.setattr(codecs, "BLOCK", 1000)
    for codec in ("lznt1", "xpress", "xpress_huffman"):
        assert getattr(codecs, codec + "_encode")(part) == getattr(plain_encoders, codec + "_encode")(part)


def test_codecs_take_slices_of_bounded_bytes():
    """A thousand long texts at a time as Python objects take what memory they like."""
    column = pa.array([b"x" * 100_000, None, b"", b"y" * 500_000, b"z" * 100_000, b"z" * 100_000] + [b"w"] * 50, pa.binary())
    parts = list(arrow.portions(iter([pa.RecordBatch.from_arrays([column], names=["body"])]), 40, "body"))
    assert pa.chunked_array([p.column(0) for p in parts]).to_pylist() == column.to_pylist()
    assert [sum(len(b or b"") for b in p.column(0).to_pylist()) for p in parts] == [100_000, 500_000, 200_034, 16]


def test_lists_join_once_for_each_record(spark):
    """What an attribute list names in one record comes from one row of it, not from one for each attribute."""
    names = [encode.name_body(5, 5, T0, 0, f"n{i}") for i in range(12)]
    listed = encode.attribute_list([(48, 1 + i % 4, 60 + i // 4, 0) for i in range(12)] + [(48, 9, 62, 0), (48, 1, 60, 0)])
    made = [(7, encode.record(7, 1, T0, [], lists=[listed], room=4096))] + [(60 + g, encode.record(60 + g, 1, None, names[4 * g : 4 * g + 4], base=7 | 1 << 48)) for g in range(3)]
    whole, bare = decoded(spark, made), records.decode(spark.createDataFrame(made, "entry long, raw binary"), bodies=False, lists=True)
    for rows in (whole, bare):
        got = records.with_parts(records.expand(rows)).where("entry = 7").first()
        assert [n.name for n in got.names] == [f"n{i}" for i in range(12)]  # the list ends at what is not there
    lists = whole.where("entry = 7").selectExpr("entry", "number", "inline(attributes)").where("type = 32").selectExpr("entry", "number", "ord AS list_ord", "content")
    assert [(r.ref, len(r.wants)) for r in records.list_members(lists).orderBy("ref").collect()] == [(60, 5), (61, 4), (62, 5)]


def test_requests_and_records_are_not_broadcast(spark):
    """The table that records are made of says little about the memory of their attributes."""
    chosen = queries.select_stream(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in chosen._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["full_paths", "open_by_path"])
def test_records_are_made_and_decoded_in_one_worker(monkeypatch, query, spark):
    """A worker for each of the two steps doubles the Python memory of an executor."""
    seen, keep = [], paths.keep

    def spy(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return keep(df)

    monkeypatch.setattr(paths, "keep", spy)
    assert queries.QUERIES[query](spark, "/root/testdata/sf0.001").count() == 1500 and max(seen) == 1


def test_chained_steps_give_what_they_give_apart(spark):
    """More rows than a slice, a step that gives none or several rows for one, and a binary column that bounds slices."""
    many = arrow.Step([("n", pa.int64()), ("b", pa.binary())], lambda p: {k: [x for n in p.column(0).to_pylist() for x in [v(n)] * (n % 3)] for k, v in (("n", int), ("b", lambda n: b"x" * n))}, rows=7)
    sizes = arrow.Step([("n", pa.int64()), ("size", pa.int64())], lambda p: {"n": p.column(0), "size": [len(b) for b in p.column(1).to_pylist()]}, 5, "b")
    df = spark.range(100, numPartitions=3)
    got = sorted(map(tuple, arrow.chained(df, many, sizes).collect()))
    assert got == sorted(map(tuple, arrow.chained(arrow.chained(df, many), sizes).collect())) == [(n, n) for n in range(100) for _ in range(n % 3)]
    assert arrow.chained(df.where("id < 0"), many, sizes).count() == 0
