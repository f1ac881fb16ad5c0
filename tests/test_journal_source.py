"""The journal as a source: batch, stream from the start, stream from the last record."""

from sectorlake.operators import sinks
from sectorlake.plans import encode
from sectorlake.sources.journal import read_journal
from sectorlake.streaming.watch import PathWatch, watch, watch_paths

FT = 132_000_000_000_000_000


def add(path, numbers):
    with open(path, "ab") as f:
        for i in numbers:
            f.write(encode.usn(i, 1, 5, 5, i, FT + i, 256, f"f{i}"))


def test_batch(spark, tmp_path):
    add(tmp_path / "0.usn", [1, 2])
    add(tmp_path / "65536.usn", [3])
    rows = read_journal(spark, str(tmp_path))
    assert sorted((r.file, r.name) for r in rows.collect()) == [(1, "f1"), (2, "f2"), (3, "f3")]
    assert [r.offset for r in read_journal(spark, str(tmp_path), **{"from": 65536}).collect()] == [65536]
    assert [r.offset for r in rows.where("offset > 0 and offset < 1000").collect()] == [64]


def test_windows(spark, tmp_path, monkeypatch):
    """Records that cross windows come once, whatever the windows are."""
    from sectorlake.sources import journal

    add(tmp_path / "4096.usn", range(1, 200))
    part = journal._stretches(journal.segments(str(tmp_path)), -1, 1 << 40, 1 << 30)
    for window in (72, 1000, 4096, 1 << 20):
        monkeypatch.setattr(journal, "WINDOW", window)
        assert [f for p in part for b in journal._batches(str(tmp_path), p) for f in b.column("file").to_pylist()] == list(range(1, 200))
    assert journal.JournalTail({"path": str(tmp_path)})._last() == 4096 + part[0].part.size - 72


def run(spark, tmp_path, name, starting):
    made = watch(spark, str(tmp_path / "j"), starting).select("file", "reasons")
    return made.writeStream.format("memory").queryName(name).outputMode("append").start()


def test_stream(spark, tmp_path):
    (tmp_path / "j").mkdir()
    add(tmp_path / "j" / "0.usn", [1, 2])
    early, late = run(spark, tmp_path, "early", "earliest"), run(spark, tmp_path, "late", "latest")
    try:
        early.processAllAvailable()
        late.processAllAvailable()
        add(tmp_path / "j" / "0.usn", [3])
        with open(tmp_path / "j" / "0.usn", "ab") as f:  # half of a record
            f.write(encode.usn(4, 1, 5, 5, 4, FT, 256, "f4")[:30])
        early.processAllAvailable()
        late.processAllAvailable()
        with open(tmp_path / "j" / "0.usn", "ab") as f:
            f.write(encode.usn(4, 1, 5, 5, 4, FT, 256, "f4")[30:])
        add(tmp_path / "j" / "65536.usn", [5])
        early.processAllAvailable()
        late.processAllAvailable()
        assert sorted(r.file for r in spark.table("early").collect()) == [1, 2, 3, 4, 5]
        assert sorted(r.file for r in spark.table("late").collect()) == [3, 4, 5]
    finally:
        early.stop()
        late.stop()


def test_bytes(spark, tmp_path):
    chunks = spark.createDataFrame([(3, b"def"), (0, b"abc")], "offset long, data binary")
    assert sinks.write_bytes(chunks, str(tmp_path / "x")) == 6 and (tmp_path / "x").read_bytes() == b"abcdef"
    assert sinks.write_bytes(chunks, str(tmp_path / "x"), 2) == 4 and (tmp_path / "x").read_bytes() == b"cdef"


def test_paths_follow_the_volume(spark, tmp_path):
    """Every batch sees the records as they are by then, and remembers files that are gone."""
    from sectorlake.operators import records

    names = {20: (1, "old")}

    def snapshot():
        t = (FT,) * 4
        return records.decode(spark.createDataFrame([(e, encode.record(e, s, t, [encode.name_body(5, 5, t, 0, n)], directory=True)) for e, (s, n) in names.items()], "entry long, raw binary"))

    seen = []
    follow = PathWatch(spark, snapshot, lambda df, n: seen.extend((r.file, r.full_path) for r in df.collect()), memory=str(tmp_path / "memory"))
    folder = tmp_path / "j"
    folder.mkdir()
    with open(folder / "0.usn", "wb") as f:
        f.write(encode.usn(20, 1, 5, 5, 1, FT, 256, "old") + encode.usn(31, 1, 20, 1, 2, FT, 256, "a"))
    query = watch_paths(watch(spark, str(folder), "earliest"), follow, str(tmp_path / "checkpoint"), "0 seconds")
    try:
        query.processAllAvailable()
        names[20] = (2, "new")
        with open(folder / "0.usn", "ab") as f:
            f.write(encode.usn(32, 1, 20, 1, 3, FT, 256, "b") + encode.usn(33, 1, 20, 2, 4, FT, 256, "c") + encode.usn(34, 1, 20, 3, 5, FT, 256, "d"))
        query.processAllAvailable()
    finally:
        query.stop()
    got = dict(seen)
    assert (got[31], got[32], got[33], got[34]) == ("old\\a", "old\\b", "new\\c", "<Err>\\<Parent 20-2 need 3>\\d")


def test_a_folder_that_goes_fails_the_stream(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    add(folder / "0.usn", [1])
    query = watch(spark, str(folder), "earliest").select("file").writeStream.format("memory").queryName("gone").start()
    query.processAllAvailable()
    (folder / "0.usn").unlink()
    folder.rmdir()
    try:
        query.processAllAvailable()
        raise AssertionError("the query went on")
    except Exception as e:
        assert "FileNotFoundError" in str(e)
    finally:
        query.stop()
