"""The folder source: ranges of bytes, packing of pieces, streams with restarts."""

import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.sources import files, folder


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\né\r", max_size=60), st.integers(1, 9))
def test_ranges_hold_every_line_once(text, size):
    """Ranges put together are the file, and each but the last ends with its line."""
    data = text.encode()
    got = [folder.lines_in(io.BytesIO(data), at, min(at + size, len(data))) for at in range(0, len(data), size)]
    assert b"".join(d for _, d in got) == data
    assert all(d.endswith(b"\n") for _, d in got[:-1] if d and not data.endswith(d))
    assert all(data[at : at + len(d)] == d for at, d in got)


def test_dealt():
    found = [("a.txt", 10), ("b.bin", 10), ("c.txt", 25), ("d.txt", 0)]
    parts = folder.dealt(found, 10, 20)
    assert [[(p[0], p[2], p[3], p[4]) for p in x.pieces] for x in parts] == [
        [("a.txt", 0, 0, None), ("b.bin", 0, 0, None)], [("c.txt", 0, 0, 10), ("c.txt", 1, 10, 20)], [("c.txt", 2, 20, 25), ("d.txt", 0, 0, None)]]
    assert folder.dealt([], 10, 20) == []
    assert len(folder.dealt([(f"{i}.txt", 1) for i in range(1000)], 8, 100)) == 10  # small files share tasks


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_batch(spark, tmp_path):
    """Hidden, unknown, broken and empty files; a long line over several ranges; subfolders."""
    root = f"{tmp_path}/in"
    lines = [b"x" * 50, b"", "é".encode() * 7, b"last"]
    put(f"{root}/deep/a.txt", b"\n".join(lines))
    put(f"{root}/none.txt", b"")
    put(f"{root}/b.csv", b"h,k\n1,2\n")
    put(f"{root}/c.zzz", b"?")
    put(f"{root}/d.docx", b"no zip")
    put(f"{root}/_hidden.txt", b"no")
    put(f"{root}/.dot/e.txt", b"no")
    name = folder.register(spark)
    got = spark.read.format(name).option("pieceBytes", 8).load(root).collect()
    a = sorted((r.piece, r.start, r.text) for r in got if r.file_name == "a.txt")
    assert "".join(t for *_, t in a).encode() == b"\n".join(lines) and a[0][2] == "x" * 50 + "\n"
    by = {r.file_name: r for r in got if r.file_name != "a.txt"}
    assert set(by) == {"none.txt", "b.csv", "c.zzz", "d.docx"}
    assert by["none.txt"].text == "" and by["none.txt"].problem is None and by["b.csv"].text == "h=1, k=2"
    assert by["c.zzz"].problem == "no parser for this type" and by["d.docx"].text == "" and "BadZipFile" in by["d.docx"].problem
    assert {r.file_name for r in spark.read.format(name).option("glob", "*.csv").load(f"file:{root}").collect()} == {"b.csv"}
    assert spark.read.format(name).option("recursive", "false").option("glob", "a*").load(root).count() == 0


def test_as_the_document_loader(spark, tmp_path):
    for i, kind in enumerate(("md", "txt", "csv", "odd", "")):
        put(f"{tmp_path}/in/f{i}{'.' + kind if kind else ''}", b"h\nv%d\n" % i)
    cols = ["title", "file_name", "file_type", "file_size", "status", "text", "problem"]
    want = files.read_documents(spark, f"{tmp_path}/in").select(cols).collect()
    got = folder.documents_of(spark.read.format(folder.register(spark)).load(f"{tmp_path}/in")).select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_own_parser(spark, tmp_path):
    put(f"{tmp_path}/in/a.mine", b"abc")
    files.register_parser("mine", lambda data: data.decode().upper())
    try:
        assert spark.read.format(folder.register(spark)).load(f"{tmp_path}/in").head().text == "ABC"
    finally:
        files.PARSERS.pop("mine")


def test_stream_restarts(spark, tmp_path):
    """Each file once over a stop and a start; a file that changed is new; a batch has maxFiles at most."""
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    name = folder.register(spark)

    def run():
        s = spark.readStream.format(name).option("log", f"{tmp_path}/log").option("maxFiles", 2).load(root)
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        counts = [p["numInputRows"] for p in q.recentProgress]
        q.stop()
        return counts

    for i in range(5):
        put(f"{root}/{i}.txt", b"%d\n" % i)
    assert max(run()) <= 2
    put(f"{root}/5.txt", b"5\n")
    put(f"{root}/0.txt", b"changed\n")
    run()
    run()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["0\n", "1\n", "2\n", "3\n", "4\n", "5\n", "changed\n"]


def test_a_list_without_an_offset_is_not_lost(tmp_path):
    """A stream that stopped after it made a list and before its offset was kept."""
    put(f"{tmp_path}/in/a.txt", b"a")
    options = {"path": f"{tmp_path}/in", "log": f"{tmp_path}/log"}
    assert folder.FolderStream(options, {}).latestOffset() == {"lists": 1}
    put(f"{tmp_path}/in/b.txt", b"b")
    again = folder.FolderStream(options, {})
    end = again.latestOffset()
    assert end == {"lists": 2}
    paths = [p[0].rsplit("/", 1)[-1] for part in again.partitions({"lists": 0}, end) for p in part.pieces]
    assert paths == ["a.txt", "b.txt"]
    with pytest.raises(ValueError):
        folder.FolderStream({"path": f"{tmp_path}/in"}, {})
