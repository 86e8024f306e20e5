import io
import zipfile

from weftline.operators import graph
from weftline.plans.mapping import MappingSpec
from weftline.sources import files


def test_delimiters():
    assert files.delimiter_of(["a,b", "1,2"]) == "," and files.delimiter_of(["a;b", "1;2"]) == ";" and files.delimiter_of(["a|b|c", "1|2|3"]) == "|"
    assert files.delimiter_of(["a\tb,c", "1\t2", "3\t4"]) == "\t" and files.delimiter_of(["one", "two"]) == "," == files.delimiter_of([])


def test_read_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name ;note;n\n"A; b";"two\nlines";1\nshort\nlong;x;2;extra\n')
    rows = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv")).collect()]
    assert rows == [("A; b", "two\nlines", "1"), ("short", "", ""), ("long", "x", "2")]
    assert files.read_csv(spark, str(tmp_path / "x.csv"), limit=1).columns == ["name", "note", "n"]


def test_csv_read_in_parts(spark, tmp_path):
    """Files whose rows are lines are cut into parts with the same rows; a cell with
    a line end anywhere, also far behind the first rows, keeps a file whole."""
    cells = [(str(i), f'say ""{i}""; and' if i % 2 else "") for i in range(20_000)]
    plain = "k;v\n" + "".join(f'{k};"{v}"\n' if v else f"{k};\n" for k, v in cells)
    (tmp_path / "plain.csv").write_text(plain)
    (tmp_path / "late.csv").write_text(plain + 'x;"two\nlines"\n')
    want = [(k, v.replace('""', '"')) for k, v in cells]
    name, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "65536")
    try:
        df = files.read_csv(spark, str(tmp_path / "plain.csv"))
        assert df.rdd.getNumPartitions() > 3 and sorted(map(tuple, df.collect())) == sorted(want)
        late = files.read_csv(spark, str(tmp_path / "late.csv"))
        assert late.rdd.getNumPartitions() == 1 and sorted(map(tuple, late.collect())) == sorted(want + [("x", "two\nlines")])
    finally:
        spark.conf.set(name, old)
    for text in ('k;v\n1;5" pipe\n', 'k;v\r\n1;2\r\n', "k;v\n \n1;2\n", 'k;v\n1;"a"b\n'):
        (tmp_path / "odd.csv").write_bytes(text.encode())
        assert not files.rows_are_lines(spark, str(tmp_path / "odd.csv"), ";")
    for text in ('k|v\n"a|""b"|""\n', "k|v\n\n1|2", ""):
        (tmp_path / "even.csv").write_bytes(text.encode())
        assert files.rows_are_lines(spark, str(tmp_path / "even.csv"), "|")


def test_read_documents(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "sub").mkdir()
    for name, data in {"a.md": b"# T", "sub/b.TXT": "é".encode(), "c.docx": z.getvalue(), "d.docx": b"broken", "e.bin": b"x", "f.csv": b"h,i\n1,2\n", "g": b"?"}.items():
        (tmp_path / name).write_bytes(data)
    df = files.read_documents(spark, str(tmp_path))
    got = {r.file_name: (r.title, r.file_type, r.text) for r in df.collect()}
    assert got == {"a.md": ("a", "MD", "# T"), "b.TXT": ("b", "TXT", "é"), "c.docx": ("c", "DOCX", "Hello there\n"), "d.docx": ("d", "DOCX", ""), "e.bin": ("e", "BIN", ""), "f.csv": ("f", "CSV", "h=1, i=2"), "g": ("g", "", "")}
    known = df.where("file_name = 'a.md'").select("file_path")
    new = files.read_documents(spark, str(tmp_path), known=known)
    assert new.count() == 6
    assert tuple(files.ingest_summary(df, known, new)[["ok", "failed", "skipped"]].first()) == (3, 3, 1)
    files.register_parser(".bin", lambda b: b.decode() * 2)
    assert {r.text for r in files.read_documents(spark, str(tmp_path), "*.bin").collect()} == {"xx"}
    assert files.file_pages(df.where("file_name = 'a.md'")).first().page == "# T"


def test_graph_json(spark, tmp_path):
    (tmp_path / "kg.json").write_text('{"entities": ["a", "b", "a"],\n "relations": [["a", "p", "b"], ["x"]]}')
    n, e = files.read_graph_json(spark, str(tmp_path / "kg.json"))
    assert {r[0] for r in n.collect()} == {"a", "b"} and [tuple(r) for r in e.collect()] == [("a", "p", "b")]
    files.write_graph_json(n, e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/entities")).count() == 2
    (tmp_path / "m.json").write_text('{"entities": {"A": {"key": {"column": "x", "prefix": "a:"}}}}')
    spec = files.read_mapping(spark, str(tmp_path / "m.json"))
    assert isinstance(spec, MappingSpec)
    assert [r[0] for r in graph.nodes(spark.createDataFrame([("1",), ("",)], "x string"), spec).collect()] == ["a:1"]


def test_graph_documents_of_bounded_size(spark, tmp_path):
    odd = ['say "x"', "two\nlines", "é🔑", "back\\slash", ""]
    nodes = spark.createDataFrame([(x,) for x in odd + odd + [None] + [f"n{i}" for i in range(2000)]], "node_id string")
    edges = spark.createDataFrame([(f"n{i}", odd[i % 5], f"n{i // 2}") for i in range(900)] + [("n1", None, "n2"), ("n0", odd[0], "n0")], "src string, predicate string, dst string")
    path = str(tmp_path / "g")
    files.write_graph_documents(nodes, edges, path, size=100)
    raw = spark.read.json(path).collect()
    assert len(raw) == 21 + 9 and max(len(r.entities) + len(r.relations) for r in raw) < 200
    n, e = files.read_graph_json(spark, path, lines=True)
    assert {r.node_id for r in n.collect()} == {*odd, *(f"n{i}" for i in range(2000))} and n.count() == 2005
    assert {tuple(r) for r in e.collect()} == {(f"n{i}", odd[i % 5], f"n{i // 2}") for i in range(900)}
    files.write_graph_documents(nodes.limit(0), edges.limit(0), str(tmp_path / "none"))
    assert [d.count() for d in files.read_graph_json(spark, str(tmp_path / "none"), lines=True)] == [0, 0]
