"""Readers and writers of files."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.mapping import MappingSpec

DELIMITERS = (",", "\t", ";", "|")


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that cuts most lines into the same number of columns, more than
    one; of equals the one with more columns, then the first."""
    best = (0, 0, 0, ",")
    for at, d in enumerate(DELIMITERS):
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=d) if r)
        columns, rows = max(((w, n) for w, n in widths.items() if w > 1), key=lambda x: (x[1], x[0]), default=(0, 0))
        best = max(best, (rows, columns, -at, d))
    return best[3]


def sniff_csv(spark: SparkSession, path: str, rows: int = 51) -> str:
    return delimiter_of([r.value for r in spark.read.text(path).limit(rows).collect()])


def rows_are_lines(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether each row is surely one line, so that a file may be read in parts: once
    the cells that are quoted from end to end are taken out of a line, no quote is
    left. Every line is looked at, in parallel, until one does not say so. Carriage
    returns and lines of blanks, which Spark's two ways of reading take differently,
    do not say so either."""
    d = re.escape(delimiter)
    quoted = f'(?<=^|{d})"(?:[^"]++|"")*+"(?={d}|$)'
    lines = spark.read.text(path, lineSep="\n")
    bare = F.regexp_replace("value", quoted, "")
    return lines.where(bare.contains('"') | F.col("value").contains("\r") | F.col("value").rlike(r"^[\x00-\x20]+$")).isEmpty()


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, limit: int | None = None, multi_line: bool | None = None) -> DataFrame:
    """All cells as text under the header's names without blanks at the ends; short
    rows are filled with "", long ones cut.

    multi_line: whether a cell may hold line ends, which makes every file one task.
    Left out, it is found by one look at all lines, and files whose rows are lines
    are read in parts; with ``limit`` nothing is looked at, for few rows are read."""
    sep = delimiter or sniff_csv(spark, path)
    if multi_line is None:
        multi_line = limit is not None or not rows_are_lines(spark, path, sep)
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns]).na.fill("")
    return df if limit is None else df.limit(limit)


def read_head(spark: SparkSession, path: str, rows: int = 30) -> tuple[str, list[str], DataFrame]:
    """(delimiter, headers, the first rows) of a CSV file."""
    delimiter = sniff_csv(spark, path)
    df = read_csv(spark, path, delimiter, rows)
    return delimiter, df.columns, df


# -- documents -------------------------------------------------------------------


def parse_text(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")


def parse_csv(data: bytes) -> str:
    """The first five rows as "header=value, ..."."""
    lines = parse_text(data).splitlines()
    rows = csv.DictReader(lines, delimiter=delimiter_of(lines[:51]))
    return "\n".join(", ".join(f"{k}={v or ''}" for k, v in r.items() if k) for _, r in zip(range(5), rows))


def parse_docx(data: bytes) -> str:
    """Paragraphs, one a line, from the package's main part."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p"))


PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
#: What shows text or starts a line in a content stream: a string, an array of strings, or an operator.
PDF_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[dDm*]|'|\"|\bET\b", re.S)
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(s: bytes) -> str:
    if s[:1] == b"<":
        digits = re.sub(rb"\s", b"", s[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else PDF_ESCAPES.get(x, b"" if x in b"\r\n" else x)

    return re.sub(rb"(?s)\\([0-7]{1,3}|.)", plain, s[1:-1]).decode("latin-1")


def simple_pdf_pages(data: bytes) -> list[str]:
    """Page texts of a plain PDF: pages and streams as objects of their own, streams
    as they are or deflated, simple fonts. Anything else is an error."""
    objects = {int(n): body for n, body in PDF_OBJECT.findall(data)}
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    if not pages:
        raise ValueError("no page objects that can be read without a PDF library")
    out = []
    for page in pages:
        lines, line = [], ""
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if found else []:
            body = objects.get(int(ref), b"")
            stream = PDF_STREAM.search(body)
            content = stream[1] if stream else b""
            if b"/FlateDecode" in body:
                content = zlib.decompress(content)
            elif b"/Filter" in body:
                raise ValueError("a stream filter that needs a PDF library")
            for shown in PDF_SHOWN.findall(content):
                if shown[:1] in (b"(", b"<"):
                    line += pdf_string(shown)
                elif line:
                    lines.append(line)
                    line = ""
        out.append("\n".join([*lines, line] if line else lines))
    return out


def parse_pdf(data: bytes) -> str:
    """Page texts with form feeds between: by a PDF library where one is installed,
    else plain files only. A file that cannot be read is an error."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return "\f".join(simple_pdf_pages(data))
    return "\f".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "md": parse_text, "markdown": parse_text, "txt": parse_text, "csv": parse_csv, "docx": parse_docx, "pdf": parse_pdf,
}


def register_parser(extension: str, parser: Callable[[bytes], str]) -> None:
    PARSERS[extension.lower().lstrip(".")] = parser


def read_documents(spark: SparkSession, path: str, glob: str = "*", known: DataFrame | None = None) -> DataFrame:
    """(document_id, title, file_name, file_path, file_type, file_size, status, text,
    problem) of all files below a folder. Unknown types and files that cannot be
    parsed have empty text, and problem says why; it is null otherwise. known: a frame with file_path; these files are left out before
    they are parsed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if known is not None:
        files = files.join(known.select(F.col("file_path").alias("path")), "path", "left_anti")
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, size, data in pdf.itertuples(index=False):
                name = p.rsplit("/", 1)[-1]
                stem, _, ext = name.rpartition(".")
                text, problem = "", None
                if ext.lower() not in parsers or not stem:
                    problem = "no parser for this type"
                else:
                    try:
                        text = parsers[ext.lower()](bytes(data))
                    except Exception as e:  # one broken file does not stop the others
                        problem = f"{type(e).__name__}: {e}"
                rows.append((stem or name, name, p, ext.upper() if stem else "", size, "pending", text, problem))
            yield pd.DataFrame(rows, columns=["title", "file_name", "file_path", "file_type", "file_size", "status", "text", "problem"])

    out = files.select("path", "length", "content").mapInPandas(run, "title string, file_name string, file_path string, file_type string, file_size long, status string, text string, problem string")
    return out.select(F.sha2("file_path", 256).alias("document_id"), "*")


def file_pages(docs: DataFrame) -> DataFrame:
    """(document_id, page_number, page): PDFs by form feed, others as one page."""
    pages = F.when(F.col("file_type") == "PDF", F.split("text", "\f", -1)).otherwise(F.array("text"))
    return docs.select("document_id", F.posexplode(pages).alias("n", "page")).select("document_id", (F.col("n") + 1).alias("page_number"), "page")


def ingest_summary(found: DataFrame, known: DataFrame, read: DataFrame) -> DataFrame:
    """One row: files read, skipped as known, and failed (empty)."""
    skipped = found.join(known.select("file_path"), "file_path", "left_semi").agg(F.count("*").alias("skipped"))
    done = read.agg(F.count_if(F.col("text") != "").alias("ok"), F.count_if(F.col("text") == "").alias("failed"))
    return done.join(skipped, F.lit(True))  # one row each


# -- graphs and specifications ----------------------------------------------------


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Lines of JSON: entities and relations under one folder each."""
    nodes.select("node_id").orderBy("node_id").write.mode("overwrite").json(f"{path}/entities")
    edges.select("src", "predicate", "dst").orderBy("src", "predicate", "dst").write.mode("overwrite").json(f"{path}/relations")


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_graph_json has written."""
    return spark.read.schema("node_id string").json(f"{path}/entities"), spark.read.schema("src string, predicate string, dst string").json(f"{path}/relations")


def write_graph_document(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document {"entities": [id], "relations": [[s, p, t]]}, both sorted. It
    streams through the driver, a partition at a time: for graphs that one JSON
    document suits."""
    ids = nodes.select("node_id").distinct().orderBy("node_id").toLocalIterator()
    links = edges.select("src", "predicate", "dst").distinct().orderBy("src", "predicate", "dst").toLocalIterator()
    with created(nodes.sparkSession, path) as write:
        for head, rows in (('{"entities": [', (json.dumps(r[0]) for r in ids)), ('], "relations": [', (json.dumps(list(r)) for r in links))):
            write(head.encode())
            for i, row in enumerate(rows):
                write(((",\n" if i else "\n") + row).encode())
        write(b"]}\n")


def write_graph_documents(nodes: DataFrame, edges: DataFrame, folder: str, size: int = 10_000) -> None:
    """The graph as many documents {"entities": [id], "relations": [[s, p, t]]}, one a
    line, in a new folder, written by all tasks: for graphs of any size. An id and a
    relation stand in one document each; a document has about ``size`` of one of both,
    sorted. Ids that are null and relations with a null part are left out."""

    def dealt(df: DataFrame, columns: list[str], value, name: str) -> DataFrame:
        d = df.select(*columns).dropna().distinct()
        parts = max(1, -(-d.count() // size))
        return d.groupBy(F.pmod(F.xxhash64(*columns), F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_list(value)).alias(name)).drop("part")

    entities = dealt(nodes, ["node_id"], F.col("node_id"), "entities").withColumn("relations", F.array().cast("array<array<string>>"))
    relations = dealt(edges, ["src", "predicate", "dst"], F.array("src", "predicate", "dst"), "relations").withColumn("entities", F.array().cast("array<string>"))
    entities.unionByName(relations).write.json(folder)


@contextmanager
def created(spark: SparkSession, path: str):
    """A new file of any file system that Spark knows; gives a function that writes bytes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        yield lambda data: out.write(bytearray(data))
    finally:
        out.close()


def read_knowledge_bases(spark: SparkSession, path: str) -> DataFrame:
    """(kb_id, owner_id, slug, name, description, created_at) of a registry {"items":
    [{id, name, slug, owner_id, description, created_at}]}; empty without items."""
    kind = "items array<struct<id:string,owner_id:string,slug:string,name:string,description:string,created_at:timestamp>>"
    df = spark.read.schema(kind).json(path, multiLine=True)
    return df.select(F.inline("items")).withColumnRenamed("id", "kb_id")


def write_knowledge_bases(kbs: DataFrame, path: str) -> None:
    """A registry that read_knowledge_bases reads, streamed through the driver."""
    columns = ["kb_id", "owner_id", "slug", "name", "description", "created_at"]
    made = kbs.select(*[F.col(c).alias("id" if c == "kb_id" else c) if c in kbs.columns else F.lit(None).cast("string").alias(c) for c in columns])
    with created(kbs.sparkSession, path) as write:
        write(b'{"items": [')
        for i, r in enumerate(made.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            write(((",\n" if i else "\n") + r["j"]).encode())
        write(b"]}\n")


def read_graph_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents {"entities": [id], "relations": [[s, p, t]]}, as nodes and edges: one
    a file, or one a line."""
    df = spark.read.schema("entities array<string>, relations array<array<string>>").json(path, multiLine=not lines)
    nodes = df.select(F.explode("entities").alias("node_id")).distinct()
    r = F.col("r")
    edges = df.select(F.explode("relations").alias("r")).where(F.size(r) >= 3).select(r[0].alias("src"), r[1].alias("predicate"), r[2].alias("dst")).distinct()
    return nodes, edges


def read_mapping(spark: SparkSession, path: str) -> MappingSpec:
    text = spark.read.text(path, wholetext=True).first()[0]
    return MappingSpec.of(json.loads(text))
