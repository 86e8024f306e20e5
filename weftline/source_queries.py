"""Registered queries of the folder source: documents by it, lines of large files cut
into byte ranges, and a stream that is stopped and started anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators.iterate import shared_folder
from weftline.queries import registered, table
from weftline.sources import folder
from weftline.store_queries import LOADED_SQL, nation_files

LINES_SQL = "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"
#: Small, so that every file is cut many times.
PIECE = 4096


def fresh(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def text_files(spark, sf_dir, path: str, where: str = "true") -> str:
    """All lines of all texts as text files."""
    lines = table(spark, sf_dir, "documents").where(where).select(F.explode(F.split("text", "\n", -1)).alias("value"))
    lines.write.mode("append").text(path)
    return path


def counted(pieces):
    """How often each line stands in the pieces."""
    text = F.regexp_replace("text", r"\n\z", "")
    return pieces.select(F.explode(F.split(text, "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@registered(f"WITH {LOADED_SQL} SELECT title, file_type, status, text, problem FROM f")
def documents_by_source(spark, sf_dir):
    """Files below a folder by the data source: what the loader of documents gives."""
    pieces = spark.read.format(folder.register(spark)).load(nation_files(spark, sf_dir))
    return folder.documents_of(pieces).select("title", "file_type", "status", "text", "problem")


@registered(LINES_SQL)
def lines_in_pieces(spark, sf_dir):
    """The lines of all texts from files cut into ranges of 4,096 bytes: each once."""
    path = text_files(spark, sf_dir, fresh(spark, "lines"))
    return counted(spark.read.format(folder.register(spark)).option("pieceBytes", PIECE).option("partBytes", 64 * PIECE).load(path))


@registered(LINES_SQL)
def lines_streamed(spark, sf_dir):
    """The same as a stream: one half of the texts, a stop, the other half and a start
    from the checkpoint. No line is missed or read twice."""
    path, log, out, state = (fresh(spark, t) for t in ("arriving", "seen", "arrived", "state"))
    name = folder.register(spark)
    for half in ("doc_id % 2 = 0", "doc_id % 2 <> 0 OR doc_id IS NULL"):
        text_files(spark, sf_dir, path, half)
        pieces = spark.readStream.format(name).option("path", path).option("log", log).option("maxFiles", 3).option("pieceBytes", PIECE).load()
        q = pieces.select("file_path", "text").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return counted(spark.read.parquet(out))
