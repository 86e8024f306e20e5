"""Line dedup in DataFrame functions only: explode normalised lines, hash, count
distinct documents per hash, drop the lines over the threshold, reassemble by
position.

Line hashes are two independent 64-bit hashes, so keys are compared by 128 bits.
The count is a two-step aggregate (per document, then per hash), both combined
before the shuffle; a line that a third of all documents hold costs one row per
task. The join that finds the dropped positions has a plain exchange on either
side, which adaptive execution can split. Texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, text_hash, gone): positions (from 0) of the lines to drop; only texts that
    lose a line. Rows that repeat an id may hold different texts, so these count by hash."""
    key = key_of(F.col("line"))
    lines = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .select("id", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_len)
        .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    lines = written(lines.where("id is not null"), "lines")
    often = (
        lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    )
    often = written(often, "often")
    return (
        lines.join(often, ["h1", "h2"]).where("id <> keeper")
        .groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with text_col replaced by the lines that stay, plus n_lines and
    n_dropped (longs); other columns pass through under their own names.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. Keys of ``min_len`` code points or more that ``min_docs`` or more
    documents hold lose all their lines except in the document with the largest id.

    Null or empty text: one empty line, text becomes "". Rows that repeat an id
    count as one document; each loses its own lines. A null id: nothing is
    dropped from it and it does not count. Very long texts are split whole. An
    empty table gives an empty table.
    Input columns named n_lines or n_dropped, in any case, are replaced; so is any
    other spelling of text_col.
    """
    gone = dropped_positions(docs, id_col, text_col, min_len, min_docs)
    # Names of docs may clash with any of these, so its columns travel in a struct and come out last.
    other = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(None)
    base = docs.select(row.alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("text_hash"))
    met = base.join(gone, ["id", "text_hash"], "left").select("_row", "_text", F.col("gone").alias("_gone"), lines_of(F.col("_text")).alias("_lines"))
    n = F.size("_lines")  # with a second use of it, the optimiser keeps the split in a step of its own
    at = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("_text", F.lit(""))).otherwise(
        F.array_join(F.transform(at, lambda p: F.get(F.col("_lines"), p)), "\n"))
    done = met.select("_row", kept.alias("_kept"), n.cast("long").alias("_n"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_m"))
    return done.select(*[F.col("_row").getField(c).alias(c) for c in other], F.col("_kept").alias(text_col), F.col("_n").alias("n_lines"), F.col("_m").alias("n_dropped"))
