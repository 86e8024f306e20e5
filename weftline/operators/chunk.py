"""Chunkers: recursive, by Markdown structure, and by page. Cutting a text is
sequential by nature, so it runs in a pandas UDF, a batch of texts at a time; what
follows (ids, neighbours, counts) is DataFrame work."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import texts
from weftline.functions.normalizers import text as as_text

from .iterate import text_batches

SEPARATORS = ("\n\n", "\n", " ")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)(?:\s+#+)?$", re.M)
MAX_DEPTH = 4


def pieces(text: str, begin: int, end: int, size: int, level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``size`` that cover begin to end, cut after the coarsest separators that do."""
    if end - begin <= size:
        return [(begin, end)] if end > begin else []
    if level == len(SEPARATORS):
        return [(i, min(i + size, end)) for i in range(begin, end, size)]
    sep, out, at = SEPARATORS[level], [], begin
    while at < end:
        cut = text.find(sep, at, end)
        stop = end if cut < 0 else cut + len(sep)
        out += pieces(text, at, stop, size, level + 1)
        at = stop
    return out


def recursive(text: str, size: int, overlap: int, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Spans of chunks of at most ``size``, white space at their ends left out. Each
    begins with as many of the last pieces before it as ``overlap`` holds."""
    spans, out, run = pieces(text, begin, len(text) if end is None else end, size), [], []

    def close():
        a, b = run[0][0], run[-1][1]
        body = text[a:b]
        a, b = a + len(body) - len(body.lstrip()), b - (len(body) - len(body.rstrip()))
        if a < b and (not out or out[-1][1] < b):
            out.append((a, b))

    for s in spans:
        if run and s[1] - run[0][0] > size:
            close()
            while run and (run[-1][1] - run[0][0] > overlap or s[1] - run[0][0] > size):
                run.pop(0)
        run.append(s)
    if run:
        close()
    return out


class Section:
    def __init__(self, level: int, title: str, begin: int, body: int):
        self.level, self.title, self.begin, self.body, self.end = level, title, begin, body, body
        self.children: list[Section] = []


def sections(text: str) -> Section:
    """The tree of headings; headings deeper than MAX_DEPTH belong to the section's
    text, and text before the first heading is the root's."""
    root = Section(0, "", 0, 0)
    path = [root]
    for m in HEADING.finditer(text):
        level = len(m[1])
        if level > MAX_DEPTH:
            continue
        while path[-1].level >= level:
            path.pop()
        path[-1].children.append(Section(level, m[2].strip(), m.start(), m.end()))
        path.append(path[-1].children[-1])

    def close(s: Section, end: int) -> None:
        s.end = end
        for child, after in zip(s.children, [*(c.begin for c in s.children[1:]), end]):
            close(child, after)

    close(root, len(text))
    return root


def structured(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin, end, path of headings): whole sections while they fit, neighbours
    packed together, larger ones by their parts and in the end recursively."""
    out: list[tuple[int, int, str]] = []

    def walk(s: Section, path: str) -> None:
        here = f"{path} > {s.title}" if path and s.title else s.title or path
        if s.end - s.begin <= size:
            add(s.begin, s.end, here)
            return
        own = s.children[0].begin if s.children else s.end
        for a, b in recursive(text, size, overlap, s.begin, own):
            out.append((a, b, here))
        run = None
        for c in s.children:
            if run and c.end - run[0] <= size:
                run = (run[0], c.end, run[2])
                continue
            if run:
                add(*run)
            run = None
            if c.end - c.begin > size:
                walk(c, here)
            else:
                run = (c.begin, c.end, f"{here} > {c.title}" if here else c.title)
        if run:
            add(*run)

    def add(a: int, b: int, path: str) -> None:
        body = text[a:b]
        a, b = a + len(body) - len(body.lstrip()), b - (len(body) - len(body.rstrip()))
        if a < b:
            out.append((a, b, path))

    walk(sections(text), "")
    return out


SPANS = "array<struct<begin:int,end:int,section:string,content:string>>"


def chunk_spans(text: Column, strategy: Column, size: int, overlap: int) -> Column:
    """A text's chunks with their content, so that what follows needs the text no more."""

    @F.pandas_udf(SPANS)
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        def one(x, how):
            found = structured(x, size, overlap) if how == "structured_markdown" else []
            found = found or [(a, b, "") for a, b in recursive(x, size, overlap)]
            return [{"begin": a, "end": b, "section": p, "content": x[a:b]} for a, b, p in found]

        return pd.Series([one(x, how) for x, how in zip(t, s)])

    return run(as_text(text), strategy)


def strategy(text: Column, file_type: Column | None = None, wanted: str = "auto") -> Column:
    """structured_markdown or recursive. auto: Markdown by type, or by a heading in the text."""
    if wanted != "auto":
        return F.lit("structured_markdown" if wanted == "structured_markdown" else "recursive")
    has = as_text(text).rlike(r"(?m)^#{1,6}\s+\S")
    if file_type is not None:
        has = has | F.lower(as_text(file_type)).isin("md", ".md", "markdown", ".markdown")
    return F.when(has, "structured_markdown").otherwise("recursive")


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_id (document and number), prev_id and next_id, from document_id and idx."""
    w = Window.partitionBy("document_id").orderBy("idx")
    c = chunks.withColumn("chunk_id", F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), F.col("idx").cast("string")))
    return c.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200, wanted: str = "auto", id_col: str = "document_id", text_col: str = "text", type_col: str | None = None) -> DataFrame:
    """Chunks with true offsets, word counts, section paths and neighbours. Null and
    blank texts have none."""
    how = strategy(F.col(text_col), F.col(type_col) if type_col else None, wanted)
    d = text_batches(docs).select(F.col(id_col).alias("document_id"), as_text(F.col(text_col)).alias("text"), how.alias("strategy"))
    c = d.select("document_id", "strategy", F.posexplode(chunk_spans(F.col("text"), F.col("strategy"), size, overlap)).alias("idx", "s"))
    c = c.select("document_id", "idx", F.col("s.content").alias("content"), F.col("s.begin").alias("start"), F.col("s.end").alias("end"), F.col("s.section").alias("section"), "strategy")
    return with_neighbours(c.withColumn("word_count", texts.word_count(F.col("content"))))


def running_lines(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", share: float = 0.6, least: int = 2) -> DataFrame:
    """(document_id, headers, footers): first and last non-blank lines that stand on
    a share of a document's pages, on two at least."""
    lines = F.filter(F.transform(F.split(F.col("page"), r"\r\n|\n|\r", -1), texts.strip), lambda x: x != "")
    p = docs.select(F.col(id_col).alias("document_id"), texts.pages(F.col(text_col)).alias("pages"))
    n = F.size("pages")
    p = p.select("document_id", n.alias("n"), F.explode("pages").alias("page")).select("document_id", "n", lines.alias("l"))
    ends = p.select("document_id", "n", F.inline(F.array(
        F.struct(F.lit("h").alias("kind"), F.get("l", F.lit(0)).alias("line")),
        F.struct(F.lit("f").alias("kind"), F.when(F.size("l") > 1, F.element_at("l", -1)).alias("line"))))).where("line is not null")
    often = ends.groupBy("document_id", "n", "kind", "line").agg(F.count("*").alias("c")).where(F.col("c") >= F.greatest(F.lit(least), F.floor(F.col("n") * share)))
    return often.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "h", F.col("line")))).alias("headers"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "f", F.col("line")))).alias("footers"))


def chunk_pages(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Pages without running lines, long ones cut further: chunks with page_number
    and strategy page or page+recursive."""
    none = F.array().cast("array<string>")
    d = text_batches(docs).select(F.col(id_col).alias("document_id"), as_text(F.col(text_col)).alias("text")).join(running_lines(docs, id_col, text_col, 0.6), "document_id", "left")
    p = d.select("document_id", F.coalesce("headers", none).alias("h"), F.coalesce("footers", none).alias("f"), F.posexplode(texts.pages(F.col("text"))).alias("page", "raw"))
    p = p.select("document_id", (F.col("page") + 1).alias("page_number"), texts.normalized_page(F.col("raw"), F.col("h"), F.col("f")).alias("text")).where("text <> ''")
    c = p.select("document_id", "page_number", F.posexplode(chunk_spans(F.col("text"), F.lit("recursive"), size, overlap)).alias("part", "s"))
    several = F.count("*").over(Window.partitionBy("document_id", "page_number")) > 1
    idx = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "part")) - 1
    c = c.select("document_id", idx.alias("idx"), F.col("s.content").alias("content"), F.col("s.begin").alias("start"), F.col("s.end").alias("end"), "page_number", F.when(several, "page+recursive").otherwise("page").alias("strategy"))
    return with_neighbours(c.withColumn("word_count", texts.word_count(F.col("content"))))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.avg(n).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def page_distribution(chunks: DataFrame, first: int = 5) -> DataFrame:
    return chunks.groupBy("page_number").agg(F.count("*").alias("chunks")).orderBy("page_number").limit(first)
