"""Triples from text by a pluggable extractor.

An extractor is a function of a text that gives (entities, relations). It runs on
executors, a batch of texts at a time; the default is a deterministic rule. A
model client can be put in its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import texts

from .chunk import chunk_documents
from .iterate import text_batches

Extractor = Callable[[str], tuple[Iterable[str], Iterable[tuple[str, str, str]]]]
NAME = re.compile(r"\b[A-Z]\w+(?:\s+[A-Z]\w+)*")
SENTENCE = re.compile(r"[^.!?\n]+")
MIN_CHARS = 10


def by_capitals(text: str) -> tuple[set[str], set[tuple[str, str, str]]]:
    """Capitalised names; two that follow one another in a sentence are related by
    the words between them."""
    entities, relations = set(), set()
    for sentence in SENTENCE.findall(text):
        found = list(NAME.finditer(sentence))
        entities.update(m[0] for m in found)
        for a, b in zip(found, found[1:]):
            between = " ".join(sentence[a.end():b.start()].split()[:3]).lower()
            relations.add((a[0], re.sub(r"\W+", "_", between).strip("_") or "related_to", b[0]))
    return entities, relations


def extract(docs: DataFrame, extractor: Extractor = by_capitals, id_cols: tuple[str, ...] = ("document_id",), text_col: str = "text") -> DataFrame:
    """(ids..., src, predicate, dst): relations, and entities as rows with only src.
    Texts of ten characters or fewer give nothing."""
    ids = list(id_cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*ids).schema) + ", src string, predicate string, dst string"

    def run(batches):
        for pdf in batches:
            rows = []
            for *own, text in pdf.itertuples(index=False):
                if text is None or len(text.strip()) <= MIN_CHARS:
                    continue
                entities, relations = extractor(text)
                rows += [(*own, e, None, None) for e in sorted(set(entities))] + [(*own, *r) for r in sorted(set(map(tuple, relations))) if len(r) >= 3]
            yield pd.DataFrame(rows, columns=[*ids, "src", "predicate", "dst"])

    return text_batches(docs).select(*ids, F.col(text_col)).mapInPandas(run, schema)


def extract_routed(docs: DataFrame, extractor: Extractor = by_capitals, limit: int = 8000, size: int = 1000, overlap: int = 200, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, route, src, predicate, dst) of a batch of documents: short ones
    whole, long ones by chunks with their findings merged, unsuitable ones not at
    all. Each finding once a document."""
    d = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("route", texts.route(F.col("text"), limit=limit))
    whole = extract(d.where("route = 'document'"), extractor, ("document_id",)).withColumn("route", F.lit("document"))
    parts = chunk_documents(d.where("route = 'chunk'").select("document_id", "text"), size, overlap)
    cut = extract(parts.select("document_id", F.col("content").alias("text")), extractor, ("document_id",)).withColumn("route", F.lit("chunk"))
    return whole.unionByName(cut).select("document_id", "route", "src", "predicate", "dst").distinct()


def by_document(triples: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(document_id, entities, relations): each document's findings as sorted arrays.
    Entities are also the ends of relations."""
    named = triples.select(id_col, F.explode(F.array("src", "dst")).alias("e")).where("e is not null").groupBy(id_col).agg(F.sort_array(F.collect_set("e")).alias("entities"))
    links = triples.where("predicate is not null").groupBy(id_col).agg(F.sort_array(F.collect_set(F.array("src", "predicate", "dst"))).alias("relations"))
    none = F.array().cast("array<array<string>>")
    return named.join(links, id_col, "left").select(id_col, "entities", F.coalesce("relations", none).alias("relations"))


def extracted_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges over all texts."""
    ends = triples.select(F.explode(F.array("src", "dst")).alias("node_id")).where("node_id is not null").distinct()
    return ends, triples.where("predicate is not null").select("src", "predicate", "dst").distinct()


def keywords(docs: DataFrame, n: int = 5, id_col: str = "document_id", text_col: str = "text", least: int = 4) -> DataFrame:
    """(document_id, keywords): each document's n most frequent words of ``least``
    Latin letters or more, lower-cased; of equally frequent ones the first in the
    alphabet. Documents without such a word have none and no row. A deterministic
    default for what a model may say better (see ``described``)."""
    w = docs.select(F.col(id_col).alias("document_id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]{%d,}" % least), 0)).alias("word"))
    counted = w.groupBy("document_id", "word").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("c"), "word"))
    top = counted.withColumn("r", rank).where(F.col("r") <= n)
    return top.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("r", "word")))["word"].alias("keywords"))


def described(docs: DataFrame, model: Callable[[str], dict], id_cols: tuple[str, ...] = ("document_id",), text_col: str = "text") -> DataFrame:
    """(ids..., topics, keywords) by a model: a function of a text that gives a
    dictionary with these lists. Texts of ten characters or fewer, and whatever the
    model leaves out, give empty lists; each list has its entries once, in order."""
    ids = list(id_cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*ids).schema) + ", topics array<string>, keywords array<string>"

    def run(batches):
        for pdf in batches:
            rows = []
            for *own, text in pdf.itertuples(index=False):
                said = model(text) if text is not None and len(text.strip()) > MIN_CHARS else {}
                rows.append((*own, *[list(dict.fromkeys(str(x) for x in said.get(k) or [])) for k in ("topics", "keywords")]))
            yield pd.DataFrame(rows, columns=[*ids, "topics", "keywords"])

    return text_batches(docs).select(*ids, F.col(text_col)).mapInPandas(run, schema)


def checked(triples: DataFrame, nodes: DataFrame | None = None, predicates: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(relations that stand, issues): of (..., src, predicate, dst) those with both
    ends and a predicate, that are no loops, whose ends are among ``nodes`` and
    whose predicate is among ``predicates``, where these are given; others with the
    first reason against them, in ``issue``."""
    t = triples.where("predicate is not null or dst is not null")

    def blank(c: str):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    issue = F.when(blank("src") | blank("dst"), "an end is missing").when(blank("predicate"), "no predicate").when(F.col("src") == F.col("dst"), "a loop")
    if predicates is not None:
        issue = issue.when(~F.col("predicate").isin(*predicates), "unknown predicate")
    if nodes is not None:
        known = nodes.select("node_id").distinct()
        for c in ("src", "dst"):
            t = t.join(known.select(F.col("node_id").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
        issue = issue.when(F.col("_src").isNull() | F.col("_dst").isNull(), "unknown node")
    t = t.withColumn("issue", issue).select(*triples.columns, "issue")
    return t.where("issue is null").drop("issue").distinct(), t.where("issue is not null")


def enrich_metadata(docs: DataFrame) -> DataFrame:
    """tags with topics and categories with keywords, each once; topics and keywords: the first five."""
    return docs.withColumns({
        "tags": F.array_union("tags", "topics"), "categories": F.array_union("categories", "keywords"),
        "topics": F.slice("topics", 1, 5), "keywords": F.slice("keywords", 1, 5)})
