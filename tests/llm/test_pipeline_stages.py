"""Stages of the pipeline against plain versions of their own."""

import corpus_pipeline as P
from weftline.llm import decontaminate as D
from weftline.llm import langid, queries

from .test_decontaminate import plain_found


def test_language_stage_row_by_row(spark, sf):
    """Exactly the rows whose own prediction is a language of MIN_SCORE or more, unchanged."""
    more = [(10**6, None, "en", "s", 0), (10**6 + 1, "123 !", None, "s", 5), (10**6 + 2, "", "en", None, None), (None, "ξ ж ש", "fr", "s", 5)]
    docs = queries.documents(spark, sf)
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    model = langid.fit(docs, ~langid.held_out())
    want = set()
    for r in docs.collect():
        lang, score = model.predict(r.text)
        if lang != "und" and score >= P.MIN_SCORE:
            want.add(tuple(r[c] for c in P.COLUMNS))
    got = {tuple(r) for r in P.identify_language(spark, docs, sf).collect()}
    assert got == want and 0 < len(got) < docs.count() and not {r[0] for r in more[:3]} & {r[0] for r in got}


def test_language_stage_without_labels(spark, docs, sf):
    df = docs([(1, "some words"), (2, None)]).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert P.identify_language(spark, df, sf).collect() == []


def test_decontamination_stage_against_full_alignment(spark, sf):
    """On the first items of the benchmark: the rows that no alignment of theirs reaches."""
    docs = queries.documents(spark, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    texts = [(r.doc_id, r.text) for r in docs.collect() if len(D.words(r.text)) < 400]
    few = docs.where(docs.doc_id.isin([i for i, _ in texts]))
    hit = {d for d, _ in plain_found(texts, bench)}
    got = {r.doc_id for r in P.decontaminate_benchmark(spark, few, sf).collect()}
    assert hit and got == {i for i, _ in texts} - hit
