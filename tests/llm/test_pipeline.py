import corpus_pipeline
from weftline.llm import decontaminate as D
from weftline.llm import queries

from .test_jaccard import plain_left
from .test_line_dedup import plain as plain_lines
from .test_tokens import check_packing


def test_stages_against_plain_versions(spark, sf):
    """Each stage on what the one before it kept; its rows held against a plain version."""
    docs = queries.documents(spark, sf)
    before = {r.doc_id: r.text for r in docs.collect()}
    (_, language), (_, lines), (_, copies), (_, leaks), (_, pack) = corpus_pipeline.STAGES

    def step(stage, df):
        out = stage(spark, df, sf)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{stage.__name__}"
        out.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        return df, {r.doc_id: r.text for r in df.collect()}

    df, one = step(language, docs)
    assert all(before[i] == t for i, t in one.items()) and len(one) >= 0.98 * len(before)
    df, two = step(lines, df)
    assert two == {i: t for i, (t, _, _) in plain_lines(list(one.items())).items()}
    df, three = step(copies, df)
    stay = plain_left(two)
    assert three == {i: t for i, t in two.items() if i in stay}
    df, four = step(leaks, df)
    bench = [" ".join(D.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {i for i, t in three.items() if any(b and f" {b} " in f" {' '.join(D.words(t))} " for b in bench)}
    assert set(four) == set(three) - holds
    n, least = check_packing(list(four.items()), pack(spark, df, sf).collect())
    assert n <= least * 1.02 + 1


def test_run_is_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_edge_cases_pass_every_stage(spark, clashing, sf):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    words = " ".join(f"word{chr(97 + i % 26)}" for i in range(400))
    rows = [(1, words), (1, words), (2, words), (3, None), (4, ""), (5, "123"), (None, "text without an id"), (6, "long " * 60_000), (7, "a\n\nb")]
    df = clashing(rows).selectExpr("doc_id", "text", "nullif(lang, if(doc_id = 2, 'en', '')) as lang", "cast(null as string) as source", "nullif(n_chars, 0) as n_chars", "id", "t", "lines", "gone", "fp")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == corpus_pipeline.COLUMNS, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/edge-{name}"
        df.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        ids.append(sorted(r.doc_id or 0 for r in df.collect()))
    assert ids == [[0, 1, 1, 2, 6, 7], [0, 1, 1, 2, 6, 7], [0, 1, 1, 6, 7], [0, 1, 1, 6, 7]]
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
    assert {r.doc_id for r in packed} == {None, 1, 6, 7} and max(r.piece for r in packed) > 20


def test_empty_tables_pass_every_stage(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), sf).collect() == [], name
