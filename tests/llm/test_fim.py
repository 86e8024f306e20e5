import hashlib
import re

from weftline.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t", "one", " one", "one ", "a b c d e f g", "\x01\x02m \x02e\x01\x01 \x02", "é 日本 \U0001f511 x  y\x0b\x0cz \r\n", "with <P> in it", "a <S", "<P <M< >", "S> x<", "\x00 \x1f", "$0 \\1 $1", " ".join(f"w{i}\n" for i in range(70_000)),
]


def test_against_plain_version(clashing):
    rows = [(20 * k + i, t) for k in range(20) for i, t in enumerate(TEXTS[:-1])] + [(k, TEXTS[-1]) for k in range(1000, 1006)] + [(None, "no id here"), (7, "twice the id"), (7, "twice the id")]
    df = clashing(rows).selectExpr("*", "'x' as form", "'x' as OUTPUT", "'x' as marked")
    out = fim.fill_in_middle(df)
    got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(out["output"], out["form"]).alias("back"), "marked").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(repr, ((i, t, *plain(i, t)) for i, t in rows)))
    assert all(r.back == (r.text or "") and r.marked == "x" for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_empty_table(docs):
    assert fim.fill_in_middle(docs([])).collect() == []


def test_query_on_whole_table(spark, sf):
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = {r.doc_id: (*plain(r.doc_id, r.text)[:4], sha(plain(r.doc_id, r.text)[4]), sha(r.text or "")) for r in queries.documents(spark, sf).collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_fill_in_middle(spark, sf).collect()} == want


def test_main_path_is_native(spark, sf):
    plan = queries.op13_fill_in_middle(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.split("== Physical Plan ==")[1].count("regexp_replace") == 1  # once a text
