import hashlib
from collections import defaultdict

from weftline.llm import line_dedup, queries

LONG = "A line that is certainly longer than forty code points"


def plain(rows, min_len=40, min_docs=5):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(upper)

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < min_len or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out[i] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    return out


def run(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df).collect()}


def test_matches_plain_version(docs):
    rows = [(i, f"own {i}\n{LONG}\n  {LONG.upper()}\t\nshort\n\n{'é' * 40 if i % 2 else 'x'}\n") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "\n".join(f"{LONG} {k}" for k in range(3000)) + f"\n{LONG}")]
    assert run(docs(rows)) == plain(rows)


def test_ties_repeats_nulls_and_clashing_names(clashing):
    rows = [(i, LONG) for i in range(4)]
    assert all(t == LONG for t, _, _ in run(clashing(rows)).values())  # one document short of five
    same = clashing(rows + [(3, LONG)])  # a repeated id is no fifth document
    assert {r.n_dropped for r in line_dedup.line_dedup(same).collect()} == {0}
    out = line_dedup.line_dedup(clashing(rows + [(4, LONG), (None, LONG)]))
    assert {(r.doc_id, r.n_dropped) for r in out.collect()} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (None, 0)}
    assert [r.id for r in out.collect()] == ["x"] * 6


def test_repeated_ids_with_texts_of_their_own(docs):
    """Each row loses its common lines, not those at the positions of another row."""
    own = "this line is nobody else's and of more than forty characters"
    out = line_dedup.line_dedup(docs([(1, f"{LONG}\nown 1"), (1, f"{own}\n{LONG}\nown 2"), *((i, LONG) for i in range(2, 6))]))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "own 1"), (1, f"{own}\nown 2"), (2, ""), (3, ""), (4, ""), (5, LONG)]


def test_very_long_text(docs):
    long = "\n".join(f"{LONG} {k % 2000}" for k in range(60_000))
    rows = [(i, f"{LONG} {i}") for i in range(4)] + [(9, long)] + [(10 + i, f"{LONG} 7") for i in range(5)]
    assert run(docs(rows)) == plain(rows)


def test_empty_table(docs):
    assert line_dedup.line_dedup(docs([])).collect() == []


def test_query_on_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (t, n, d) in plain(rows).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op5_line_dedup(spark, sf).collect()} == want


def test_main_path_is_native(spark, sf):
    plan = queries.op5_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_that_clash_in_another_case(docs):
    df = docs([(1, "a\nb"), (2, None)]).selectExpr("*", "'x' as N_LINES", "'y' as N_Dropped", "'z' as ID", "'v' as GONE")
    got = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "text", "id", "gone").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 0, "a\nb", "z", "v"), (2, 1, 0, "", "z", "v")]
