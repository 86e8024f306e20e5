"""Every graph query against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from weftline import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert got
    if name in Q.ORACLE:
        cur = con.execute(Q.ORACLE[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in sorted(cols)]
        assert canon(got) == canon(tuple(r[i] for i in at) for r in cur.fetchall())


def test_entry_without_the_text_operators():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_a_package_that_the_text_operators_need():
    """The graph queries stay; an error of the repository's own modules rises."""
    script = """
import sys
sys.modules[sys.argv[1]] = None
import __spark_entry__ as e
from weftline import queries as Q
assert set(e.queries()) == set(Q.QUERIES), len(e.queries())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import importlib.util

    if importlib.util.find_spec("weftline.llm") is None:
        return
    for name, fine in (("xxhash", True), ("weftline.llm.common", False)):
        done = subprocess.run([sys.executable, "-W", "ignore", "-c", script, name], cwd=root, capture_output=True, text=True)
        assert (done.returncode == 0) == fine, done.stderr
