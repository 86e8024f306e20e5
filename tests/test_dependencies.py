import itertools
import random

from weftline.operators import dependencies as D
from weftline.plans import ontology

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="a int, b int, c string, d int"):
    return spark.createDataFrame(rows, schema)


def plain_keys(rows, names, most):
    found = []
    for level in range(1, most + 1):
        for s in itertools.combinations(range(len(names)), level):
            if any(set(k) <= set(s) for k in found):
                continue
            values = [tuple(r[i] for i in s) for r in rows]
            if None not in itertools.chain(*values) and len(set(values)) == len(values):
                found.append(s)
    return {tuple(names[i] for i in s) for s in found}


def plain_functional(rows, names, known):
    def fixed(i):
        return len({r[i] for r in rows}) <= 1

    return {(names[i], names[j]) for i, j in itertools.permutations(range(len(names)), 2)
            if (names[i],) not in known and not fixed(i) and not fixed(j) and len({(r[i], r[j]) for r in rows}) == len({r[i] for r in rows})}


def test_keys_and_functional_dependencies(spark):
    rng = random.Random(1)
    for n in (6, 40):
        rows = [(i if i else None, i // 4, "xy"[i // 4 % 2], rng.randint(0, 3)) for i in range(n)]
        df, names = frame(spark, rows), ["a", "b", "c", "d"]
        keys = {k.columns for k in D.keys(df, most=3)}
        assert keys == plain_keys(rows, names, 3)
        got = {(f.columns[0], f.determines) for f in D.functional(df, most=1, known=[D.Key("", k) for k in keys])}
        assert got == plain_functional(rows, names, keys)
    empty = frame(spark, [])
    assert D.keys(empty) == [] and D.functional(empty) == []


def test_inclusions_lose_nothing(spark):
    one = spark.createDataFrame([(i, f"k{i}") for i in range(3000)], "id long, name string")
    two = spark.createDataFrame([(i % 500, i % 500 + 2800, None, f"k{i}") for i in range(1000)], "ref int, off int, none int, name string")
    got = {x[:4]: x.coverage for x in D.inclusions({"one": one, "two": two}, k=64)}
    assert got[("two", "ref", "one", "id")] == 500 / 3000 and ("two", "off", "one", "id") not in got and ("two", "none", "one", "id") not in got
    assert ("two", "name", "one", "name") in got and ("one", "name", "two", "name") not in got


def test_a_sketch_rules_out_only_what_is_not_there():
    rng = random.Random(2)
    for _ in range(300):
        whole = sorted(rng.sample(range(10_000), rng.randint(1, 200)))
        part = sorted(rng.sample(whole, rng.randint(1, len(whole))))
        k = rng.choice((5, 50, 500))
        assert not D.ruled_out(part[:k], whole[:k], k)
    assert D.ruled_out([3], [1, 2], 5) and D.ruled_out([3], [1, 7], 2) and not D.ruled_out([9], [1, 7], 2)


def test_an_ontology_from_tables(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("region", "nation", "customer", "supplier")}
    spec = D.ontology_of(tables)
    keys = {e["name"]: e["primary_key"] for e in spec["entities"]}
    assert keys == {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"]}
    links = {(r["source"], r["join_columns"]["source_col"]): (r["target"], r["join_columns"]["target_col"]) for r in spec["relationships"]}
    assert links["nation", "n_regionkey"] == ("region", "r_regionkey") and links["customer", "c_nationkey"] == ("nation", "n_nationkey")
    own = {"entities": spec["entities"], "relationships": [r for r in spec["relationships"] if r["source"] == "customer"]}
    assert ontology.normalise(own).entities[2].keys == ["c_custkey"]
