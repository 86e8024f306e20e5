"""Merged profiles against the whole and against exact counts."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftline.operators import profile, profile_sketches as P
from weftline.operators.iterate import shared_folder


def frame(spark):
    i = F.col("id")
    return spark.range(9000).select(
        i.alias("n"), (i % 7).alias("few"), F.when(i % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("v"), i % 500)).alias("gaps"),
        F.lit(None).cast("string").alias("none"), F.when(i % 2 == 0, "1.5").otherwise("2_0").alias("mixed"), F.lit("2020-01-01").alias("day"), F.lit("TRUE").alias("flag"))


def test_parts_merged_equal_the_whole(spark):
    df = frame(spark)
    whole = {r.name: r for r in P.profile_of(P.column_states(df)).collect()}
    parts = [P.column_states(df.where(F.col("n") % 5 == k)) for k in range(5)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    got = {r.name: r for r in P.profile_of(P.merged(states)).collect()}
    exact = {r.name: r for r in profile.column_profile(df).collect()}
    assert set(got) == set(exact) == set(whole)
    for name, e in exact.items():
        g, w = got[name], whole[name]
        for c in ("non_null", "nulls", "inferred_type"):
            assert g[c] == e[c] == w[c], (name, c)
        assert (g.lowest, g.highest) == (w.lowest, w.highest)
        assert abs(g.distinct - e.distinct) <= 0.05 * e.distinct
    assert [(x.value, x["count"]) for x in got["few"].frequent] == [("0", 1286), ("1", 1286), ("2", 1286)]
    assert got["none"].quantiles is None and got["none"].frequent == [] and got["gaps"].quantiles is None
    q = got["n"].quantiles
    assert q[0] == 0 and q[4] == 8999 and all(abs(x - y) < 0.03 * 9000 for x, y in zip(q, (0, 2250, 4500, 6750, 8999)))
    assert got["mixed"].quantiles[0] == 1.5 and got["mixed"].quantiles[4] == 20.0


def test_order_of_merging(spark):
    df = frame(spark)
    a, b, c = (P.column_states(df.where(F.col("n") % 3 == k)) for k in range(3))
    left = P.merged(P.merged(a.unionByName(b)).unionByName(c))
    right = P.merged(a.unionByName(P.merged(b.unionByName(c))))
    cols = ["name", "non_null", "nulls", "distinct", "inferred_type", "lowest", "highest", "frequent"]
    assert sorted(P.profile_of(left).select(cols).collect()) == sorted(P.profile_of(right).select(cols).collect())


def test_stored_states(spark):
    """A part that comes twice counts once; data sets stay apart; a part may lack or have columns."""
    t = P.ProfileTable(spark, f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}")
    with pytest.raises(LookupError):
        t.states()
    df = frame(spark)
    t.add("one", "a", df.where("n < 4000"))
    t.add("one", "b", df.where("n >= 4000").withColumn("new", F.lit("x")))
    t.add("one", "a", df.where("n < 4000"))
    t.add("two", "a", df.where("n < 10").select("n"))
    t.add("two", "empty", df.where("n < 0").select("n"))
    got = {(r.dataset, r.name): r for r in t.profile().collect()}
    assert got["one", "n"].non_null == 9000 and got["one", "new"].non_null == 5000 and got["two", "n"].non_null == 10
    assert got["two", "n"].distinct == 10 and got["two", "n"].inferred_type == "integer"
    assert {r.name for r in t.profile("two").collect()} == {"n"}


def test_only_states_are_shuffled(spark):
    """Tasks combine their rows before the exchange, and no value is a key of one."""
    plan = P.column_states(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(name") == 1 and plan.count("partial_hll_sketch_agg") >= 1
