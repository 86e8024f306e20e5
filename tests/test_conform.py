from weftline.operators.conform import conformance

SPEC = {
    "entities": {
        "Person": {"key": "pid", "attributes": [{"name": "age", "type": "integer"}, {"name": "Name"}, {"name": "nowhere", "type": "date"}]},
        "Place": {"primary_key": ["land", "town"], "attributes": [{"name": "since", "type": "date"}]},
        "Ghost": {"key": "ghost_id"}},
    "relationships": [{"predicate": "lives_in", "source": "Person", "target": "Place"}, {"predicate": "haunts", "source": "Ghost", "target": "Place"}]}
SHAPE = "PID string, age string, name string, land string, town string, since string, `odd.name` int"


def found(df, **other):
    return {(r.subject, r.issue, r.detail): r.n for r in conformance(df, SPEC, **other).collect()}


def test_each_fault(spark):
    rows = [
        ("1", "30", "ann", "a", "x", "2020-01-01", 1), ("1", "30", "ann", "a", "x", "2020-01-01", 1),  # a row twice is no fault
        ("1", "31", None, "a", "y", "then", 2), ("2", "old", "bob", "a", "x", "2021-01-01", 3),
        ("3", None, " ", None, "x", None, 4), (None, "5", "eve", "b", "z", None, None), (" ", None, None, "b", "z", None, None)]
    df = spark.createDataFrame(rows, SHAPE)
    people = spark.createDataFrame([(1,), (3,), (9,), (None,)], "id int")
    assert found(df, tables={"Person": (people, "id"), "Place": (people, "id"), "Other": (people, "id")}) == {
        ("Person", "key missing", "PID"): 2, ("Place", "key missing", "land,town"): 1,
        ("Person", "not of its type", "age"): 1, ("Place", "not of its type", "since"): 1,
        ("Person", "values differ", "age"): 1, ("Place", "values differ", "since"): 1,
        ("lives_in", "one end missing", "land,town"): 1, ("lives_in", "one end missing", "PID"): 2,
        ("Person", "not in its table", "PID"): 1}


def test_nothing_to_say(spark):
    assert found(spark.createDataFrame([], SHAPE)) == {}
    assert found(spark.createDataFrame([(1,)], "x int")) == {}
    assert conformance(spark.createDataFrame([(1,)], "x int"), {}).columns == ["subject", "issue", "detail", "n"]
    assert found(spark.createDataFrame([("1", "30", "ann", "a", "x", "2020-01-01", 1)], SHAPE)) == {}


def test_one_pass_and_no_cross_join(spark):
    df = spark.createDataFrame([("1", "30", "ann", "a", "x", "2020-01-01", 1)], SHAPE)
    plan = conformance(df, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
