import pytest

from weftline.operators import graph
from weftline.plans import ontology as O
from weftline.plans.mapping import Attribute, Entity, MappingSpec, label_order

SPEC = MappingSpec.of({
    "entities": {
        "Person": {"key": {"prefix": "p:", "column": "name", "transform": "slug"}, "attributes": [{"name": "full_name", "column": "name"}, {"name": "age", "column": "age", "type": "integer"}]},
        "City": {"key": {"template": "c:{city}|{zip}", "transforms": {"city": "lower"}}, "attributes": ["city"]},
    },
    "edges": [
        {"relation": "in", "source": {"entity": "Person"}, "target": {"entity": "City"}},
        {"predicate": "knows", "source": {"entity": "Person"}, "target": {"entity": "Person", "by": {"prefix": "p:", "column": "friend", "transform": "slug"}}},
        {"source": {"entity": "City"}, "target": {"entity": "Person"}},
    ],
})


@pytest.fixture
def people(spark):
    return spark.createDataFrame([
        (1, "Ada L", "", "Paris", "1", "Bob"), (2, "ada l", "36", "PARIS", "1", None), (3, "Bob", "5", "", "", " "), (4, None, "9", "Rome", "2", "Ada L"), (5, "  ", "9", None, None, "x"),
    ], "row_no int, name string, age string, city string, zip string, friend string")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_nodes_and_edges(people):
    assert rows(graph.edges(people, SPEC)) == {("p:ada-l", "in", "c:paris|1"), ("p:ada-l", "knows", "p:bob"), ("p:bob", "in", "c:|")}
    assert {n for (n,) in rows(graph.nodes(people, SPEC))} == {"p:ada-l", "p:bob", "c:paris|1", "c:|", "c:rome|2"}


def test_edges_end_in_nodes(people):
    ids = {n for (n,) in rows(graph.nodes(people, SPEC))}
    assert all(s in ids and d in ids for s, _, d in rows(graph.edges(people, SPEC)))
    again = graph.edges(people.orderBy("zip").repartition(3), SPEC)
    assert rows(again) == rows(graph.edges(people, SPEC))


def test_labelled_nodes(people):
    got = {r.node_id: (r.type, r.label, r.properties) for r in graph.labelled_nodes(people, SPEC, "row_no").collect()}
    assert got["p:ada-l"] == ("person", "Ada L", {"full_name": "Ada L", "age": "36"})
    assert got["p:bob"] == ("person", "Bob", {"full_name": "Bob", "age": "5"})
    assert got["c:paris|1"] == ("city", "Paris", {"city": "Paris"})
    assert got["c:|"] == ("city", "c:|", {})


def test_empty_specs_and_tables(spark, people):
    none = MappingSpec.of({})
    assert graph.nodes(people, none).collect() == graph.edges(people, none).collect() == graph.labelled_nodes(people, none, "row_no").collect() == []
    assert graph.nodes(people.limit(0), SPEC).collect() == []
    assert MappingSpec.of(SPEC.to_dict()).to_dict() == SPEC.to_dict()


def test_label_order():
    def order(*attributes):
        return [a.name for a in label_order(Entity("E", None, [Attribute(n, n, t, d) for n, t, d in attributes]))]

    assert order(("x_id", "string", ""), ("note", "string", ""), ("job_title", "string", ""))[0] == "job_title"
    assert order(("x_id", "string", ""), ("code", "string", "display text"), ("note", "string", ""))[0] == "code"
    assert order(("n", "integer", ""), ("birth_date", "string", ""), ("x_id", "string", "")) == ["birth_date", "n"]
    assert order(("x_id", "string", "")) == ["x_id"]


ONT = {
    "entities": [
        {"name": "Order", "primary_key": ["Order ID"], "attributes": [{"name": "orderDate"}, {"name": "total_amount"}]},
        {"name": "Customer", "key": "Customer_ID", "attributes": [{"name": "customer_id"}, {"name": "customerName"}]},
        {"name": "Line", "primary_key": ["Order ID", "line"]},
        {"name": "Ghost"},
    ],
    "relationships": [
        {"predicate": "by", "source": "Order", "target": "Customer"},
        {"predicate": "ships_to", "source": "Order", "target": "Customer", "join_columns": {"source_col": "ship_customer"}},
        "Order -> Region",
    ],
}
HEADERS = [" Order ID ", "customer_id", "Customer Name", "order_date", "Total Amount", "ship_customer", "line", "us_region"]


def test_compile_all():
    m, warnings = O.compile_mapping(ONT, HEADERS)
    e = m.entities
    assert (e["Order"].key.column, e["Order"].key.prefix) == (" Order ID ", "order:")
    assert e["Customer"].key.column == "customer_id"
    assert e["Line"].key.template == "line:{ Order ID }|{line}"
    assert [a.column for a in e["Order"].attributes] == ["order_date", "Total Amount"] and e["Customer"].attributes[1].column == "Customer Name"
    by, ships, region = m.edges
    assert (by.target_by, ships.target_by.column, ships.target_by.prefix) == (None, "ship_customer", "customer:")
    assert e["Ghost"].key.column == " Order ID " and any("Ghost" in w for w in warnings)
    raw, _ = O.compile_all(ONT, HEADERS, prefixed=False)
    assert raw.entities["Customer"].key.prefix == ""


def test_compile_star():
    m, warnings = O.compile_star(ONT, ["Order ID", "segment", "us_region"])
    assert (m.entities["Order"].key.column, m.entities["Customer"].key.column, m.entities["Region"].key.column) == ("Order ID", "segment", "us_region")
    assert {x.target for x in m.edges} == {"Customer", "Region"} and not warnings
    phrase = {"entities": [{"name": "Sale", "key": "Composite key using Date and Product"}], "relationships": []}
    key = O.compile_star(phrase, ["Date", "Product", "Units"])[0].entities["Sale"].key
    assert key.template == "sale:{Date}|{Product}" and key.transforms == {"Date": "trim", "Product": "slug"}
    assert O.compile_star({}, ["a"])[1] and O.compile_star({"entities": [{"name": "A"}]}, ["x_id"])[0].entities["A"].key.column == "x_id"


def test_normalise_and_validate():
    o = O.normalise({"entities": {"A": {"attributes": [{"name": "a_id"}]}, "B": None}, "relationships": [{"source": {"name": "A"}, "target": {"entity": "B"}}, "nonsense", "A | B"]})
    assert [(e.name, e.keys) for e in o.entities] == [("A", ["a_id"]), ("B", [])]
    assert [(r.source, r.target, r.predicate) for r in o.relationships] == [("A", "B", "related_to"), ("A", "B", "related_to")]
    assert O.validate(ONT, HEADERS) == [] and O.validate({}, []) and len(O.validate(ONT, ["x"])) >= 3
