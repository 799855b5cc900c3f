"""The container: building, mutation, groups, schema, plugins, connectors, snapshots, overview."""

import datetime as dt

import pandas as pd
import pytest

from loomgraph import ConnectedGraph, EdgeDirection, ExportConnector, IngestConnector, Plugin, PropertyGraph
from loomgraph import schema as S
from loomgraph.errors import SchemaError
from loomgraph.plugins import HOOKS


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def graph(spark):
    g = PropertyGraph.from_tuples(spark, [("a", {"x": 1, "s": "u"}), ("b", {"x": 2}), ("c", {}), ("d", {"x": None})], [("a", "b", {"w": 1.5}), ("b", "a", {}), ("a", "a", {"w": 2.0}), ("a", "b", {})])
    g.add_group("g", ["a", "b"], [0, 2])
    return g


def test_structure(graph):
    assert graph.node_count() == 4 and graph.edge_count() == 4 and graph.group_count() == 1
    assert ids(graph.outgoing_edges("a")) == [0, 2, 3] and ids(graph.incoming_edges(["a"])) == [1, 2]
    assert ids(graph.edges_connecting("a", "b")) == [0, 3] and ids(graph.edges_connecting("a", "b", undirected=True)) == [0, 1, 3]
    assert sorted(r[1] for r in graph.neighbors("a").collect()) == ["a", "b", "b"]
    assert sorted(r[1] for r in graph.neighbors("a", EdgeDirection.BOTH).collect()) == ["a", "b"]
    assert graph.edge_endpoints(1).collect()[0][1:] == ("b", "a")
    assert graph.contains_node("a") and not graph.contains_node("z") and graph.contains_edge(3) and not graph.contains_edge(9)


def test_groups(graph):
    assert graph.group("g") == {"nodes": ["a", "b"], "edges": [0, 2]} and graph.groups_of_node("a") == ["g"] and graph.groups_of_edge(1) == []
    assert ids(graph.ungrouped_nodes()) == ["c", "d"] and ids(graph.ungrouped_edges()) == [1, 3]
    graph.add_nodes_to_group("h", ["c", "a"])
    assert graph.groups() == ["g", "h"] and graph.groups_of_node("a") == ["g", "h"]
    with pytest.raises(AssertionError):
        graph.add_nodes_to_group("h", "c")
    graph.add_nodes_to_group("h", lambda n: (n.attribute("x").equal_to(2), n.index())[1])
    assert ids(graph.nodes_in_group("h")) == ["a", "b", "c"]
    graph.remove_nodes_from_group("h", "a")
    graph.remove_groups("g")
    assert graph.groups_of_node("a") == [] and graph.groups() == ["h"]
    with pytest.raises(IndexError):
        graph.nodes_in_group("g")
    with pytest.raises(AssertionError):
        graph.add_group("h")


def test_removal_cascades(graph):
    graph.remove_edges(3)
    assert graph.edge_count() == 3
    graph.remove_nodes("b")
    assert ids(graph.edge_indices()) == [2] and graph.node_count() == 3
    with pytest.raises(IndexError):
        graph.remove_nodes("b")
    graph.remove_nodes(lambda n: (n.has_attribute("s"), n.index())[1])
    assert graph.edge_count() == 0 and ids(graph.node_indices()) == ["c", "d"]
    assert graph.add_edges([("c", "d", {})]) == [4]  # ids are not used again
    graph.clear()
    assert graph.node_count() == 0 and graph.get_schema().groups


def test_checks(graph):
    with pytest.raises(AssertionError):
        graph.add_nodes(("a", {}))
    with pytest.raises(AssertionError):
        graph.add_nodes([("y", {}), ("y", {})])
    with pytest.raises(IndexError):
        graph.add_edges(("a", "nowhere", {}))


def test_frames(spark):
    users = pd.DataFrame({"index": ["u1", "u2"], "age": [30, 40]})
    items = spark.createDataFrame([("i1", "pen"), ("i2", "cup")], "index string, name string")
    bought = pd.DataFrame({"source": ["u1", "u2", "u2"], "target": ["i1", "i1", "i2"], "cost": [1.5, 2.5, 3.5]})
    g = PropertyGraph.builder(spark).add_nodes((users, "index"), group="user").add_nodes((items, "index"), group="item").add_edges((bought, "source", "target"), group="bought").build()

    def cheap(edge):
        edge.attribute("cost").less_than(3)
        edge.target_node().attribute("name").equal_to("pen")
        return edge.index()

    assert sorted(g.query_edges(cheap)) == [0, 1]
    table = g.to_pandas()["user"]["nodes"].sort_values("node_index")
    assert list(table.columns) == ["node_index", "age"] and list(table["age"]) == [30, 40]
    assert g.node["u1"] == {"age": 30} and g.query_nodes(lambda n: n.attributes().count()) == {"u1": 1, "u2": 1, "i1": 1, "i2": 1}


def test_indexers(graph):
    assert graph.node["a"] == {"x": 1, "s": "u"} and graph.node["a", "x"] == 1 and graph.node[["a", "b"], "x"] == {"a": 1, "b": 2}
    with pytest.raises(KeyError):
        graph.node["c", "x"]
    with pytest.raises(IndexError):
        graph.node["zz"]
    graph.node["c", "x"] = 5
    graph.node["b", "new"] = "text"
    assert graph.node["c"] == {"x": 5} and graph.node["b"] == {"x": 2, "new": "text"}
    graph.node[:, "flag"] = True
    assert graph.node[:, "flag"] == dict.fromkeys("abcd", True)
    del graph.node["a", "s"]
    assert "s" not in graph.node["a"]
    with pytest.raises(KeyError):
        del graph.node["a", "s"]
    graph.node["a"] = {"y": 1.5}
    assert graph.node["a"] == {"y": 1.5}
    graph.edge[0, "w"] = "now text"
    assert graph.edge[0, "w"] == "now text" and graph.edge[2, "w"] == 2.0


def test_schema_is_inferred(graph):
    own = graph.get_schema().ungrouped.nodes
    assert own["x"].data_type == S.Option(S.Int) and own["x"].attribute_type == S.AttributeType.CONTINUOUS and str(own["s"].data_type) == "Option(String)"
    grouped = graph.get_schema().group("g").nodes
    assert grouped["x"].data_type == S.Int


def test_schema_is_enforced(spark):
    wanted = S.Schema({"p": S.GroupSchema({"age": S.AttributeDataType(S.Int), "note": S.AttributeDataType(S.Option(S.String))})}, provided=True)
    g = PropertyGraph.with_schema(spark, wanted)
    g.add_nodes([("a", {"age": 3}), ("b", {"age": 4, "note": "x"})], group="p")
    for bad in ({"age": "old"}, {}, {"age": 1, "size": 2}, {"age": None}):
        with pytest.raises(SchemaError):
            g.add_nodes(("c", bad), group="p")
    g.unfreeze_schema()
    g.add_nodes(("c", {"age": "old"}), group="p")
    assert g.get_schema().group("p").nodes["age"].data_type == S.Union(S.Int, S.String)
    with pytest.raises(SchemaError):
        g.set_schema(wanted)
    assert g.node_count() == 3


def test_types():
    assert S.Union(S.Int, S.Float) == S.Union(S.Float, S.Int) and S.Int.merge(S.Null).optional
    assert S.Any.accepts(S.String) and not S.Int.accepts(S.Option(S.Int)) and S.Option(S.Int).accepts(S.Null)
    assert S.AttributeType.infer(S.Bool) == S.AttributeType.CATEGORICAL and S.AttributeType.infer(S.DateTime) == S.AttributeType.TEMPORAL
    with pytest.raises(SchemaError):
        S.AttributeDataType(S.String, S.AttributeType.CONTINUOUS)


class Recorder(Plugin):
    def __init__(self):
        self.calls = []

    def initialize(self, graph):
        self.calls.append("initialize")

    def finalize(self, graph):
        self.calls.append("finalize")


for _hook in HOOKS:
    setattr(Recorder, f"pre_{_hook}", lambda self, graph, context, _h=_hook: (self.calls.append(f"pre_{_h}"), context)[1])
    setattr(Recorder, f"post_{_hook}", lambda self, graph, context, _h=_hook: self.calls.append(f"post_{_h}"))


def test_plugins(spark):
    p = Recorder()
    g = PropertyGraph.with_plugins(spark, [p])
    g.add_nodes(("a", {}))
    g.add_nodes([("b", {})], group="g")
    g.add_edges(("a", "b", {}), groups=["e"])
    g.add_nodes((pd.DataFrame({"id": ["c"]}), "id"))
    g.add_group("h", ["a"])
    g.add_nodes_to_group("h", "b")
    g.remove_nodes_from_group("h", ["a", "b"])
    g.remove_groups("h")
    g.freeze_schema()
    g.unfreeze_schema()
    g.remove_edges(0)
    g.remove_nodes("a")
    g.add_nodes(("z", {}), bypass_plugins=True)
    g.clear()
    g.remove_plugin(p)
    names = ["add_node", "add_nodes_with_group", "add_edge_with_groups", "add_nodes_dataframes", "add_group", "add_node_to_group", "remove_nodes_from_groups", "remove_group", "freeze_schema", "unfreeze_schema", "remove_edge", "remove_node", "clear"]
    assert p.calls == ["initialize", *[f"{when}_{n}" for n in names for when in ("pre", "post")], "finalize"]


def test_plugin_changes_input(spark):
    class Renamer(Plugin):
        def pre_add_node(self, graph, context):
            return context | {"nodes": [(i.upper(), a) for i, a in context["nodes"]]}

    g = PropertyGraph.with_plugins(spark, [Renamer()])
    g.add_nodes(("a", {}))
    assert ids(g.node_indices()) == ["A"]


def test_connectors(spark):
    class Both(IngestConnector, ExportConnector):
        def ingest(self, graph, data):
            graph.add_nodes([(d["id"], {"value": d["value"]}) for d in data])

        def export(self, graph):
            return ids(graph.node_indices())

    c = ConnectedGraph(spark, Both(), [{"id": "a", "value": "1"}])
    c.ingest([{"id": "b", "value": "2"}])
    assert c.export() == ["a", "b"] and c.node_count() == 2 and isinstance(c.disconnect(), PropertyGraph)
    with pytest.raises(TypeError):
        ConnectedGraph(spark, IngestConnector()).export()


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_snapshot(graph, spark, tmp_path, form):
    graph.save(str(tmp_path / "deep" / form), form)
    again = PropertyGraph.load(spark, str(tmp_path / "deep" / form))
    assert again.groups() == ["g"] and again.get_schema() == graph.get_schema()
    assert again.node[:] == graph.node[:] and again.edge[:] == graph.edge[:] and again.add_edges([("a", "c", {})]) == [4]


def test_overview(graph):
    graph.add_nodes([("e", {"on": True, "at": dt.datetime(2024, 1, 2)}), ("f", {"on": False, "at": dt.datetime(2023, 1, 2)})], group="k")
    o = graph.overview()
    assert o.groups["g"].nodes.count == 2 and o.groups["g"].nodes.attributes["x"].data == {"min": 1, "max": 2, "mean": 1.5}
    assert o.groups["k"].nodes.attributes["on"].data == {"distinct_values": [False, True]} and o.groups["k"].nodes.attributes["at"].data["min"] == dt.datetime(2023, 1, 2)
    assert o.ungrouped.nodes.count == 2 and "[k]" in str(o) and graph.group_overview("g").edges.count == 2


def test_clone_is_independent(graph):
    other = graph.clone()
    other.remove_nodes("a")
    assert graph.node_count() == 4 and other.node_count() == 3


def test_values(spark):
    day = dt.timedelta(days=1)
    g = PropertyGraph.from_tuples(spark, [("a", {"t": dt.datetime(2024, 1, 3, 12), "d": day, "f": 2.5, "n": -7}), ("b", {"t": dt.datetime(2024, 1, 1), "d": 3 * day, "f": float("nan"), "n": 2})])

    def value(name, *steps):
        def query(node):
            v = node.attribute(name)
            for s, *a in steps:
                getattr(v, s)(*a)
            return v

        return g.query_nodes(query)

    assert value("t", ("add", day))["a"] == dt.datetime(2024, 1, 4, 12) and value("t", ("subtract", dt.datetime(2024, 1, 1)))["a"] == 2.5 * day
    assert value("d", ("multiply", 2))["b"] == 6 * day and value("d", ("subtract", day))["b"] == 2 * day
    assert value("f", ("round",))["a"] == 3.0 and value("f", ("equal_to", float("nan"))).keys() == {"b"} and value("f", ("greater_than", 0)).keys() == {"a"}
    assert value("n", ("modulo", 4)) == {"a": -3, "b": 2} and value("n", ("absolute",))["a"] == 7 and value("n", ("divide", 0))["a"] == float("-inf")
    assert g.query_nodes(lambda n: n.attribute("t").median()) == dt.datetime(2024, 1, 2, 6) and g.query_nodes(lambda n: n.attribute("d").mean()) == 2 * day
    assert g.query_nodes(lambda n: n.attribute("d").sum()) == 4 * day
    assert value("n", ("slice", 0, 1)) == {"a": "-", "b": "2"}


def test_stream(spark, tmp_path):
    from loomgraph.streaming import ingest_nodes

    source = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, x bigint").write.json(str(source))
    g = PropertyGraph(spark)
    stream = spark.readStream.schema("id string, x bigint").json(str(source))
    q = ingest_nodes(g, stream, "id", str(tmp_path / "store"), str(tmp_path / "check"), group="s", availableNow=True)
    q.awaitTermination(60)
    assert ids(g.nodes_in_group("s")) == ["a", "b"]


@pytest.mark.parametrize("order_by", [None, ["k"]])
def test_numbered_edges(spark, order_by):
    """Ids from a frame are dense, unique and the same in every query, however the
    columns used change the plan."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        wide = spark.range(60_000).selectExpr("concat('n', id % 7) as s", "concat('n', id % 11) as t", "id % 50 as k", "id as n", *[f"repeat(cast(id as string), {k}) as w{k}" for k in range(1, 9)])
        g = PropertyGraph.from_dataframes(spark, (spark.range(11).selectExpr("concat('n', id) as i"), "i"))
        g.add_edges([("n0", "n1", {"n": -1})])
        g.add_edges((wide, "s", "t"), order_by=order_by)
        g.add_edges((wide.limit(10), "s", "t"))
        lines = g.edge_indices().collect()
        assert sorted(r[0] for r in lines) == list(range(60_011))
        first = {r["__id"]: r["a:n"] for r in g.edges.select("__id", "`a:n`").collect()}
        second = {r["__id"]: r["a:n"] for r in g.edges.select("__id", "`a:n`", "__src", "`a:w8`").where("length(`a:w8`) > 0 or __id = 0").collect()}
        assert {k: v for k, v in first.items() if k in second} == second and len(second) == 60_011
        if order_by:
            assert [first[i] % 50 for i in range(1, 60_001)] == sorted(first[i] % 50 for i in range(1, 60_001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_removed_attributes(graph):
    assert graph.remove_edges([0, 1]) == {0: {"w": 1.5}, 1: {}} and graph.remove_edges(2) == {"w": 2.0}
    assert graph.remove_nodes(["a", "d"]) == {"a": {"x": 1, "s": "u"}, "d": {"x": None}}
    gone = graph.remove_nodes(lambda n: (n.has_attribute("x"), n.index())[1])
    assert [(r["id"], r["x"]) for r in gone.collect()] == [("b", 2)] and graph.node_count() == 1


def test_schema_by_inference_and_unchecked(graph):
    found = S.Schema.infer(graph)
    assert set(found.groups["g"].nodes) == {"x", "s"} and found.ungrouped.nodes["x"].data_type.optional and not found.provided
    other = S.Schema()
    other.set_attribute("node", "q", S.AttributeDataType(S.DataType(frozenset({S.Kind.INT}))))
    other.freeze()
    graph.set_schema_unchecked(other)
    assert graph.get_schema().provided and list(graph.get_schema().ungrouped.nodes) == ["q"]
