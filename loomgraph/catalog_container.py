"""Registered queries for the container: construction, reading, mutation, groups,
schema, plugins, connectors, indexers, overviews and snapshots.

The graph is small and its own: nations, regions and customers, ``lies`` from
nations to regions (ids are nation keys) and ``lives`` from customers to nations
(ids are 1000 and the customer key, with the customer's balance).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .graph import PropertyGraph
from .operators.operands import EdgeDirection
from .plugins import HOOKS, Plugin
from .sources.connectors import ExportConnector, IngestConnector
from .sources.scratch import scratch_path


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda letter, c: F.concat(F.lit(f"{letter}:"), c)
    nation, region, customer = read("nation"), read("region"), read("customer")
    return {
        "nation": nation.select(key("n", "n_nationkey").alias("id"), "n_name", "n_regionkey"),
        "region": region.select(key("r", "r_regionkey").alias("id"), "r_name"),
        "customer": customer.select(key("c", "c_custkey").alias("id"), "c_acctbal", "c_mktsegment"),
        "lies": nation.select(F.col("n_nationkey").cast("bigint").alias("edge"), key("n", "n_nationkey").alias("from"), key("r", "n_regionkey").alias("to")),
        "lives": customer.select((F.col("c_custkey") + 1000).alias("edge"), key("c", "c_custkey").alias("from"), key("n", "c_nationkey").alias("to"), F.col("c_acctbal").alias("balance")),
    }


def _geo(spark: SparkSession, sf_dir: str, plugins: list[Plugin] | None = None) -> PropertyGraph:
    t = _tables(spark, sf_dir)
    g = PropertyGraph(spark, plugins=plugins)
    for group in ("nation", "region", "customer"):
        g.add_nodes((t[group], "id"), group=group)
    g.add_edges((t["lies"], "from", "to"), group="lies", edge_id="edge")
    g.add_edges((t["lives"], "from", "to"), group="lives", edge_id="edge")
    return g


def _rows(spark: SparkSession, rows: list[tuple], schema: str = "what string, n bigint") -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _on(then: Callable[[PropertyGraph], object]):
    """A frame of the graph, or (what, number) rows that calls have given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = then(_geo(spark, sf_dir))
        return out if isinstance(out, DataFrame) else _rows(spark, [(k, int(v)) for k, v in out.items()])

    return run


def _after(g: PropertyGraph, *calls: Callable[[PropertyGraph], object]) -> PropertyGraph:
    for call in calls:
        call(g)
    return g


def _counted(*calls: Callable[[PropertyGraph], object], of: Callable[[PropertyGraph], dict] | None = None):
    """Nodes, edges and groups after the calls, or what ``of`` counts."""
    return _on(lambda g: (of or (lambda x: {"nodes": x.node_count(), "edges": x.edge_count(), "groups": x.group_count()}))(_after(g, *calls)))


def _fails(call: Callable[[PropertyGraph], object], error: type[Exception]) -> Callable[[PropertyGraph], dict]:
    def run(g: PropertyGraph) -> dict:
        try:
            call(g)
        except error:
            return {"raised": 1}
        return {"raised": 0}

    return run


def _query(name: str, test: str, value):
    """Ids of nodes with a value, as a query function."""

    def run(node):
        getattr(node.attribute(name), test)(value)
        return node.index()

    return run


# --- construction


def _from_dataframes(spark, sf_dir):
    t = _tables(spark, sf_dir)
    g = PropertyGraph.from_dataframes(spark, [(t["nation"], "id"), (t["region"], "id")], (t["lies"].drop("edge"), "from", "to"))
    return g.edge_endpoints().select("source", "target")


def _from_tuples(spark, sf_dir):
    t = _tables(spark, sf_dir)
    nodes = [(r["id"], {"name": r[1]}) for k in ("nation", "region") for r in t[k].collect()]
    g = PropertyGraph.from_tuples(spark, nodes, [(r["from"], r["to"], {"k": r["edge"]}) for r in t["lies"].collect()])
    return g.query_nodes_df(lambda n: n.attribute("name"))


def _from_pandas(spark, sf_dir):
    t = _tables(spark, sf_dir)
    g = PropertyGraph.from_pandas(spark, [(t["nation"].toPandas(), "id"), (t["region"].toPandas(), "id")], (t["lies"].drop("edge").toPandas(), "from", "to"))
    return g.neighbors([f"r:{k}" for k in range(5)], EdgeDirection.INCOMING)


class _Arrow:
    """Stands in for a Polars frame: anything that gives an Arrow table."""

    def __init__(self, df: DataFrame):
        self.df = df

    def to_arrow(self):
        return self.df.toArrow()


def _from_arrow(spark, sf_dir):
    t = _tables(spark, sf_dir)
    g = PropertyGraph(spark)
    g.add_nodes([(_Arrow(t["nation"]), "id"), (_Arrow(t["region"]), "id")])
    g.add_edges((_Arrow(t["lies"]), "from", "to"), edge_id="edge")
    return g.edge_endpoints()


def _built(spark, sf_dir):
    t = _tables(spark, sf_dir)
    seen: list[str] = []
    builder = PropertyGraph.builder(spark).with_plugins([_recorder(seen)]).add_plugin(Plugin()).with_schema(S.Schema())
    g = builder.add_nodes((t["nation"], "id"), group="nation").add_nodes((t["region"], "id")).add_edges((t["lies"].drop("edge"), "from", "to"), group="lies").add_group("first", ["n:0", "r:0"], [0, 1]).build()
    return _rows(spark, [("nodes", g.node_count()), ("edges", g.edge_count()), ("groups", g.group_count()), ("plugins", len(g.plugins)), ("first", len(g.group("first")["nodes"]) + len(g.group("first")["edges"])), ("hooks", len(seen))])


def _numbered(spark, sf_dir):
    """Line items as edges without ids: numbers are dense and unique."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("o", F.concat(F.lit("o:"), "l_orderkey")).withColumn("p", F.concat(F.lit("p:"), "l_partkey"))
    g = PropertyGraph(spark)
    g.add_edges((lines, "o", "p"), order_by=["l_orderkey", "l_linenumber"])
    g.add_edges((lines.where("l_linenumber = 1"), "o", "p"))
    return g.edge_indices().agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def _numbered_in_order(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = PropertyGraph(spark)
    first = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).withColumn("o", F.concat(F.lit("o:"), "l_orderkey"))
    g.add_edges((first, "o", "o"), order_by=["l_orderkey"])
    return g.query_edges_df(lambda e: e.attribute("l_orderkey"))


# --- plugins


def _recorder(seen: list[str]) -> Plugin:
    """A plugin that notes every hook it gets."""
    note = lambda name: (lambda self, graph, context=None: (seen.append(name), context)[1])
    hooks = {f"{when}_{h}": note(f"{when}_{h}") for h in HOOKS for when in ("pre", "post")}
    return type("Recorder", (Plugin,), hooks | {"initialize": lambda self, graph: seen.append("initialize"), "finalize": lambda self, graph: seen.append("finalize")})()


def _hooks(spark, sf_dir):
    """Every mutation once; how often each hook was called."""
    seen: list[str] = []
    plugin = _recorder(seen)
    g = PropertyGraph.with_plugins(spark, [plugin])
    n = spark.createDataFrame([("d1",)], "id string")
    frames = [spark.createDataFrame([(f"d{k}",)], "id string") for k in (2, 3, 4)]
    e = spark.createDataFrame([("a", "b")], "s string, t string")
    g.add_nodes(("a", {}))
    g.add_nodes(("b", {}), group="g")
    g.add_nodes(("c", {}), groups=["g", "h"])
    g.add_nodes([("x", {})])
    g.add_nodes([("y", {})], group="g")
    g.add_nodes([("z", {})], groups=["g", "h"])
    g.add_nodes((n, "id"))
    g.add_nodes((frames[0], "id"), group="g")
    g.add_nodes((frames[1], "id"), groups=["g", "h"])
    g.add_edges(("a", "b", {}))
    g.add_edges(("a", "b", {}), group="g")
    g.add_edges(("a", "b", {}), groups=["g", "h"])
    g.add_edges([("a", "b", {})])
    g.add_edges([("a", "b", {})], group="g")
    g.add_edges([("a", "b", {})], groups=["g", "h"])
    g.add_edges((e, "s", "t"))
    g.add_edges((e, "s", "t"), group="g")
    g.add_edges((e, "s", "t"), groups=["g", "h"])
    g.add_group("k")
    g.add_group("l")
    g.add_nodes_to_group("k", "a")
    g.add_nodes_to_group(["k", "l"], "b")
    g.add_nodes_to_group(["k", "l"], ["c", "x"])
    g.add_edges_to_group("k", 0)
    g.add_edges_to_group(["k", "l"], 1)
    g.add_edges_to_group(["k", "l"], [2, 3])
    g.remove_nodes_from_group("k", "a")
    g.remove_nodes_from_group(["k", "l"], "b")
    g.remove_nodes_from_group(["k", "l"], ["c", "x"])
    g.remove_edges_from_group("k", 0)
    g.remove_edges_from_group(["k", "l"], 1)
    g.remove_edges_from_group(["k", "l"], [2, 3])
    g.remove_groups("k")
    g.freeze_schema()
    g.unfreeze_schema()
    g.set_schema(S.Schema())
    g.remove_edges(0)
    g.remove_nodes("a")
    g.clear()
    g.remove_plugin(plugin)
    return _rows(spark, [(h, seen.count(f"pre_{h}"), seen.count(f"post_{h}")) for h in HOOKS] + [(h, seen.count(h), 0) for h in ("initialize", "finalize")], "hook string, pre bigint, post bigint")


def _renamed(spark, sf_dir):
    """A pre hook changes what is added."""

    class Upper(Plugin):
        def pre_add_nodes(self, graph, context):
            return context | {"nodes": [(i.upper(), a) for i, a in context["nodes"]]}

    g = PropertyGraph.with_plugins(spark, [Upper()])
    g.add_nodes([(r[0], {}) for r in _tables(spark, sf_dir)["nation"].select("id").collect()])
    return g.node_indices()


# --- connectors, snapshots


class _Nations(IngestConnector, ExportConnector):
    """Takes nation rows in and gives their names back."""

    def __init__(self):
        self.calls: list[str] = []

    def initialize(self, graph):
        self.calls.append("initialize")

    def disconnect(self, graph):
        self.calls.append("disconnect")

    def ingest(self, graph, data):
        self.calls.append("ingest")
        graph.add_nodes((data, "id"), group="nation")

    def export(self, graph):
        self.calls.append("export")
        return graph.query_nodes_df(lambda n: n.attribute("n_name"))


def _connected(spark, sf_dir):
    t = _tables(spark, sf_dir)
    g = PropertyGraph.with_connector(spark, _Nations(), t["nation"])
    g.ingest(t["region"].withColumnRenamed("r_name", "n_name"))
    return g.export()


def _connector_calls(spark, sf_dir):
    c = _Nations()
    g = PropertyGraph.with_connector(spark, c)
    g.ingest(_tables(spark, sf_dir)["nation"])
    g.export()
    plain = g.disconnect()
    return _rows(spark, [(name, c.calls.count(name)) for name in ("initialize", "ingest", "export", "disconnect")] + [("nodes", plain.node_count())])


def _snapshot(format: str):
    def run(spark, sf_dir):
        path = scratch_path(spark, "snapshot")
        _geo(spark, sf_dir).save(path, format)
        return PropertyGraph.load(spark, path).query_edges_df(lambda e: (e.in_group("lives"), e.attribute("balance"))[1])

    return run


def _to_pandas(spark, sf_dir):
    out = _geo(spark, sf_dir).to_pandas()
    return spark.createDataFrame(out["nation"]["nodes"][["node_index", "n_name"]])


# --- schema


def _shown(g: PropertyGraph, schema: S.Schema) -> DataFrame:
    rows = [(group, entity, name, str(t.data_type), t.attribute_type.value) for group, s in schema.groups.items() for entity in ("node", "edge") for name, t in s.of(entity).items()]
    return _rows(g.spark, rows, "grp string, entity string, name string, type string, role string")


def _schema_calls(spark, sf_dir):
    """Types and roles after each change of a schema."""
    s, out = S.Schema(), []
    see = lambda what: out.append((what, ", ".join(f"{n} {t.data_type} {t.attribute_type.value}" for n, t in sorted(s.ungrouped.nodes.items()))))
    s.set_attribute("node", "a", S.AttributeDataType(S.Int))
    see("set")
    s.update_attribute("node", "a", S.AttributeDataType(S.Float))
    see("update")
    s.update_attribute("node", "b", S.AttributeDataType(S.Option(S.String)))
    see("add")
    s.set_attribute("node", "b", S.AttributeDataType(S.Bool, S.AttributeType.CATEGORICAL))
    see("replace")
    s.remove_attribute("node", "a")
    see("remove")
    s.update_attribute("node", "b", S.AttributeDataType(S.DateTime))
    see("merge roles")
    s.add_group("g", S.GroupSchema({"x": S.AttributeDataType(S.Any)}, {}))
    out.append(("group", str(s.group("g").nodes["x"].data_type)))
    s.remove_group("g")
    out.append(("groups", str(len(s.groups))))
    s.freeze()
    out.append(("frozen", str(s.provided)))
    s.unfreeze()
    out.append(("unfrozen", str(s.provided)))
    return _rows(spark, out, "what string, shown string")


def _refusals(spark, sf_dir):
    """Which data a provided schema refuses."""
    s = S.Schema()
    s.set_attribute("node", "a", S.AttributeDataType(S.Int))
    s.set_attribute("node", "b", S.AttributeDataType(S.Option(S.String)))
    s.set_attribute("edge", "w", S.AttributeDataType(S.Union(S.Int, S.Float)))
    s.freeze()
    out = []
    for what, nodes, edges in (
        ("fits", {"a": 1, "b": "x"}, {"w": 1.5}), ("no option", {"a": 1}, {"w": 2}), ("null option", {"a": 1, "b": None}, {"w": 2}), ("wrong type", {"a": "1"}, {"w": 2}),
        ("missing", {"b": "x"}, {"w": 2}), ("too many", {"a": 1, "c": 1}, {"w": 2}), ("wrong edge", {"a": 1}, {"w": "x"}), ("null", {"a": None}, {"w": 2}),
    ):
        g = PropertyGraph.with_schema(spark, s)
        try:
            g.add_nodes([("n", nodes)])
            g.add_edges([("n", "n", edges)])
            out.append((what, False))
        except S.SchemaError:
            out.append((what, True))
    try:
        S.AttributeDataType(S.String, S.AttributeType.CONTINUOUS)
    except S.SchemaError:
        out.append(("role", True))
    return _rows(spark, out, "what string, refused boolean")


def _provided(g: PropertyGraph) -> dict:
    """A frozen schema refuses what it does not know; unfrozen it grows."""
    g.freeze_schema()
    refused = _fails(lambda x: x.add_nodes(("q", {"odd": 1}), group="nation"), S.SchemaError)(g)["raised"]
    g.unfreeze_schema()
    g.add_nodes(("q", {"odd": 1}), group="nation")
    return {"refused": refused, "grown": "odd" in g.get_schema().group("nation").nodes, "provided": g.get_schema().provided}


def _replaced_schema(g: PropertyGraph) -> dict:
    """set_schema checks all data: a wrong one is refused and the old one stays."""
    wrong = g.get_schema()
    wrong.group("nation").nodes["n_name"] = S.AttributeDataType(S.Int)
    wrong.freeze()
    refused = _fails(lambda x: x.set_schema(wrong), S.SchemaError)(g)["raised"]
    right = g.get_schema()
    right.freeze()
    g.set_schema(right)
    return {"refused": refused, "provided": g.get_schema().provided, "groups": len(g.get_schema().groups)}


_SCHEMA_SQL = """
select * from (values ('nation', 'node', 'n_name', 'String', 'Unstructured'), ('nation', 'node', 'n_regionkey', 'Int', 'Continuous'), ('region', 'node', 'r_name', 'String', 'Unstructured'),
('customer', 'node', 'c_acctbal', 'Float', 'Continuous'), ('customer', 'node', 'c_mktsegment', 'String', 'Unstructured'), ('lives', 'edge', 'balance', 'Float', 'Continuous')) as t (grp, entity, name, type, role)
"""


# --- overviews


def _overview(spark, sf_dir):
    """What an overview tells of each attribute, as text or number."""
    g = PropertyGraph(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g.add_nodes((orders.select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), "o_totalprice", "o_orderdate", "o_orderstatus", (F.col("o_totalprice") > 200000).alias("large")), "id"), group="order")
    found = g.overview().groups["order"].nodes
    same = g.group_overview("order").nodes
    rows = [("count", "n", float(found.count)), ("same", "n", float(same.count))]
    for name, a in found.attributes.items():
        for k, v in a.data.items():
            rows.append((name, k, float(len(v)) if isinstance(v, list) else float(v) if isinstance(v, (int, float)) else float(v.year)))
    return _rows(spark, rows, "name string, what string, value double")


_OVERVIEW_SQL = """
select 'count' as name, 'n' as what, count(*)::double as value from orders union all select 'same', 'n', count(*) from orders
union all select 'o_totalprice', 'min', min(o_totalprice) from orders union all select 'o_totalprice', 'max', max(o_totalprice) from orders union all select 'o_totalprice', 'mean', avg(o_totalprice) from orders
union all select 'o_orderdate', 'min', year(min(o_orderdate)) from orders union all select 'o_orderdate', 'max', year(max(o_orderdate)) from orders
union all select 'o_orderstatus', 'distinct_count', count(distinct o_orderstatus) from orders union all select 'large', 'distinct_values', count(distinct o_totalprice > 200000) from orders
"""


def _rendered(g: PropertyGraph) -> dict:
    text = str(g.overview())
    return {part: part in text for part in ("[ungrouped]", "[nation]", "n_name | String | Unstructured", "balance | Float | Continuous")}


# --- indexers


def _index_read(g: PropertyGraph) -> DataFrame:
    one, many = g.node["n:3", "n_name"], g.node[["n:4", "n:5"], ["n_name", "n_regionkey"]]
    rows = [("n:3", one)] + [(k, v["n_name"]) for k, v in many.items()] + [(k, v) for k, v in g.node[_query("n_regionkey", "equal_to", 0), "n_name"].items() if k not in ("n:3", "n:4", "n:5")]
    return _rows(g.spark, rows, "id string, name string")


def _index_write(g: PropertyGraph) -> DataFrame:
    g.node["n:3", "n_name"] = "changed"
    g.node[_query("n_regionkey", "equal_to", 1), "n_name"] = "second"
    return g.query_nodes_df(lambda n: n.attribute("n_name"))


def _index_replace(g: PropertyGraph) -> DataFrame:
    g.node["n:3"] = {"n_name": "only"}
    return g.query_nodes_df(lambda n: (n.in_group("nation"), n.attribute("n_regionkey"))[1])


def _index_delete(g: PropertyGraph) -> DataFrame:
    del g.node[["n:3", "n:4"], "n_name"]
    return g.query_nodes_df(lambda n: (n.in_group("nation"), n.has_attribute("n_name"), n.index())[2])


def _edge_index(g: PropertyGraph) -> DataFrame:
    low = lambda e: (e.attribute("balance").less_than(0), e.index())[1]
    g.edge[low, "balance"] = 0.0
    g.edge[1001, "note"] = "seen"
    del g.edge[1002, "balance"]
    assert g.edge[1001, "note"] == "seen"
    return g.query_edges_df(lambda e: (e.in_group("lives"), e.attribute("balance"))[1])


def _cleared_edges(g: PropertyGraph) -> dict:
    g.clear_edges()
    return {"nodes": g.node_count(), "edges": g.edge_count()}


_N = "(select count(*) from nation)"
_R = "(select count(*) from region)"
_CU = "(select count(*) from customer)"


def _counts(nodes: str = f"{_N} + {_R} + {_CU}", edges: str = f"{_N} + {_CU}", groups: str = "5") -> str:
    return f"select 'nodes' as what, ({nodes})::bigint as n union all select 'edges', {edges} union all select 'groups', {groups}"


def _told(**values) -> str:
    return " union all ".join(f"select '{k}' as what, ({v})::bigint as n" for k, v in values.items())


ONE = lambda n: (f"z{n}", {"size": n})

ENTRIES: dict[str, tuple[Callable, str]] = {
    # construction
    "m01_new": (lambda spark, sf_dir: _rows(spark, [("nodes", PropertyGraph(spark).node_count()), ("edges", PropertyGraph(spark).edge_count())]), _told(nodes=0, edges=0)),
    "m02_from_dataframes": (_from_dataframes, "select 'n:' || n_nationkey as source, 'r:' || n_regionkey as target from nation"),
    "m03_from_tuples": (_from_tuples, "select 'n:' || n_nationkey as id, n_name as value from nation union all select 'r:' || r_regionkey, r_name from region"),
    "m04_from_pandas": (_from_pandas, "select 'r:' || n_regionkey as node, 'n:' || n_nationkey as neighbor from nation"),
    "m05_from_arrow": (_from_arrow, "select n_nationkey::bigint as id, 'n:' || n_nationkey as source, 'r:' || n_regionkey as target from nation"),
    "m06_builder": (_built, _told(nodes=f"{_N} + {_R}", edges=_N, groups=3, plugins=2, first=4, hooks=9)),
    "m07_numbered_edges": (_numbered, "select count(*) as n, count(*) as ids, 0::bigint as lo, count(*) - 1 as hi from (select l_orderkey from lineitem union all select l_orderkey from lineitem where l_linenumber = 1)"),
    "m08_numbered_in_order": (_numbered_in_order, "select row_number() over (order by l_orderkey) - 1 as id, l_orderkey as value from (select distinct l_orderkey from lineitem)"),
    "m09_clone": (_on(lambda g: (lambda other: {"own": (other.remove_nodes("n:1"), other.node_count())[1], "old": g.node_count()})(g.clone())), _told(own=f"{_N} + {_R} + {_CU} - 1", old=f"{_N} + {_R} + {_CU}")),
    "m10_clear": (_counted(lambda g: g.clear()), _told(nodes=0, edges=0, groups=0)),
    "m11_clear_edges": (_on(_cleared_edges), _told(nodes=f"{_N} + {_R} + {_CU}", edges=0)),
    # adding
    "m12_add_node": (_counted(lambda g: g.add_nodes(ONE(1))), _counts(f"{_N} + {_R} + {_CU} + 1")),
    "m13_add_node_with_group": (_counted(lambda g: g.add_nodes(ONE(1), group="new"), of=lambda g: {"members": g.nodes_in_group("new").count(), "groups": g.group_count()}), _told(members=1, groups=6)),
    "m14_add_node_with_groups": (_counted(lambda g: g.add_nodes(ONE(1), groups=["new", "nation"]), of=lambda g: {"new": g.nodes_in_group("new").count(), "nation": g.nodes_in_group("nation").count()}), _told(new=1, nation=f"{_N} + 1")),
    "m15_add_nodes": (_counted(lambda g: g.add_nodes([ONE(1), ONE(2)])), _counts(f"{_N} + {_R} + {_CU} + 2")),
    "m16_add_nodes_with_group": (_counted(lambda g: g.add_nodes([ONE(1), ONE(2)], group="nation"), of=lambda g: {"nation": g.nodes_in_group("nation").count()}), _told(nation=f"{_N} + 2")),
    "m17_add_nodes_with_groups": (_counted(lambda g: g.add_nodes([ONE(1), ONE(2)], groups=["a", "b"]), of=lambda g: {"a": g.nodes_in_group("a").count(), "b": g.nodes_in_group("b").count()}), _told(a=2, b=2)),
    "m18_add_nodes_dataframes": (_counted(lambda g: g.add_nodes((g.spark.range(7).selectExpr("concat('q', id) as id", "id as v"), "id"))), _counts(f"{_N} + {_R} + {_CU} + 7")),
    "m19_add_nodes_dataframes_with_groups": (_counted(lambda g: g.add_nodes((g.spark.range(7).selectExpr("concat('q', id) as id"), "id"), groups=["a", "b"]), of=lambda g: {"a": g.nodes_in_group("a").count(), "b": g.nodes_in_group("b").count()}), _told(a=7, b=7)),
    "m20_add_node_twice": (_on(_fails(lambda g: g.add_nodes(("n:1", {})), AssertionError)), _told(raised=1)),
    "m21_add_edge": (_on(lambda g: {"id": g.add_edges(("n:0", "n:1", {}))[0], "edges": g.edge_count()}), _told(id="(select max(c_custkey) + 1001 from customer)", edges=f"{_N} + {_CU} + 1")),
    "m22_add_edge_with_group": (_counted(lambda g: g.add_edges(("n:0", "n:1", {}), group="next"), of=lambda g: {"members": g.edges_in_group("next").count()}), _told(members=1)),
    "m23_add_edge_with_groups": (_counted(lambda g: g.add_edges(("n:0", "n:1", {}), groups=["next", "lies"]), of=lambda g: {"next": g.edges_in_group("next").count(), "lies": g.edges_in_group("lies").count()}), _told(next=1, lies=f"{_N} + 1")),
    "m24_add_edges": (_counted(lambda g: g.add_edges([("n:0", "n:1", {}), ("n:0", "n:1", {})])), _counts(edges=f"{_N} + {_CU} + 2")),
    "m25_add_edges_with_group": (_counted(lambda g: g.add_edges([("n:0", "n:1", {}), ("n:1", "n:2", {})], group="lies"), of=lambda g: {"lies": g.edges_in_group("lies").count()}), _told(lies=f"{_N} + 2")),
    "m26_add_edges_with_groups": (_counted(lambda g: g.add_edges([("n:0", "n:1", {}), ("n:1", "n:2", {})], groups=["a", "b"]), of=lambda g: {"a": g.edges_in_group("a").count(), "b": g.edges_in_group("b").count()}), _told(a=2, b=2)),
    "m27_add_edges_dataframes_with_group": (_counted(lambda g: g.add_edges((_lying(g), "s", "t"), group="back"), of=lambda g: {"back": g.edges_in_group("back").count(), "ids": g.edge_indices().distinct().count()}), _told(back=_N, ids=f"2 * {_N} + {_CU}")),
    "m28_add_edges_dataframes_with_groups": (_counted(lambda g: g.add_edges((_lying(g), "s", "t"), groups=["a", "b"]), of=lambda g: {"a": g.edges_in_group("a").count(), "b": g.edges_in_group("b").count()}), _told(a=_N, b=_N)),
    "m29_add_edge_to_nowhere": (_on(_fails(lambda g: g.add_edges(("n:0", "nowhere", {})), IndexError)), _told(raised=1)),
    # removing
    "m30_remove_node": (_counted(lambda g: g.remove_nodes("n:1")), _counts(f"{_N} + {_R} + {_CU} - 1", f"{_N} + {_CU} - 1 - (select count(*) from customer where c_nationkey = 1)")),
    "m31_remove_nodes": (_counted(lambda g: g.remove_nodes(["r:0", "r:1"])), _counts(f"{_N} + {_R} + {_CU} - 2", f"{_N} + {_CU} - (select count(*) from nation where n_regionkey < 2)")),
    "m32_removed_node_attributes": (_on(lambda g: _rows(g.spark, [(k, v["n_name"]) for k, v in g.remove_nodes(["n:1", "n:2"]).items()], "id string, name string")), "select 'n:' || n_nationkey as id, n_name as name from nation where n_nationkey in (1, 2)"),
    "m33_removed_by_query": (_on(lambda g: g.remove_nodes(_query("n_regionkey", "equal_to", 2)).select("id", "n_name")), "select 'n:' || n_nationkey as id, n_name from nation where n_regionkey = 2"),
    "m34_remove_edge": (_counted(lambda g: g.remove_edges(3)), _counts(edges=f"{_N} + {_CU} - 1")),
    "m35_remove_edges": (_on(lambda g: (g.remove_edges(lambda e: (e.attribute("balance").less_than(0), e.index())[1]), g.edges_in_group("lives"))[1]), "select c_custkey + 1000 as id from customer where c_acctbal >= 0"),
    "m36_removed_edge_attributes": (_on(lambda g: _rows(g.spark, [(k, v["balance"]) for k, v in g.remove_edges([1001, 1002]).items()], "id bigint, balance double")), "select c_custkey + 1000 as id, c_acctbal as balance from customer where c_custkey in (1, 2)"),
    "m37_remove_unknown": (_on(_fails(lambda g: g.remove_nodes("nowhere"), IndexError)), _told(raised=1)),
    # reading
    "m40_node_indices": (_on(lambda g: g.node_indices()), "select 'n:' || n_nationkey as id from nation union all select 'r:' || r_regionkey from region union all select 'c:' || c_custkey from customer"),
    "m41_edge_indices": (_on(lambda g: g.edge_indices()), "select n_nationkey::bigint as id from nation union all select c_custkey + 1000 from customer"),
    "m42_edge_endpoints": (_on(lambda g: g.edge_endpoints()), "select n_nationkey::bigint as id, 'n:' || n_nationkey as source, 'r:' || n_regionkey as target from nation union all select c_custkey + 1000, 'c:' || c_custkey, 'n:' || c_nationkey from customer"),
    "m43_edge_endpoints_of": (_on(lambda g: g.edge_endpoints([3, 4])), "select n_nationkey::bigint as id, 'n:' || n_nationkey as source, 'r:' || n_regionkey as target from nation where n_nationkey in (3, 4)"),
    "m44_counts": (_counted(), _counts()),
    "m45_contains": (_on(lambda g: {"node": g.contains_node("n:1"), "no node": g.contains_node("x"), "edge": g.contains_edge(3), "no edge": g.contains_edge(999), "group": g.contains_group("lies"), "no group": g.contains_group("x")}), "select * from (values ('node', 1::bigint), ('no node', 0), ('edge', 1), ('no edge', 0), ('group', 1), ('no group', 0)) as t (what, n)"),
    "m46_connecting_undirected": (_on(lambda g: g.edges_connecting(["r:0"], [f"n:{k}" for k in range(25)], undirected=True)), "select n_nationkey::bigint as id from nation where n_regionkey = 0"),
    "m47_neighbors_outgoing": (_on(lambda g: g.neighbors(["n:0", "n:1", "n:2"])), "select 'n:' || n_nationkey as node, 'r:' || n_regionkey as neighbor from nation where n_nationkey < 3"),
    "m48_neighbors_incoming": (_on(lambda g: g.neighbors("n:0", EdgeDirection.INCOMING)), "select 'n:0' as node, 'c:' || c_custkey as neighbor from customer where c_nationkey = 0"),
    "m49_neighbors_both": (_on(lambda g: g.neighbors("n:0", EdgeDirection.BOTH)), "select 'n:0' as node, 'c:' || c_custkey as neighbor from customer where c_nationkey = 0 union select 'n:0', 'r:' || n_regionkey from nation where n_nationkey = 0"),
    "m50_query_nodes": (_on(lambda g: _rows(g.spark, [(i,) for i in g.query_nodes(_query("n_regionkey", "equal_to", 3))], "id string")), "select 'n:' || n_nationkey as id from nation where n_regionkey = 3"),
    "m51_query_edges": (_on(lambda g: _rows(g.spark, list(g.query_edges(lambda e: (e.attribute("balance").less_than(0), e.attribute("balance"))[1]).items()), "id bigint, value double")), "select c_custkey + 1000 as id, c_acctbal as value from customer where c_acctbal < 0"),
    "m52_nodes_frame": (_on(lambda g: g.nodes.groupBy(F.element_at("__groups", 1).alias("grp")).count()), f"select 'nation' as grp, {_N} as count union all select 'region', {_R} union all select 'customer', {_CU}"),
    "m53_edges_frame": (_on(lambda g: g.edges.groupBy(F.element_at("__groups", 1).alias("grp")).count()), f"select 'lies' as grp, {_N} as count union all select 'lives', {_CU}"),
    # groups
    "m60_groups": (_on(lambda g: _rows(g.spark, [(x,) for x in g.groups()], "grp string")), "select unnest(['nation', 'region', 'customer', 'lies', 'lives']) as grp"),
    "m61_group": (_on(lambda g: _rows(g.spark, [(str(x),) for x in g.group("region")["nodes"] + g.group("lies")["edges"]], "id string")), "select 'r:' || r_regionkey as id from region union all select n_nationkey::varchar from nation"),
    "m62_add_group": (_on(lambda g: (g.add_group("first", ["n:0", "r:0"], [0, 1]), g.nodes_in_group("first"))[1]), "select unnest(['n:0', 'r:0']) as id"),
    "m63_add_group_by_query": (_on(lambda g: (g.add_group("rich", _query("c_acctbal", "greater_than", 9000)), g.nodes_in_group("rich"))[1]), "select 'c:' || c_custkey as id from customer where c_acctbal > 9000"),
    "m64_remove_group": (_counted(lambda g: g.remove_groups("region"), of=lambda g: {"groups": g.group_count(), "ungrouped": g.ungrouped_nodes().count(), "nodes": g.node_count()}), _told(groups=4, ungrouped=_R, nodes=f"{_N} + {_R} + {_CU}")),
    "m65_add_node_to_group": (_on(lambda g: (g.add_nodes_to_group("region", "n:1"), g.nodes_in_group("region"))[1]), "select 'r:' || r_regionkey as id from region union all select 'n:1'"),
    "m66_add_nodes_to_groups": (_on(lambda g: (g.add_nodes_to_group(["a", "b"], ["n:1", "n:2"]), g.nodes_in_group("a").union(g.nodes_in_group("b")))[1]), "select unnest(['n:1', 'n:2', 'n:1', 'n:2']) as id"),
    "m67_add_edge_to_group": (_on(lambda g: (g.add_edges_to_group("lives", 3), g.edges_in_group("lives"))[1]), "select c_custkey + 1000 as id from customer union all select 3"),
    "m68_add_edges_to_groups": (_on(lambda g: (g.add_edges_to_group(["a", "b"], [1, 2]), g.edges_in_group("a").union(g.edges_in_group("b")))[1]), "select unnest([1::bigint, 2, 1, 2]) as id"),
    "m69_remove_node_from_group": (_on(lambda g: (g.remove_nodes_from_group("nation", "n:1"), g.nodes_in_group("nation"))[1]), "select 'n:' || n_nationkey as id from nation where n_nationkey <> 1"),
    "m70_remove_nodes_from_groups": (_on(lambda g: (g.add_nodes_to_group("both", ["n:1", "n:2", "n:3"]), g.remove_nodes_from_group(["both", "nation"], ["n:1", "n:2"]), g.nodes_in_group("both").union(g.nodes_in_group("nation")))[2]), "select 'n:3' as id union all select 'n:' || n_nationkey from nation where n_nationkey not in (1, 2)"),
    "m71_remove_edge_from_group": (_on(lambda g: (g.remove_edges_from_group("lies", 1), g.edges_in_group("lies"))[1]), "select n_nationkey::bigint as id from nation where n_nationkey <> 1"),
    "m72_remove_edges_from_groups": (_on(lambda g: (g.add_edges_to_group("both", [1, 2, 3]), g.remove_edges_from_group(["both", "lies"], [1, 2]), g.edges_in_group("both").union(g.edges_in_group("lies")))[2]), "select 3::bigint as id union all select n_nationkey from nation where n_nationkey not in (1, 2)"),
    "m73_groups_of": (_on(lambda g: (g.add_nodes_to_group("more", "n:1"), g.add_edges_to_group("more", 1), _rows(g.spark, [("node", ",".join(g.groups_of_node("n:1"))), ("edge", ",".join(g.groups_of_edge(1)))], "what string, grps string"))[2]), "select * from (values ('node', 'more,nation'), ('edge', 'lies,more')) as t (what, grps)"),
    "m74_ungrouped_edges": (_on(lambda g: (g.remove_groups("lies"), g.ungrouped_edges())[1]), "select n_nationkey::bigint as id from nation"),
    "m75_to_dataframes": (_on(lambda g: g.to_dataframes()["lives"]["edges"]), "select c_custkey + 1000 as edge_index, 'c:' || c_custkey as source_node_index, 'n:' || c_nationkey as target_node_index, c_acctbal as balance from customer"),
    "m76_to_pandas": (_to_pandas, "select 'n:' || n_nationkey as node_index, n_name from nation"),
    # attributes
    "m80_indexer_read": (_on(_index_read), "select 'n:' || n_nationkey as id, n_name as name from nation where n_regionkey = 0 or n_nationkey in (3, 4, 5)"),
    "m81_indexer_write": (_on(_index_write), "select 'n:' || n_nationkey as id, case when n_regionkey = 1 then 'second' when n_nationkey = 3 then 'changed' else n_name end as value from nation"),
    "m82_indexer_replace": (_on(_index_replace), "select 'n:' || n_nationkey as id, n_regionkey::bigint as value from nation where n_nationkey <> 3"),
    "m83_indexer_delete": (_on(_index_delete), "select 'n:' || n_nationkey as id from nation where n_nationkey not in (3, 4)"),
    "m84_edge_indexer": (_on(_edge_index), "select c_custkey + 1000 as id, greatest(c_acctbal, 0.0) as value from customer where c_custkey <> 2"),
    "m85_indexer_unknown": (_on(_fails(lambda g: g.node["nowhere"], IndexError)), _told(raised=1)),
    # schema
    "s01_inferred": (_on(lambda g: _shown(g, S.Schema.infer(g))), _SCHEMA_SQL),
    "s02_kept": (_on(lambda g: _shown(g, g.get_schema())), _SCHEMA_SQL),
    "s03_calls": (_schema_calls, "select * from (values ('set', 'a Int Continuous'), ('update', 'a Union(Int, Float) Continuous'), ('add', 'a Union(Int, Float) Continuous, b Option(String) Unstructured'), ('replace', 'a Union(Int, Float) Continuous, b Bool Categorical'), ('remove', 'b Bool Categorical'), ('merge roles', 'b Union(Bool, DateTime) Categorical'), ('group', 'Any'), ('groups', '0'), ('frozen', 'True'), ('unfrozen', 'False')) as t (what, shown)"),
    "s04_refusals": (_refusals, "select * from (values ('fits', false), ('no option', false), ('null option', false), ('wrong type', true), ('missing', true), ('too many', true), ('wrong edge', true), ('null', true), ('role', true)) as t (what, refused)"),
    "s05_frozen": (_on(_provided), _told(refused=1, grown=1, provided=0)),
    "s06_set_schema": (_on(_replaced_schema), _told(refused=1, provided=1, groups=5)),
    "s07_set_schema_unchecked": (_on(lambda g: (g.set_schema_unchecked(S.Schema()), {"groups": len(g.get_schema().groups)})[1]), _told(groups=0)),
    # plugins, connectors, snapshots, overviews
    "p01_hooks": (_hooks, "select hook, case hook when 'add_group' then 2 else 1 end::bigint as pre, case hook when 'add_group' then 2 when 'initialize' then 0 when 'finalize' then 0 else 1 end::bigint as post from (select unnest([" + ", ".join(f"'{h}'" for h in (*HOOKS, "initialize", "finalize")) + "]) as hook)"),
    "p02_pre_hook_changes_input": (_renamed, "select 'N:' || n_nationkey as id from nation"),
    "p03_connector": (_connected, "select 'n:' || n_nationkey as id, n_name as value from nation union all select 'r:' || r_regionkey, r_name from region"),
    "p04_connector_calls": (_connector_calls, _told(initialize=1, ingest=1, export=1, disconnect=1, nodes=_N)),
    "p05_snapshot_parquet": (_snapshot("parquet"), "select c_custkey + 1000 as id, c_acctbal as value from customer"),
    "p06_snapshot_json": (_snapshot("json"), "select c_custkey + 1000 as id, c_acctbal as value from customer"),
    "p07_overview": (_overview, _OVERVIEW_SQL),
    "p08_overview_text": (_on(_rendered), "select unnest(['[ungrouped]', '[nation]', 'n_name | String | Unstructured', 'balance | Float | Continuous']) as what, 1::bigint as n"),
}


def _lying(g: PropertyGraph) -> DataFrame:
    """The edges of ``lies`` turned round, as a frame without ids."""
    return g.edge_endpoints().where("id < 1000").select(F.col("target").alias("s"), F.col("source").alias("t"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items()}
