"""Registered queries: every verb on the star graph, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_container, catalog_operands
from .functions.values import FIELD, Kind
from .operators.operands import Discriminator, EdgeDirection, MatchMode
from .plans.star import star_graph

OUT, IN, BOTH = EdgeDirection.OUTGOING, EdgeDirection.INCOMING, EdgeDirection.BOTH


@dataclass(frozen=True)
class Entry:
    """A query function on nodes or edges and the SQL of its result."""

    entity: str
    query: Callable
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = star_graph(spark, sf_dir)
        return graph.query_nodes_df(self.query) if self.entity == "node" else graph.query_edges_df(self.query)


def _values(group: str, name: str, *steps: tuple):
    """Values of an attribute in a group after the named steps."""

    def query(root):
        root.in_group(group)
        v = root.attribute(name)
        for step, *args in steps:
            getattr(v, step)(*args)
        return v

    return query


def _aggregate(group: str, name: str, aggregate: str, *steps: tuple):
    def query(root):
        root.in_group(group)
        v = getattr(root.attribute(name), aggregate)()
        for step, *args in steps:
            getattr(v, step)(*args)
        return v

    return query


def _ids(group: str, condition: Callable):
    """Ids of a group's members under a condition."""

    def query(root):
        root.in_group(group)
        condition(root)
        return root.index()

    return query


def _index(group: str, *steps: tuple):
    def query(root):
        root.in_group(group)
        ids = root.index()
        for step, *args in steps:
            getattr(ids, step)(*args)
        return ids

    return query


def _tree(group: str, *steps: tuple):
    def query(root):
        root.in_group(group)
        names = root.attributes()
        for step, *args in steps:
            getattr(names, step)(*args)
        return names

    return query


def _picked(group: str, pick: str, *steps: tuple):
    """One attribute name per entity, and what follows."""

    def query(root):
        root.in_group(group)
        out = getattr(root.attributes(), pick)()
        for step, *args in steps:
            got = getattr(out, step)(*args)
            out = got if got is not None else out
        return out

    return query


def _grouped(group: str, by, then: Callable):
    def query(root):
        root.in_group(group)
        return then(root.group_by(by))

    return query


def _above_mean(part):
    part.in_group("part")
    size = part.attribute("p_size")
    size.greater_than(part.attribute("p_size").mean())
    return part.index()


def _group_filtered(node):
    node.in_group("customer")
    group = node.group_by(Discriminator.Attribute("c_mktsegment"))
    group.attribute("c_acctbal").is_max()
    return group.ungroup().index()


def _segment_best(node):
    node.in_group("customer")
    best = node.group_by(Discriminator.Attribute("c_mktsegment")).attribute("c_acctbal").max()
    best.greater_than(9990)
    return best


def _flagship(node):
    node.in_group("customer")
    node.attribute("c_acctbal").greater_than(0)
    node.neighbors().attribute("o_totalprice").greater_than(200000)
    return node.index()


def _chained(node):
    """Parts that an Asian-style multi-hop reaches: region, nation, supplier, part."""
    node.in_group("part")
    supplier = node.neighbors(OUT)
    supplier.attribute("s_acctbal").greater_than(5000)
    region = supplier.neighbors(OUT).neighbors(OUT)
    region.attribute("r_name").equal_to("ASIA")
    return node.index()


def _values_union(node):
    node.in_group("part")
    size = node.attribute("p_size")
    size.either_or(lambda v: v.greater_than(45), lambda v: (v.less_than(5), v.multiply(100)))
    return size


def _in_operand(node):
    node.in_group("nation")
    keys = node.attribute("n_regionkey")
    regions = node.graph._root("node")
    regions.in_group("region")
    region_keys = regions.attribute("r_regionkey")
    region_keys.less_than(2)
    keys.is_in(region_keys)
    return node.index()


def _not_in_operand(node):
    node.in_group("nation")
    regions = node.graph._root("node")
    regions.in_group("region")
    region_keys = regions.attribute("r_regionkey")
    region_keys.less_than(2)
    node.attribute("n_regionkey").is_not_in(region_keys)
    return node.index()


def _gate(node):
    node.in_group("part")
    node.attribute("p_size").mean().greater_than(10)
    return node.index()


def _kind_column(root):
    root.in_group("part")
    v = root.attribute("p_name")
    v.is_string()
    return v


_C, _P, _O = "'c:' || c_custkey", "'p:' || p_partkey", "'o:' || o_orderkey"


def _node(query, sql):
    return Entry("node", query, sql)


def _edge(query, sql):
    return Entry("edge", query, sql)


def _bal(condition: str) -> str:
    return f"select {_C} as id from customer where {condition}"


def _size(expression: str) -> str:
    return f"select {_P} as id, {expression} as value from part"


ENTRIES: dict[str, Entry] = {
    # structure
    "v01_attribute": _node(_values("customer", "c_acctbal"), f"select {_C} as id, c_acctbal as value from customer"),
    "v02_attributes": _node(_tree("region"), "select 'r:' || r_regionkey as id, ['r_name', 'r_regionkey'] as attributes from region"),
    "v03_has_attribute": _node(lambda n: (n.has_attribute(["s_acctbal", "r_name"], MatchMode.ANY), n.index())[1], "select 's:' || s_suppkey as id from supplier union all select 'r:' || r_regionkey from region"),
    "v04_in_group": _node(lambda n: (n.in_group(["nation", "region"], MatchMode.ANY), n.index())[1], "select 'n:' || n_nationkey as id from nation union all select 'r:' || r_regionkey from region"),
    "v05_edges": _node(_ids("customer", lambda n: n.edges(OUT).attribute("year").equal_to(1998)), "select 'c:' || c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) = 1998)"),
    "v06_neighbors": _node(_flagship, "select 'c:' || c_custkey as id from customer where c_acctbal > 0 and exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)"),
    "v06_neighbors_undirected": _node(lambda n: (n.in_group("nation"), n.neighbors(BOTH).index().count())[1], "select (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from nation) as value"),
    "v06_neighbors_chain": _node(_chained, "select 'p:' || p_partkey as id from part where exists (select 1 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_partkey = p_partkey and s_acctbal > 5000 and r_name = 'ASIA')"),
    "v07_source_node": _edge(_ids("placed", lambda e: e.source_node().attribute("c_mktsegment").equal_to("BUILDING")), "select o_orderkey * 8 as id from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'"),
    "v08_target_node": _edge(lambda e: (e.in_group("lives"), e.target_node().index())[1], "select 'n:' || c_nationkey as id from customer"),
    "v09_index": _node(_index("supplier"), "select 's:' || s_suppkey as id from supplier"),
    "v10_to_values": _node(_picked("region", "max", ("to_values",)), None),
    "v10_to_values_text": _node(_picked("nation", "min", ("to_values",), ("is_string",)), "select 'n:' || n_nationkey as id, n_name as value from nation"),
    # aggregates
    "v11_max": _node(_aggregate("part", "p_name", "max"), "select max(p_name) as value, max_by('p:' || p_partkey, (p_name, 'p:' || p_partkey)) as id from part"),
    "v12_min": _node(_aggregate("customer", "c_acctbal", "min"), "select 'c:' || c_custkey as id, c_acctbal as value from customer order by c_acctbal, 'c:' || c_custkey limit 1"),
    "v13_count": _node(_aggregate("order", "o_totalprice", "count"), "select count(*) as value from orders"),
    "v14_sum": _node(_aggregate("part", "p_size", "sum"), "select cast(sum(p_size) as bigint) as value from part"),
    "v15_mean": _node(_aggregate("part", "p_size", "mean"), "select avg(p_size) as value from part"),
    "v15_mean_time": _node(_aggregate("order", "o_orderdate", "mean"), "select make_timestamp(cast(floor(sum(epoch(o_orderdate)) / count(*)) as bigint) * 1000000) as value from orders"),
    "v16_median": _node(_aggregate("part", "p_size", "median"), "select cast(median(p_size) as double) as value from part"),
    "v17_mode": _node(_aggregate("customer", "c_mktsegment", "mode"), "select c_mktsegment as value from customer group by 1 order by count(*) desc, min('c:' || c_custkey) limit 1"),
    "v18_std": _node(_aggregate("part", "p_size", "std", ("multiply", 1000), ("round",)), "select round(stddev_pop(p_size) * 1000) as value from part"),
    "v19_var": _node(_aggregate("part", "p_size", "var", ("multiply", 1000), ("round",)), "select round(var_pop(p_size) * 1000) as value from part"),
    "v20_random": _node(_aggregate("part", "p_size", "random"), None),
    # comparisons
    "v21_greater_than": _node(_ids("customer", lambda n: n.attribute("c_acctbal").greater_than(5000)), _bal("c_acctbal > 5000")),
    "v22_greater_than_or_equal_to": _node(_ids("part", lambda n: n.attribute("p_size").greater_than_or_equal_to(25)), f"select {_P} as id from part where p_size >= 25"),
    "v23_less_than": _node(_ids("customer", lambda n: n.attribute("c_acctbal").less_than(0)), _bal("c_acctbal < 0")),
    "v24_less_than_or_equal_to": _node(_ids("part", lambda n: n.attribute("p_size").less_than_or_equal_to(5.0)), f"select {_P} as id from part where p_size <= 5"),
    "v25_equal_to": _node(_ids("customer", lambda n: n.attribute("c_mktsegment").equal_to("BUILDING")), _bal("c_mktsegment = 'BUILDING'")),
    "v26_not_equal_to": _node(_ids("customer", lambda n: n.attribute("c_mktsegment").not_equal_to("BUILDING")), _bal("c_mktsegment <> 'BUILDING'")),
    "v27_starts_with": _node(_ids("part", lambda n: n.attribute("p_name").starts_with("red")), f"select {_P} as id from part where starts_with(p_name, 'red')"),
    "v28_ends_with": _node(_ids("part", lambda n: n.attribute("p_size").ends_with(7)), f"select {_P} as id from part where suffix(cast(p_size as varchar), '7')"),
    "v29_contains": _node(_ids("part", lambda n: n.attribute("p_name").contains("ring")), f"select {_P} as id from part where contains(p_name, 'ring')"),
    "v30_is_in": _node(_ids("part", lambda n: n.attribute("p_size").is_in([1, 7, 30.0])), f"select {_P} as id from part where p_size in (1, 7, 30)"),
    "v30_is_in_operand": _node(_in_operand, "select 'n:' || n_nationkey as id from nation where n_regionkey in (select r_regionkey from region where r_regionkey < 2)"),
    "v31_is_not_in": _node(_ids("part", lambda n: n.attribute("p_size").is_not_in([1, 7, 30])), f"select {_P} as id from part where p_size not in (1, 7, 30)"),
    "v31_is_not_in_operand": _node(_not_in_operand, "select 'n:' || n_nationkey as id from nation where n_regionkey not in (select r_regionkey from region where r_regionkey < 2)"),
    "v21_operand": _node(_above_mean, f"select {_P} as id from part where p_size > (select avg(p_size) from part)"),
    # arithmetic
    "v32_add": _node(_values("part", "p_size", ("add", 100)), _size("cast(p_size + 100 as bigint)")),
    "v32_add_text": _node(_values("region", "r_name", ("add", "!")), "select 'r:' || r_regionkey as id, r_name || '!' as value from region"),
    "v33_subtract": _node(_values("part", "p_size", ("subtract", 100)), _size("cast(p_size - 100 as bigint)")),
    "v34_multiply": _node(_values("part", "p_size", ("multiply", 3)), _size("cast(p_size * 3 as bigint)")),
    "v34_repeat": _node(_values("region", "r_name", ("multiply", 2)), "select 'r:' || r_regionkey as id, repeat(r_name, 2) as value from region"),
    "v35_divide": _node(_values("part", "p_size", ("divide", 4)), _size("p_size / 4.0::double")),
    "v35_divide_by_zero": _node(_values("part", "p_size", ("divide", 0), ("greater_than", 1e300)), f"select {_P} as id, 'inf'::double as value from part"),
    "v36_power": _node(_values("part", "p_size", ("power", 2)), _size("cast(p_size * p_size as bigint)")),
    "v37_modulo": _node(_values("part", "p_size", ("modulo", 7)), _size("cast(p_size % 7 as bigint)")),
    "v38_round": _node(_values("customer", "c_acctbal", ("round",)), f"select {_C} as id, round(c_acctbal) as value from customer"),
    "v39_ceil": _node(_values("customer", "c_acctbal", ("ceil",)), f"select {_C} as id, ceil(c_acctbal) as value from customer"),
    "v40_floor": _node(_values("customer", "c_acctbal", ("floor",)), f"select {_C} as id, floor(c_acctbal) as value from customer"),
    "v41_absolute": _node(_values("customer", "c_acctbal", ("absolute",)), f"select {_C} as id, abs(c_acctbal) as value from customer"),
    "v42_sqrt": _node(_values("part", "p_size", ("sqrt",)), _size("sqrt(p_size)")),
    # text
    "v43_trim": _node(_values("region", "r_name", ("multiply", 1), ("trim",)), "select 'r:' || r_regionkey as id, trim(r_name) as value from region"),
    "v44_trim_start": _node(_values("nation", "n_name", ("trim_start",)), "select 'n:' || n_nationkey as id, ltrim(n_name) as value from nation"),
    "v45_trim_end": _node(_values("nation", "n_name", ("add", " \t"), ("trim_end",)), "select 'n:' || n_nationkey as id, n_name as value from nation"),
    "v46_lowercase": _node(_values("customer", "c_mktsegment", ("lowercase",)), f"select {_C} as id, lower(c_mktsegment) as value from customer"),
    "v47_uppercase": _node(_values("part", "p_name", ("uppercase",)), _size("upper(p_name)")),
    "v48_slice": _node(_values("customer", "c_name", ("slice", 0, 8)), f"select {_C} as id, substring(c_name, 1, 8) as value from customer"),
    # kinds
    "v49_is_string": _node(_kind_column, _size("p_name")),
    "v50_is_int": _node(_values("part", "p_size", ("is_int",)), _size("cast(p_size as bigint)")),
    "v51_is_float": _node(_values("part", "p_retailprice", ("is_float",)), _size("p_retailprice")),
    "v52_is_bool": _node(_aggregate("part", "p_size", "count", ("is_bool",)), "select 0::bigint as value where false"),
    "v53_is_datetime": _node(_values("order", "o_orderdate", ("is_datetime",)), f"select {_O} as id, o_orderdate as value from orders"),
    "v54_is_duration": _node(_ids("part", lambda n: n.attribute("p_size").is_duration()), f"select {_P} as id from part where false"),
    "v55_is_null": _node(_ids("part", lambda n: n.attribute("p_size").is_null()), f"select {_P} as id from part where p_size is null"),
    "v56_is_max": _node(_ids("part", lambda n: n.attribute("p_size").is_max()), f"select {_P} as id from part where p_size = (select max(p_size) from part)"),
    "v57_is_min": _node(_ids("part", lambda n: n.attribute("p_size").is_min()), f"select {_P} as id from part where p_size = (select min(p_size) from part)"),
    # choices
    "v58_either_or": _node(_ids("customer", lambda n: n.either_or(lambda x: x.attribute("c_acctbal").less_than(0), lambda x: x.neighbors(OUT).attribute("o_totalprice").greater_than(480000))), _bal("c_acctbal < 0 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)")),
    "v58_either_or_values": _node(_values_union, f"select {_P} as id, cast(case when p_size > 45 then p_size else p_size * 100 end as bigint) as value from part where p_size > 45 or p_size < 5"),
    "v59_exclude": _node(_ids("customer", lambda n: n.exclude(lambda x: x.edges(OUT).attribute("year").greater_than(1996))), _bal("not exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) > 1996)")),
    # grouping
    "g01_group_by_attribute": _node(_grouped("customer", Discriminator.Attribute("c_mktsegment"), lambda g: g.index().count()), "select c_mktsegment as \"group\", true as group_present, count(*) as value from customer group by 1"),
    "g02_group_by_source": _edge(_grouped("placed", Discriminator.SOURCE_NODE, lambda g: g.index().count()), "select 'c:' || o_custkey as \"group\", count(*) as value from orders group by 1"),
    "g03_group_by_target": _edge(_grouped("contains", Discriminator.TARGET_NODE, lambda g: g.attribute("l_linenumber").sum()), "select 'p:' || l_partkey as \"group\", cast(sum(l_linenumber) as bigint) as value from lineitem group by 1"),
    "g04_group_by_parallel": _edge(_grouped("contains", Discriminator.PARALLEL, lambda g: g.index().count()), "select 'o:' || l_orderkey as group_source, 'p:' || l_partkey as group_target, count(*) as value from lineitem group by 1, 2"),
    "g05_group_then_filter": _node(_segment_best, "select c_mktsegment as \"group\", true as group_present, max(('c:' || c_custkey)) filter (c_acctbal = m) as id, m as value from (select *, max(c_acctbal) over (partition by c_mktsegment) as m from customer) where m > 9990 group by c_mktsegment, m"),
    "g06_ungroup": _node(_group_filtered, f"select {_C} as id from customer join (select c_mktsegment, max(c_acctbal) as m from customer group by 1) using (c_mktsegment) where c_acctbal = m"),
    "g07_ungroup_values": _node(_grouped("customer", Discriminator.Attribute("c_mktsegment"), lambda g: g.attribute("c_acctbal").max().ungroup().min()), "select id, value from (select max('c:' || c_custkey) as id, c_acctbal as value from customer join (select c_mktsegment, max(c_acctbal) as m from customer group by 1) using (c_mktsegment) where c_acctbal = m group by c_mktsegment, c_acctbal) order by value, id limit 1"),
    "g08_clone": _node(lambda n: (n.in_group("region"), n.clone().index())[1], "select 'r:' || r_regionkey as id from region"),
    "g09_gate": _node(_gate, f"select {_P} as id from part where (select avg(p_size) from part) > 10"),
    # ids and attribute names
    "i01_index_text": _node(_index("nation", ("ends_with", "3")), "select 'n:' || n_nationkey as id from nation where suffix('n:' || n_nationkey, '3')"),
    "i02_index_arithmetic": _edge(_index("lives", ("subtract", 3), ("less_than", 80)), "select c_custkey * 8 as id from customer where c_custkey * 8 < 80"),
    "i03_index_max": _edge(lambda e: (e.in_group("placed"), e.index().max())[1], "select max(o_orderkey) * 8 as value from orders"),
    "i04_index_sum": _edge(lambda e: (e.in_group("lives"), e.index().sum())[1], "select cast(sum(c_custkey * 8 + 3) as bigint) as value from customer"),
    "i05_index_exclude": _node(_index("nation", ("exclude", lambda i: i.starts_with("n:1"))), "select 'n:' || n_nationkey as id from nation where not starts_with('n:' || n_nationkey, 'n:1')"),
    "t01_tree_filter": _node(_tree("part", ("starts_with", "p_n")), f"select {_P} as id, ['p_name'] as attributes from part"),
    "t02_tree_change": _node(_tree("region", ("uppercase",), ("slice", 2, 6)), "select 'r:' || r_regionkey as id, ['NAME', 'REGI'] as attributes from region"),
    "t03_tree_count": _node(_picked("supplier", "count"), "select 's:' || s_suppkey as id, 4::bigint as value from supplier"),
    "t04_tree_max": _node(_picked("nation", "max"), "select 'n:' || n_nationkey as id, 'n_regionkey' as value from nation"),
    "t05_names_sum": _node(_picked("region", "min", ("sum",)), "select repeat('r_name', count(*)) as value from region"),
}
#: A mixed column cannot be compared with a plain one in SQL, so it is unpacked.
_UNPACKED = {"v10_to_values": Kind.INT, "v10_to_values_text": Kind.STRING}


def _unpacked(name: str, kind: Kind):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ENTRIES[name](spark, sf_dir).select("id", F.col(f"value.{FIELD[kind]}").alias("value"))

    return run


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container calls: group members, endpoints, connecting edges, neighbours."""
    g = star_graph(spark, sf_dir)
    counts = [
        ("nations", g.nodes_in_group("nation").agg(F.count("*").alias("n"))),
        ("lies", g.edges_in_group("lies").agg(F.count("*").alias("n"))),
        ("out", g.outgoing_edges("c:0").agg(F.count("*").alias("n"))),
        ("in", g.incoming_edges(["n:0", "n:1"]).agg(F.count("*").alias("n"))),
        ("connecting", g.edges_connecting(["n:0", "n:1"], ["r:0", "r:1"]).agg(F.count("*").alias("n"))),
        ("neighbors", g.neighbors("r:0", EdgeDirection.BOTH).agg(F.count("*").alias("n"))),
        ("ungrouped", g.ungrouped_nodes().agg(F.count("*").alias("n"))),
    ]
    out = None
    for name, df in counts:
        df = df.select(F.lit(name).alias("what"), "n")
        out = df if out is None else out.union(df)
    return out


_MEMBERS_SQL = """
select 'nations' as what, count(*) as n from nation union all
select 'lies', count(*) from nation union all
select 'out', (select count(*) from orders where o_custkey = 0) + (select count(*) from customer where c_custkey = 0) union all
select 'in', (select count(*) from customer where c_nationkey in (0, 1)) + (select count(*) from supplier where s_nationkey in (0, 1)) union all
select 'connecting', count(*) from nation where n_nationkey in (0, 1) and n_regionkey in (0, 1) union all
select 'neighbors', count(*) from nation where n_regionkey = 0 union all
select 'ungrouped', 0
"""


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).export("node", "supplier")


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal with cascade by a query: nations of region 0 go, with their edges."""
    g = star_graph(spark, sf_dir)

    def gone(node):
        node.in_group("nation")
        node.attribute("n_regionkey").equal_to(0)
        return node.index()

    g.remove_nodes(gone)
    return g.edge_endpoints().where(F.col("target").startswith("n:")).groupBy("target").agg(F.count("*").alias("n"))


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a graph of users and event types."""
    from .graph import PropertyGraph

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = PropertyGraph(spark)
    g.add_nodes((events.select(F.concat(F.lit("u:"), F.col("user_id")).alias("id")).distinct(), "id"), group="user")
    g.add_nodes((events.select(F.concat(F.lit("t:"), F.col("event_type")).alias("id")).distinct(), "id"), group="type")
    edges = events.select("event_id", F.concat(F.lit("u:"), F.col("user_id")).alias("from"), F.concat(F.lit("t:"), F.col("event_type")).alias("to"), "value", "ts")
    g.add_edges((edges, "from", "to"), group="did", edge_id="event_id")
    return g.query_edges_df(_grouped("did", Discriminator.TARGET_NODE, lambda x: x.attribute("ts").max()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(ENTRIES)
    out |= {name: _unpacked(name, kind) for name, kind in _UNPACKED.items()}
    out |= catalog_operands.queries() | catalog_container.queries()
    return out | {"c01_container": _members, "c02_export": _export, "c03_remove_cascade": _mutated, "c04_events": _flow}


def oracle_sql() -> dict[str, str]:
    out = {name: e.sql for name, e in ENTRIES.items() if e.sql is not None}
    out |= catalog_operands.oracle_sql() | catalog_container.oracle_sql()
    return out | {
        "v10_to_values": "select 'r:' || r_regionkey as id, cast(r_regionkey as bigint) as value from region",
        "c01_container": _MEMBERS_SQL,
        "c02_export": "select 's:' || s_suppkey as node_index, s_acctbal, s_name, cast(s_nationkey as bigint) as s_nationkey, s_suppkey from supplier",
        "c03_remove_cascade": "select 'n:' || n as target, count(*) as n from (select c_nationkey as n from customer union all select s_nationkey from supplier) where n in (select n_nationkey from nation where n_regionkey <> 0) group by 1",
        "c04_events": "select 't:' || event_type as \"group\", max(ts) as value, max_by(event_id, (ts, event_id)) as id from events group by 1",
    }
