"""Registered queries for operands: every kind of operand on nodes and edges, choices
and exclusions on each, grouping by attributes, and what values of all kinds do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators.operands import Discriminator, EdgeDirection, MatchMode
from .plans.star import star_graph

OUT = EdgeDirection.OUTGOING
SEGMENT, YEAR, FLAG = (Discriminator.Attribute(n) for n in ("c_mktsegment", "year", "l_returnflag"))

_C, _S, _P = "'c:' || c_custkey", "'s:' || s_suppkey", "'p:' || p_partkey"
_PLACED = "(select o_orderkey * 8 as id, cast(year(o_orderdate) as bigint) as year, o_custkey from orders)"
_BY_SEGMENT = 'c_mktsegment as "group", true as group_present'
_BY_YEAR = 'year as "group", true as group_present'


def _nodes(group, then: Callable, mode: MatchMode = MatchMode.ALL):
    """A query on the members of a group of the star graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def query(root):
            root.in_group(group, mode)
            return then(root)

        return star_graph(spark, sf_dir).query_nodes_df(query)

    return run


def _edges(group: str, then: Callable):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def query(root):
            root.in_group(group)
            return then(root)

        return star_graph(spark, sf_dir).query_edges_df(query)

    return run


def _after(operand, *steps: tuple):
    """The operand once filters and changes are put on it."""
    for step, *args in steps:
        getattr(operand, step)(*args)
    return operand


def _typed(then: Callable):
    """A query on parts with a flag, a duration, a padded text, and a size that is
    Null, missing or there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("id", F.concat(F.lit("p:"), F.col("p_partkey")))
        flag, span = (F.col("p_size") % 2 == 0).alias("even"), F.make_dt_interval(days=F.col("p_size")).alias("span")
        padded = F.concat(F.lit(" \t"), F.col("p_brand"), F.lit("\n ")).alias("padded")
        graph = PropertyGraph(spark)
        graph.add_nodes((part.where("p_size <= 25").select("id", flag, span, padded, F.nullif("p_size", F.lit(7)).alias("size")), "id"), group="small")
        graph.add_nodes((part.where("p_size > 25").select("id", flag, span, padded), "id"), group="large")
        return graph.query_nodes_df(then)

    return run


def _raised(then: Callable):
    """One row: whether the query is refused or fails."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        try:
            star_graph(spark, sf_dir).query_nodes_df(then).collect()
            failed = False
        except Exception as e:  # noqa: BLE001
            failed = "No value to compare" in str(e) or "cannot" in str(e)
        return spark.createDataFrame([(failed,)], "raised boolean")

    return run


def _value_only(run: Callable):
    return lambda spark, sf_dir: run(spark, sf_dir).select("value")


def _mean_groups(edge, verb: str = "mean"):
    return getattr(edge.group_by(FLAG).attribute("l_linenumber"), verb)()


def _moved(edge):
    edge.index().subtract(8)
    return edge.index()


def _int_in_floats(node):
    """Sizes (Int) among account balances (Float) of customers, whole ones only."""
    node.in_group("part")
    other = node.graph._root("node")
    other.in_group("customer")
    balances = other.attribute("c_acctbal")
    balances.round()
    node.attribute("p_size").is_in(balances)
    return node.index()


def _floats_not_in_ints(node):
    node.in_group("customer")
    other = node.graph._root("node")
    other.in_group("part")
    balance = node.attribute("c_acctbal")
    balance.floor()
    balance.is_not_in(other.attribute("p_size"))
    return node.index()


def _mixed_in_text(node):
    """Names and numbers under one verb: the least attribute's value of nations and
    regions, among the names of regions."""
    node.in_group(["nation", "region"], MatchMode.ANY)
    other = node.graph._root("node")
    other.in_group("region")
    node.attributes().min().to_values().is_in(other.attribute("r_name"))
    return node.index()


def _no_scalar(node):
    node.in_group("part")
    none = node.graph._root("node")
    none.in_group("customer")
    low = none.attribute("c_acctbal")
    low.less_than(-1e12)
    node.attribute("p_size").greater_than(low.max())
    return node.index()


_MEANS = "(select l_returnflag, avg(l_linenumber) as m from lineitem group by 1)"

ENTRIES: dict[str, tuple[Callable, str]] = {
    # values on edges
    "o01_edge_values": (_edges("placed", lambda e: e.attribute("year")), f"select id, year as value from {_PLACED}"),
    "o02_edge_values_group": (_edges("placed", lambda e: e.group_by(Discriminator.SOURCE_NODE).attribute("year")), f"select 'c:' || o_custkey as \"group\", id, year as value from {_PLACED}"),
    "o03_edge_values_plain": (_edges("contains", lambda e: _after(_mean_groups(e).ungroup(), ("multiply", 1000), ("round",))), f"select round(m * 1000) as value from {_MEANS}"),
    "o04_edge_value": (_edges("placed", lambda e: e.attribute("year").max()), f"select max(id) as id, year as value from {_PLACED} group by year order by year desc limit 1"),
    "o05_edge_value_group": (_edges("placed", lambda e: e.group_by(YEAR).attribute("year").min()), f"select {_BY_YEAR}, min(id) as id, year as value from {_PLACED} group by year"),
    "o06_edge_value_plain": (_edges("placed", lambda e: e.attribute("year").sum()), f"select cast(sum(year) as bigint) as value from {_PLACED}"),
    "o07_edge_value_plain_group": (_edges("contains", lambda e: _mean_groups(e, "sum")), 'select l_returnflag as "group", true as group_present, cast(sum(l_linenumber) as bigint) as value from lineitem group by 1'),
    # values on nodes
    "o08_node_values_group": (_nodes("customer", lambda n: n.group_by(SEGMENT).attribute("c_acctbal")), f"select {_BY_SEGMENT}, {_C} as id, c_acctbal as value from customer"),
    "o09_node_values_plain": (_nodes("customer", lambda n: n.group_by(SEGMENT).attribute("c_acctbal").count().ungroup()), "select count(*) as value from customer group by c_mktsegment"),
    "o10_node_value_plain_group": (_nodes("customer", lambda n: n.group_by(SEGMENT).attribute("c_acctbal").count()), f"select {_BY_SEGMENT}, count(*) as value from customer group by c_mktsegment"),
    # ids
    "o11_node_indices_group": (_nodes("customer", lambda n: n.group_by(SEGMENT).index()), f"select {_BY_SEGMENT}, {_C} as id from customer"),
    "o12_node_index": (_nodes("supplier", lambda n: n.index().max()), f"select max({_S}) as value from supplier"),
    "o13_node_index_group": (_nodes("customer", lambda n: n.group_by(SEGMENT).index().min()), f"select {_BY_SEGMENT}, min({_C}) as value from customer group by c_mktsegment"),
    "o14_edge_indices_group": (_edges("placed", lambda e: e.group_by(YEAR).index()), f"select {_BY_YEAR}, id from {_PLACED}"),
    "o15_edge_index": (_edges("placed", lambda e: e.index().min()), f"select min(id) as value from {_PLACED}"),
    "o16_edge_index_group": (_edges("placed", lambda e: e.group_by(YEAR).index().max()), f"select {_BY_YEAR}, max(id) as value from {_PLACED} group by year"),
    "o17_index_ungrouped": (_edges("placed", lambda e: e.group_by(YEAR).index().max().ungroup()), f"select max(id) as id from {_PLACED} group by year"),
    # attribute names
    "o18_node_tree_group": (_nodes("region", lambda n: n.group_by(Discriminator.Attribute("r_name")).attributes()), "select r_name as \"group\", true as group_present, 'r:' || r_regionkey as id, ['r_name', 'r_regionkey'] as attributes from region"),
    "o19_edge_tree": (_edges("placed", lambda e: e.attributes()), f"select id, ['year'] as attributes from {_PLACED}"),
    "o20_edge_tree_group": (_edges("placed", lambda e: e.group_by(YEAR).attributes()), f"select {_BY_YEAR}, id, ['year'] as attributes from {_PLACED}"),
    "o21_node_names_group": (_nodes("region", lambda n: n.group_by(Discriminator.Attribute("r_name")).attributes().max()), "select r_name as \"group\", true as group_present, 'r:' || r_regionkey as id, 'r_regionkey' as value from region"),
    "o22_node_names_ungrouped": (_nodes("region", lambda n: n.group_by(Discriminator.Attribute("r_name")).attributes().max().max().ungroup()), "select 'r:' || r_regionkey as id, 'r_regionkey' as value from region"),
    "o23_edge_names": (_edges("contains", lambda e: e.attributes().min().count()), "select count(*) as value from lineitem"),
    "o24_edge_names_group": (_edges("placed", lambda e: e.group_by(YEAR).attributes().max()), f"select {_BY_YEAR}, id, 'year' as value from {_PLACED}"),
    "o25_node_name": (_nodes("nation", lambda n: n.attributes().max().max()), "select max('n:' || n_nationkey) as id, 'n_regionkey' as value from nation"),
    "o26_node_name_group": (_nodes("customer", lambda n: n.group_by(SEGMENT).attributes().max().max()), f"select {_BY_SEGMENT}, max({_C}) as id, 'c_nationkey' as value from customer group by c_mktsegment"),
    "o27_node_name_plain": (_nodes("nation", lambda n: n.attributes().max().count()), "select count(*) as value from nation"),
    "o28_node_name_plain_group": (_nodes("customer", lambda n: n.group_by(SEGMENT).attributes().max().count()), f"select {_BY_SEGMENT}, count(*) as value from customer group by c_mktsegment"),
    "o29_edge_name": (_edges("placed", lambda e: e.attributes().max().min()), f"select min(id) as id, 'year' as value from {_PLACED}"),
    "o30_edge_name_group": (_edges("placed", lambda e: e.group_by(YEAR).attributes().max().max()), f"select {_BY_YEAR}, max(id) as id, 'year' as value from {_PLACED} group by year"),
    "o31_edge_name_plain_group": (_edges("placed", lambda e: e.group_by(YEAR).attributes().max().count()), f"select {_BY_YEAR}, count(*) as value from {_PLACED} group by year"),
    # choices
    "x01_either_or_grouped": (_nodes("customer", lambda n: _after(n.group_by(SEGMENT), ("either_or", lambda g: g.attribute("c_acctbal").is_max(), lambda g: g.attribute("c_acctbal").is_min())).index()), f"select {_BY_SEGMENT}, {_C} as id from (select *, max(c_acctbal) over (partition by c_mktsegment) as hi, min(c_acctbal) over (partition by c_mktsegment) as lo from customer) where c_acctbal in (hi, lo)"),
    "x02_either_or_indices": (_nodes("nation", lambda n: _after(n.index(), ("either_or", lambda i: i.ends_with("1"), lambda i: i.starts_with("n:2")))), "select 'n:' || n_nationkey as id from nation where suffix('n:' || n_nationkey, '1') or starts_with('n:' || n_nationkey, 'n:2')"),
    "x03_either_or_edge_values": (_edges("placed", lambda e: _after(e.attribute("year"), ("either_or", lambda v: v.less_than(1993), lambda v: (v.greater_than(1997), v.add(1000))))), f"select id, case when year < 1993 then year else year + 1000 end as value from {_PLACED} where year < 1993 or year > 1997"),
    "x04_either_or_plain_values": (_edges("contains", lambda e: _after(_mean_groups(e, "count").ungroup(), ("either_or", lambda v: v.greater_than(0), lambda v: v.less_than(10**9)))), "select count(*) as value from lineitem group by l_returnflag union all select count(*) from lineitem group by l_returnflag"),
    "x05_either_or_names": (_nodes("region", lambda n: _after(n.attributes().max(), ("either_or", lambda a: a.starts_with("x"), lambda a: (a.ends_with("key"), a.uppercase())))), "select 'r:' || r_regionkey as id, 'R_REGIONKEY' as value from region"),
    "x06_either_or_tree": (_nodes("supplier", lambda n: _after(n.attributes(), ("either_or", lambda t: t.ends_with("key"), lambda t: t.equal_to("s_name")))), f"select {_S} as id, ['s_name', 's_nationkey', 's_suppkey'] as attributes from supplier", "sorted"),
    "x07_either_or_value": (_nodes("part", lambda n: _after(n.attribute("p_size").max(), ("either_or", lambda v: v.greater_than(10**6), lambda v: v.multiply(2)))), f"select max({_P}) as id, cast(p_size * 2 as bigint) as value from part where p_size = (select max(p_size) from part) group by p_size"),
    "x08_exclude_edge_indices": (_edges("lives", lambda e: _after(e.index(), ("exclude", lambda i: i.greater_than(400)))), "select c_custkey * 8 + 3 as id from customer where c_custkey * 8 + 3 <= 400"),
    "x09_exclude_values": (_nodes("part", lambda n: _after(n.attribute("p_size"), ("exclude", lambda v: v.greater_than(10)))), f"select {_P} as id, cast(p_size as bigint) as value from part where p_size <= 10"),
    "x10_exclude_grouped_values": (_nodes("customer", lambda n: _after(n.group_by(SEGMENT).attribute("c_acctbal"), ("exclude", lambda v: v.is_max()))), f"select {_BY_SEGMENT}, {_C} as id, c_acctbal as value from (select *, max(c_acctbal) over (partition by c_mktsegment) as hi from customer) where c_acctbal < hi"),
    "x11_exclude_edges": (_edges("placed", lambda e: _after(e, ("exclude", lambda x: x.attribute("year").less_than(1996))).index()), f"select id from {_PLACED} where year >= 1996"),
    "x12_exclude_tree": (_nodes("supplier", lambda n: _after(n.attributes(), ("exclude", lambda t: t.ends_with("key")))), f"select {_S} as id, ['s_acctbal', 's_name'] as attributes from supplier"),
    # grouping
    "g10_edge_attribute": (_edges("contains", lambda e: e.group_by(FLAG).index().count()), 'select l_returnflag as "group", true as group_present, count(*) as value from lineitem group by 1'),
    "g11_missing_is_a_group": (_nodes(["customer", "supplier"], lambda n: n.group_by(SEGMENT).index().count(), MatchMode.ANY), f"select {_BY_SEGMENT}, count(*) as value from customer group by c_mktsegment union all select null, false, count(*) from supplier"),
    "g12_null_and_missing": (_typed(lambda n: n.group_by(Discriminator.Attribute("size")).index().count()), 'select cast(nullif(p_size, 7) as bigint) as "group", true as group_present, count(*) as value from part where p_size <= 25 group by 1 union all select null, false, count(*) from part where p_size > 25'),
    "g13_emptied_groups_stay": (_nodes("customer", lambda n: _after(n.group_by(SEGMENT).attribute("c_acctbal"), ("greater_than", 9990)).count()), f"select {_BY_SEGMENT}, count(*) filter (c_acctbal > 9990) as value from customer group by c_mktsegment"),
    "g14_gate_closed": (_nodes("part", lambda n: (n.attribute("p_size").mean().greater_than(10**6), n.index())[1]), f"select {_P} as id from part where false"),
    # rules
    "r01_attribute_implies_existence": (_nodes(["customer", "supplier"], lambda n: (n.attribute("s_acctbal"), n.index())[1], MatchMode.ANY), f"select {_S} as id from supplier"),
    "r02_index_arithmetic_moves_the_parent": (_edges("lives", _moved), "select c_custkey * 8 + 3 as id from customer where c_custkey * 8 + 3 in (select c_custkey * 8 - 5 from customer)"),
    "r03_empty_scalar_raises": (_raised(_no_scalar), "select true as raised"),
    "r04_random_is_a_member": (_value_only(_nodes("part", lambda n: _after(n.attribute("p_size").random(), ("greater_than", 0), ("multiply", 0)))), "select 0::bigint as value"),
    "r05_random_name": (_value_only(_nodes("region", lambda n: _after(n.attributes().random(), ("slice", 0, 2)))), "select 'r_' as value from region"),
    # kinds
    "k01_is_bool": (_typed(lambda n: (n.attribute("even").is_bool(), n.index())[1]), f"select {_P} as id from part"),
    "k02_is_duration": (_typed(lambda n: (n.in_group("small"), n.attribute("span").is_duration(), n.index())[2]), f"select {_P} as id from part where p_size <= 25"),
    "k03_is_null": (_typed(lambda n: (n.attribute("size").is_null(), n.index())[1]), f"select {_P} as id from part where p_size = 7"),
    "k04_bool_equality": (_typed(lambda n: (n.attribute("even").equal_to(True), n.index())[1]), f"select {_P} as id from part where p_size % 2 = 0"),
    "k05_null_comparison": (_typed(lambda n: (n.attribute("size").greater_than_or_equal_to(None), n.index())[1]), f"select {_P} as id from part where p_size = 7"),
    "k06_null_is_not_less": (_typed(lambda n: (n.attribute("size").less_than(9), n.index())[1]), f"select {_P} as id from part where p_size < 9 and p_size <> 7"),
    "k07_trim": (_typed(lambda n: _after(n.attribute("padded"), ("trim",))), f"select {_P} as id, p_brand as value from part"),
    "k08_trim_start": (_typed(lambda n: _after(n.attribute("padded"), ("trim_start",))), f"select {_P} as id, p_brand || chr(10) || ' ' as value from part"),
    "k09_trim_end": (_typed(lambda n: _after(n.attribute("padded"), ("trim_end",))), f"select {_P} as id, ' ' || chr(9) || p_brand as value from part"),
    "k10_exact_power": (_nodes("part", lambda n: _after(n.attribute("p_size"), ("add", 2), ("power", 11))), f"select {_P} as id, {' * '.join(['(p_size + 2)::bigint'] * 11)} as value from part"),
    "k11_is_in_across_kinds": (lambda spark, sf_dir: star_graph(spark, sf_dir).query_nodes_df(_int_in_floats), f"select {_P} as id from part where p_size in (select round(c_acctbal) from customer)"),
    "k12_is_not_in_across_kinds": (lambda spark, sf_dir: star_graph(spark, sf_dir).query_nodes_df(_floats_not_in_ints), f"select {_C} as id from customer where floor(c_acctbal) not in (select p_size from part)"),
    "k13_mixed_in_text": (lambda spark, sf_dir: star_graph(spark, sf_dir).query_nodes_df(_mixed_in_text), "select 'r:' || r_regionkey as id from region"),
}


def _listed(run: Callable):
    """A query whose lists have no order of their own."""
    return lambda spark, sf_dir: run(spark, sf_dir).withColumn("attributes", F.array_sort("attributes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _listed(e[0]) if len(e) > 2 else e[0] for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e[1] for name, e in ENTRIES.items() if e[1] is not None}
