"""The star-schema tables as a graph: one node group per entity table, edges from keys."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph


_BUILT: dict[tuple[str, str], PropertyGraph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of a folder; its plan (no data) is built once per session."""
    key = (f"{spark.sparkContext.applicationId}/{id(spark)}", sf_dir)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _build(spark, sf_dir)
    return _BUILT[key].clone()


def _build(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes ``c:1``, ``o:1``, ``p:1``, ``s:1``, ``n:1``, ``r:1`` with their columns as
    attributes.  Edge ids are numbers below a tag; the line item has no unique
    key, so its edges carry row numbers by key, part and supplier."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda letter, column: F.concat(F.lit(f"{letter}:"), F.col(column).cast("string"))
    customer, orders, part, supplier, nation, region, lineitem = map(read, ("customer", "orders", "part", "supplier", "nation", "region", "lineitem"))
    graph = PropertyGraph(spark)
    for letter, group, df in (("c", "customer", customer), ("o", "order", orders), ("p", "part", part), ("s", "supplier", supplier), ("n", "nation", nation), ("r", "region", region)):
        graph.add_nodes((df.withColumn("id", key(letter, df.columns[0])), "id"), group=group)
    tagged = lambda number, tag: (number.cast("bigint") * 8 + tag).alias("edge")
    placed = orders.select(tagged(F.col("o_orderkey"), 0), key("c", "o_custkey").alias("from"), key("o", "o_orderkey").alias("to"), F.year("o_orderdate").alias("year"))
    line = F.hash("l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity").cast("bigint") + 2147483648
    number = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line).bitwiseAND((1 << 59) - 1)
    contains = lineitem.select(tagged(number, 1), key("o", "l_orderkey").alias("from"), key("p", "l_partkey").alias("to"), "l_quantity", "l_returnflag", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    offers = lineitem.select("l_partkey", "l_suppkey").distinct().select(tagged(F.col("l_partkey") * 100_000_000 + F.col("l_suppkey"), 2), key("p", "l_partkey").alias("from"), key("s", "l_suppkey").alias("to"))
    lives = customer.select(tagged(F.col("c_custkey"), 3), key("c", "c_custkey").alias("from"), key("n", "c_nationkey").alias("to"))
    based = supplier.select(tagged(F.col("s_suppkey"), 4), key("s", "s_suppkey").alias("from"), key("n", "s_nationkey").alias("to"))
    lies = nation.select(tagged(F.col("n_nationkey"), 5), key("n", "n_nationkey").alias("from"), key("r", "n_regionkey").alias("to"))
    tables = (
        ("placed", placed, "customer", "order"), ("contains", contains, "order", "part"), ("offers", offers, "part", "supplier"),
        ("lives", lives, "customer", "nation"), ("based", based, "supplier", "nation"), ("lies", lies, "nation", "region"),
    )
    for group, df, source, target in tables:
        graph.add_edges((df, "from", "to"), group=group, edge_id="edge", ends=(source, target))
    return graph
