"""Connected components of a link table, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, write_scratch

#: Links that one task may hold at once.
TASK_LINKS = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links with the least node reachable through them."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook to the least neighbour, then halve the paths
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task, replaced by links to least nodes; bounded by blocks."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate((a, batch.column(0).to_numpy()))
        b = np.concatenate((b, batch.column(1).to_numpy()))
        if len(a) >= 2 * TASK_LINKS:
            a, b = local_roots(a, b)
            if len(a) >= TASK_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a):
        a, b = local_roots(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected_components(links: DataFrame, task_links: int = TASK_LINKS, stored: bool = False) -> DataFrame:
    """links (a, b: bigint) -> (id, component): component is the least id reachable.

    Each task first contracts at most ``task_links`` links.  If that was one
    task, it is the answer; else alternating large-star and small-star rounds
    run over Parquet tables in the shared folder until nothing changes.  Least
    neighbours come from aggregates with map-side combine, and the join back
    has unique keys on one side, so hubs do not meet in one task.

    No links give no rows; self and repeated links are harmless.  ``stored``
    links are a table already and are not written once more.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    spark = links.sparkSession
    raw, raw_path = (links, None) if stored else write_scratch(links, "links")
    n = raw.count()
    parts = max(1, -(-n // task_links))
    edges, path = write_scratch(raw.repartition(parts).mapInArrow(_contract, "a bigint, b bigint"), "contracted")
    if raw_path:
        drop_paths(spark, raw_path)
    if parts == 1:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    edges, last = edges.where("a > b"), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, new_path = write_scratch(small.toDF("a", "b"), "stars")
        drop_paths(spark, path)
        path = new_path
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
