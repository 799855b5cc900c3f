"""Snapshots of a graph: two tables and a description, in Parquet or JSON."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .. import schema as S
from ..functions.values import Kind
from .frames import Loaded


def _type(t: S.AttributeDataType) -> dict:
    return {"kinds": sorted(int(k) for k in t.data_type.kinds), "optional": t.data_type.optional, "any": t.data_type.any, "role": t.attribute_type.value}


def _untype(d: dict) -> S.AttributeDataType:
    return S.AttributeDataType(S.DataType(frozenset(Kind(k) for k in d["kinds"]), d["optional"], d["any"]), S.AttributeType(d["role"]))


def _group(g: S.GroupSchema) -> dict:
    return {"nodes": {n: _type(t) for n, t in g.nodes.items()}, "edges": {n: _type(t) for n, t in g.edges.items()}}


def _ungroup(d: dict) -> S.GroupSchema:
    return S.GroupSchema({n: _untype(t) for n, t in d["nodes"].items()}, {n: _untype(t) for n, t in d["edges"].items()})


def save(graph, path: str, format: str = "parquet") -> None:
    """Write ``nodes``, ``edges`` and ``graph`` below ``path``; folders are made."""
    graph._next_id()
    about = {
        "format": format, "groups": graph._groups, "next_edge": graph._next_edge, "disjoint": graph._disjoint, "ends": [list(e) if e else None for e in graph._ends],
        "schema": {"groups": {k: _group(v) for k, v in graph.schema.groups.items()}, "ungrouped": _group(graph.schema.ungrouped), "provided": graph.schema.provided},
        "frames": {e: {"ids": int(f.ids), "attributes": {n: [int(k), flag] for n, (k, flag) in f.attributes.items()}, "schema": f.df.schema.jsonValue()} for e, f in graph._frames.items()},
    }
    for entity, f in graph._frames.items():
        f.df.write.mode("overwrite").format(format).save(f"{path}/{entity}s")
    graph.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/graph")


def load(spark: SparkSession, path: str):
    from pyspark.sql.types import StructType

    from ..graph import PropertyGraph

    about = json.loads(spark.read.text(f"{path}/graph").first()[0])
    schema = S.Schema({k: _ungroup(v) for k, v in about["schema"]["groups"].items()}, _ungroup(about["schema"]["ungrouped"]), about["schema"]["provided"])
    graph = PropertyGraph(spark, schema)
    for entity, d in about["frames"].items():
        df = spark.read.format(about["format"]).schema(StructType.fromJson(d["schema"])).load(f"{path}/{entity}s")
        graph._frames[entity] = Loaded(df, {n: (Kind(k), flag) for n, (k, flag) in d["attributes"].items()}, Kind(d["ids"]))
    graph._groups, graph._next_edge, graph._disjoint = about["groups"], about["next_edge"], about["disjoint"]
    graph._ends = {tuple(e) if e else None for e in about["ends"]}
    return graph
