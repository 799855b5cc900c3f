"""Profiles of groups: counts, and per attribute what its type calls for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from . import schema as S
from .functions import values as V
from .functions.values import Kind
from .operators.operands import python_value
from .plans.rows import GROUPS


@dataclass
class AttributeOverview:
    data_type: S.DataType
    attribute_type: S.AttributeType
    data: dict


@dataclass
class EntityOverview:
    count: int
    attributes: dict[str, AttributeOverview] = field(default_factory=dict)


@dataclass
class GroupOverview:
    nodes: EntityOverview
    edges: EntityOverview

    def __str__(self) -> str:
        return "\n".join(_table(name, e) for name, e in (("Nodes", self.nodes), ("Edges", self.edges)))


@dataclass
class Overview:
    ungrouped: GroupOverview
    groups: dict[str, GroupOverview]

    def __str__(self) -> str:
        return "\n\n".join([f"[ungrouped]\n{self.ungrouped}", *[f"[{g}]\n{o}" for g, o in self.groups.items()]])


def _table(name: str, e: EntityOverview, width: int = 80) -> str:
    lines = [f"{name}: {e.count}"]
    for n, a in sorted(e.attributes.items()):
        shown = ", ".join(f"{k}: {v}" for k, v in a.data.items())
        lines.append(f"  {n} | {a.data_type} | {a.attribute_type.value} | {shown if len(shown) <= width else shown[: width - 3] + '...'}")
    return "\n".join(lines)


def _aggregates(kind: S.AttributeType, present, val):
    """Aggregate expressions of one attribute, by name."""
    if kind == S.AttributeType.CATEGORICAL:
        distinct = F.collect_set(F.when(present, V.tagged(val)))
        return {"distinct_values": F.array_sort(distinct)}
    if kind == S.AttributeType.UNSTRUCTURED:
        return {"distinct_count": F.count_distinct(F.when(present, F.struct(V.tagged(val))))}
    number = F.coalesce(val.col["f"], val.col["i"].cast("double")) if val.kind == Kind.MIXED and kind == S.AttributeType.CONTINUOUS else val.col
    number = F.coalesce(val.col["ts"].cast("string"), val.col["d"].cast("string")) if val.kind == Kind.MIXED and kind == S.AttributeType.TEMPORAL else number
    out = {"min": F.min(F.when(present, number)), "max": F.max(F.when(present, number))}
    if kind == S.AttributeType.CONTINUOUS:
        out["mean"] = F.avg(F.when(present, number))
    return out


def _entity(graph, entity: str, schema: S.AttributeSchema, group: str | None) -> EntityOverview:
    """One aggregate job for all attributes of a group."""
    f = graph._frames[entity]
    members = f.df.where(F.size(GROUPS) == 0) if group is None else f.df.where(F.array_contains(GROUPS, group))
    columns, names = [F.count(F.lit(1)).alias("n")], []
    for i, (n, t) in enumerate(sorted(schema.items())):
        present, val = graph.attribute_of(entity, n)
        for k, e in _aggregates(t.attribute_type, present, val).items():
            names.append((n, k, f"c{i}_{k}"))
            columns.append(e.alias(names[-1][2]))
    row = members.agg(*columns).first()
    out = EntityOverview(row["n"])
    for n, k, c in names:
        t = schema[n]
        value = [python_value(x) for x in row[c]] if isinstance(row[c], list) else row[c]
        out.attributes.setdefault(n, AttributeOverview(t.data_type, t.attribute_type, {})).data[k] = value
    return out


def group_overview(graph, group: str | None) -> GroupOverview:
    schema = graph.schema.ungrouped if group is None else graph.schema.groups.get(group, S.GroupSchema())
    return GroupOverview(_entity(graph, "node", schema.nodes, group), _entity(graph, "edge", schema.edges, group))


def overview(graph) -> Overview:
    return Overview(group_overview(graph, None), {g: group_overview(graph, g) for g in graph.groups()})
