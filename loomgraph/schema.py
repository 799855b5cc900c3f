"""Data types, attribute types and schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from .errors import SchemaError
from .functions.values import Kind


@dataclass(frozen=True)
class DataType:
    """What values an attribute may have: kinds, and whether Null or no value is fine."""

    kinds: frozenset[Kind] = frozenset()
    optional: bool = False
    any: bool = False

    def merge(self, other: DataType) -> DataType:
        """The narrowest type that takes the values of both."""
        return DataType(self.kinds | other.kinds, self.optional or other.optional or Kind.NULL in self.kinds | other.kinds and len(self.kinds | other.kinds) > 1, self.any or other.any)

    def accepts(self, other: DataType) -> bool:
        """Whether every value of ``other`` is one of this type."""
        if self.any:
            return True
        null_ok = self.optional or Kind.NULL in self.kinds
        return not other.any and (other.kinds - {Kind.NULL}) <= self.kinds and (null_ok or not (other.optional or Kind.NULL in other.kinds))

    def __str__(self) -> str:
        if self.any:
            return "Any"
        names = [k.name.title().replace("time", "Time") for k in sorted(self.kinds - ({Kind.NULL} if self.optional else set()))]
        inner = names[0] if len(names) == 1 else f"Union({', '.join(names)})"
        return f"Option({inner})" if self.optional else inner


def _single(kind: Kind) -> DataType:
    return DataType(frozenset({kind}))


String, Int, Float, Bool = (_single(k) for k in (Kind.STRING, Kind.INT, Kind.FLOAT, Kind.BOOL))
DateTime, Duration, Null = (_single(k) for k in (Kind.DATETIME, Kind.DURATION, Kind.NULL))
Any = DataType(any=True)


def Union(*types: DataType) -> DataType:  # noqa: N802
    out = types[0]
    for t in types[1:]:
        out = out.merge(t)
    return out


def Option(of: DataType) -> DataType:  # noqa: N802
    return DataType(of.kinds, True, of.any)


class AttributeType(Enum):
    CATEGORICAL = "Categorical"
    CONTINUOUS = "Continuous"
    TEMPORAL = "Temporal"
    UNSTRUCTURED = "Unstructured"

    @staticmethod
    def infer(t: DataType) -> AttributeType:
        kinds = t.kinds - {Kind.NULL}
        if t.any or not kinds:
            return AttributeType.UNSTRUCTURED
        found = {_INFERRED[k] for k in kinds}
        out = found.pop()
        while found:
            out = out.merge(found.pop())
        return out

    def merge(self, other: AttributeType) -> AttributeType:
        """Equal types stay; Categorical wins over all but Unstructured."""
        if self == other:
            return self
        pair = {self, other}
        if AttributeType.CATEGORICAL in pair and AttributeType.UNSTRUCTURED not in pair:
            return AttributeType.CATEGORICAL
        return AttributeType.UNSTRUCTURED

    def check(self, t: DataType) -> None:
        """Continuous needs numbers, Temporal needs times or durations."""
        allowed = _ALLOWED.get(self)
        if allowed is not None and (t.any or not t.kinds <= allowed | {Kind.NULL}):
            raise SchemaError(f"a {self.value} attribute cannot be {t}")


_INFERRED = {
    Kind.STRING: AttributeType.UNSTRUCTURED, Kind.INT: AttributeType.CONTINUOUS, Kind.FLOAT: AttributeType.CONTINUOUS,
    Kind.BOOL: AttributeType.CATEGORICAL, Kind.DATETIME: AttributeType.TEMPORAL, Kind.DURATION: AttributeType.TEMPORAL,
}
_ALLOWED = {AttributeType.CONTINUOUS: {Kind.INT, Kind.FLOAT}, AttributeType.TEMPORAL: {Kind.DATETIME, Kind.DURATION}}


@dataclass(frozen=True)
class AttributeDataType:
    """A data type with the role that the attribute plays."""

    data_type: DataType
    attribute_type: AttributeType | None = None

    def __post_init__(self):
        if self.attribute_type is None:
            object.__setattr__(self, "attribute_type", AttributeType.infer(self.data_type))
        self.attribute_type.check(self.data_type)

    def merge(self, other: AttributeDataType) -> AttributeDataType:
        return AttributeDataType(self.data_type.merge(other.data_type), self.attribute_type.merge(other.attribute_type))


AttributeSchema = dict[str, AttributeDataType]


def validate(schema: AttributeSchema, seen: AttributeSchema, what: str) -> None:
    """Refuse unknown attributes, missing ones without Option, and wrong types."""
    for name, found in seen.items():
        if name not in schema:
            raise SchemaError(f"{what}: attribute {name!r} is not in the schema")
        if not schema[name].data_type.accepts(found.data_type):
            raise SchemaError(f"{what}: attribute {name!r} is {found.data_type}, expected {schema[name].data_type}")
    for name, wanted in schema.items():
        if name not in seen and not wanted.data_type.optional and not wanted.data_type.any:
            raise SchemaError(f"{what}: attribute {name!r} of type {wanted.data_type} is missing")


def update(schema: AttributeSchema, seen: AttributeSchema, first: bool) -> AttributeSchema:
    """The schema widened by new data; attributes missing on either side become Option."""
    out = dict(schema)
    for name, found in seen.items():
        if name in out:
            out[name] = out[name].merge(found)
        else:
            out[name] = found if first else AttributeDataType(Option(found.data_type), found.attribute_type)
    for name in set(schema) - set(seen):
        out[name] = AttributeDataType(Option(out[name].data_type), out[name].attribute_type)
    return out


@dataclass
class GroupSchema:
    nodes: AttributeSchema = field(default_factory=dict)
    edges: AttributeSchema = field(default_factory=dict)

    def of(self, entity: str) -> AttributeSchema:
        return self.nodes if entity == "node" else self.edges

    def with_(self, entity: str, attributes: AttributeSchema) -> GroupSchema:
        return GroupSchema(attributes, self.edges) if entity == "node" else GroupSchema(self.nodes, attributes)


@dataclass
class Schema:
    """Schemas of all groups and of ungrouped entities; ``provided`` refuses
    data that does not fit, otherwise the schema grows."""

    groups: dict[str, GroupSchema] = field(default_factory=dict)
    ungrouped: GroupSchema = field(default_factory=GroupSchema)
    provided: bool = False

    @staticmethod
    def infer(graph) -> Schema:
        """The schema that a graph's data alone gives."""
        return graph.infer_schema()

    def group(self, name: str) -> GroupSchema:
        if name not in self.groups:
            raise SchemaError(f"group {name!r} has no schema")
        return self.groups[name]

    def add_group(self, name: str, schema: GroupSchema) -> None:
        if name in self.groups:
            raise SchemaError(f"group {name!r} has a schema already")
        self.groups[name] = schema

    def remove_group(self, name: str) -> None:
        self.groups.pop(name, None)

    def set_attribute(self, entity: str, name: str, t: AttributeDataType, group: str | None = None) -> None:
        self._of(group).of(entity)[name] = t

    def update_attribute(self, entity: str, name: str, t: AttributeDataType, group: str | None = None) -> None:
        known = self._of(group).of(entity)
        known[name] = known[name].merge(t) if name in known else t

    def remove_attribute(self, entity: str, name: str, group: str | None = None) -> None:
        self._of(group).of(entity).pop(name, None)

    def _of(self, group: str | None) -> GroupSchema:
        return self.ungrouped if group is None else self.groups.setdefault(group, GroupSchema())

    def freeze(self) -> None:
        self.provided = True

    def unfreeze(self) -> None:
        self.provided = False

    def copy(self) -> Schema:
        return Schema({k: GroupSchema(dict(v.nodes), dict(v.edges)) for k, v in self.groups.items()}, GroupSchema(dict(self.ungrouped.nodes), dict(self.ungrouped.edges)), self.provided)
