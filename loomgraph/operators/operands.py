"""Query operands.

A query function gets a root operand and calls verbs on it.  A verb that
filters or transforms is recorded; a verb that leads elsewhere (``attribute``,
``neighbors``, ``max`` and so on) returns a new operand.  That child starts
from a snapshot of its parent, while the parent refers to the child itself:
filters put on the child later also filter the parent, not the other way round.

Nothing runs until the returned operand is compiled.  Operations on one row
(most comparisons, arithmetic, text functions, and choices between them)
become one filter expression; the others become semi-joins, aggregates and
one-row joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import values as V
from ..functions.values import Kind, Val
from ..plans.rows import DST, GROUPS, ID, PARENT, SRC, TREE, VALUE, Rows, quoted


class EdgeDirection(Enum):
    INCOMING = "incoming"
    OUTGOING = "outgoing"
    BOTH = "both"


class MatchMode(Enum):
    ANY = "any"
    ALL = "all"


class Discriminator:
    """What ``group_by`` groups on."""

    SOURCE_NODE = "source"
    TARGET_NODE = "target"
    PARALLEL = "parallel"

    class Attribute:
        def __init__(self, name: str | int):
            self.name = name


NodeGroupBy = EdgeGroupBy = Discriminator


# --- recorded operations


class Op:
    """A recorded operation.  ``rowwise`` is None where rows must meet."""

    def apply(self, rows: Rows) -> Rows:
        raise NotImplementedError

    def rowwise(self, rows: Rows, val: Val | None) -> tuple[Column, Val | None] | None:
        return None

    def local(self) -> bool:
        """Whether each entity is judged alone, whatever other rows there are."""
        return True

    def clone(self) -> Op:
        return self


class Filter(Op):
    """A predicate on the row, or on the value if there is one."""

    def __init__(self, test: Callable[[Rows, Val | None], Column]):
        self.test = test

    def apply(self, rows):
        return rows.where(self.test(rows, rows.val))

    def rowwise(self, rows, val):
        return self.test(rows, val), val


class InGroup(Filter):
    """A group filter; what follows knows that rows are of these groups only."""

    def __init__(self, names: list[str], mode: MatchMode):
        super().__init__(lambda _rows, _val: _combine([F.array_contains(GROUPS, F.lit(n)) for n in names], mode))
        self.names = frozenset(names)

    def apply(self, rows):
        within = self.names if rows.within is None else rows.within & self.names
        return replace(super().apply(rows), within=within)


class Transform(Op):
    """A new value from the old one."""

    def __init__(self, change: Callable[[Val], Val]):
        self.change = change

    def apply(self, rows):
        return rows.with_value(self.change(rows.val))

    def rowwise(self, rows, val):
        return F.lit(True), self.change(val)


class WithScalar(Op):
    """A comparison or arithmetic with the one value of another operand."""

    def __init__(self, other: Operand, use: Callable[[Val, Val], Column | Val]):
        self.other, self.use = other, use

    def apply(self, rows):
        scalar = self.other.rows()
        got = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("No value to compare")).cast(V.spark_type(scalar.val.kind))).otherwise(F.first(scalar.val.col))
        one = scalar.df.agg(got.alias("__s"))
        joined = replace(rows, df=rows.df.crossJoin(F.broadcast(one)))  # one row
        out = self.use(rows.val, Val(scalar.val.kind, F.col("__s")))
        joined = joined.with_value(out) if isinstance(out, Val) else joined.where(out)
        return replace(joined, df=joined.df.drop("__s"))

    def clone(self):
        return WithScalar(self.other._snapshot(), self.use)


class WithMany(Op):
    """Membership in the values of another operand."""

    def __init__(self, other: Operand, inside: bool):
        self.other, self.inside = other, inside

    def apply(self, rows):
        many = self.other.rows()
        how = "left_semi" if self.inside else "left_anti"
        if many.val.kind == rows.val.kind != Kind.MIXED:
            listed = many.df.select(many.val.col.alias("__m"))
            return replace(rows, df=rows.df.join(listed, rows.val.col.eqNullSafe(F.col("__m")), how))
        listed = many.df.select(V.join_key(many.val).alias("__m"))  # one key for all kinds, for a join on equal keys
        return replace(rows, df=rows.df.join(listed, V.join_key(rows.val) == F.col("__m"), how))

    def clone(self):
        return WithMany(self.other._snapshot(), self.inside)


class Extreme(Op):
    """Rows equal to the greatest or least value (of their group)."""

    def __init__(self, greatest: bool):
        self.greatest = greatest

    def apply(self, rows):
        value, kind = V.extreme(rows.val, self.greatest)
        best = rows.df.groupBy(*[quoted(k).alias(f"__b{i}") for i, k in enumerate(rows.keys)]).agg(value.alias("__best"))
        same = V.equals(rows.val, Val(kind, F.col("__best")))
        if not rows.keys:
            return replace(rows, df=rows.df.crossJoin(F.broadcast(best)).where(same).drop("__best"))
        for i, k in enumerate(rows.keys):
            same = quoted(k).eqNullSafe(F.col(f"__b{i}")) & same
        return replace(rows, df=rows.df.join(best, same, "left_semi"))

    def local(self):
        return False


class Child(Op):
    """The parent's side of a child: rows that the child's own filters leave.

    ``link``: (own column, child's column) pairs that tell which rows those are.
    """

    def __init__(self, child: Operand, project: Callable[[Rows], Rows], link: list[tuple[str, str]], direct: Callable[[Rows], tuple[Column, Val | None]] | None = None, exists: Callable[[Rows], tuple[Rows, str, str]] | None = None):
        self.child, self.project, self.link, self.direct, self.exists = child, project, link, direct, exists

    def apply(self, rows):
        got = self.rowwise(rows, rows.val)
        if got is not None:
            return rows.where(got[0])
        if self.exists is not None and not rows.keys and self.child.local():
            # what the child leads to is judged alone, so it is enough to semi-join
            # with all that qualifies, without first joining the parent's rows
            start, own, theirs = self.exists(rows)
            return rows.matching(self.child.forward(start).df, [(own, theirs)])
        left = self.child.forward(self.project(rows))
        link = [(a, VALUE) if self.child.moves_ids() and b == ID else (a, b) for a, b in self.link]
        return rows.matching(left.df, link)

    def rowwise(self, rows, val):
        if self.direct is None or self.child.moves_ids():
            return None
        present, start = self.direct(rows)
        got = self.child.rowwise(rows, start)
        return None if got is None else (present & got[0], val)

    def local(self):
        return self.child.local()

    def clone(self):
        return Child(self.child._snapshot(), self.project, self.link, self.direct, self.exists)


class Gate(Op):
    """A scalar below a stream: its filters keep all rows (of a group) or none."""

    def __init__(self, child: Operand, project: Callable[[Rows], Rows]):
        self.child, self.project = child, project

    def apply(self, rows):
        if not self.child.ops:
            return rows
        return rows.matching(self.child.forward(self.project(rows)).df, [])

    def rowwise(self, rows, val):
        return None if self.child.ops else (F.lit(True), val)

    def local(self):
        return not self.child.ops

    def clone(self):
        return Gate(self.child._snapshot(), self.project)


class EitherOr(Op):
    """Rows of either branch.  Ids come once; values with ids take the first
    branch that has them; values without ids come from both branches."""

    def __init__(self, left: Operand, right: Operand):
        self.left, self.right = left, right

    def apply(self, rows):
        got = self.rowwise(rows, rows.val)
        if got is not None:
            kept = rows.where(got[0])
            kept = kept if got[1] is rows.val or rows.val is None else kept.with_value(got[1])
            return _once(kept) if self.left.role == "indices" and not self.left.one else kept
        a, b = self.left.forward(rows), self.right.forward(rows)
        if rows.val is None:
            both = a.df.select(ID, *map(quoted, rows.keys)).union(b.df.select(ID, *map(quoted, rows.keys))).distinct()
            return rows.matching(both, [(ID, ID)])
        kind = V.common_kind(a.val.kind, b.val.kind)
        a, b = a.with_value(V.as_kind(a.val, kind)), b.with_value(V.as_kind(b.val, kind))
        out = replace(rows, val=Val(kind, F.col(VALUE)))
        if self.left.one:
            return replace(out, df=a.df.unionByName(b.matching(a.df, [], "left_anti").df, allowMissingColumns=True))
        if rows.indexed and self.left.role != "indices":
            return replace(out, df=a.df.unionByName(b.matching(a.df, [(ID, ID)], "left_anti").df, allowMissingColumns=True))
        both = replace(out, df=a.df.unionByName(b.df, allowMissingColumns=True))
        return both if self.left.role == "values" else _once(both)

    def rowwise(self, rows, val):
        if val is not None and self.left.role == "values" and not rows.indexed and not self.left.one:
            return None
        a, b = self.left.rowwise(rows, val), self.right.rowwise(rows, val)
        if a is None or b is None or self.left.moves_ids() or self.right.moves_ids():
            return None
        if val is None or (a[1] is val and b[1] is val):
            return a[0] | b[0], val
        if not rows.indexed and not self.left.one:
            return None
        kind = V.common_kind(a[1].kind, b[1].kind)
        return a[0] | b[0], Val(kind, F.when(a[0], V.as_kind(a[1], kind).col).otherwise(V.as_kind(b[1], kind).col))

    def local(self):
        return self.left.local() and self.right.local()

    def clone(self):
        return EitherOr(self.left._snapshot(), self.right._snapshot())


def _once(rows: Rows) -> Rows:
    """Each value once (per group)."""
    df = rows.df.select(*map(quoted, rows.keys), F.col(VALUE)).distinct()
    return replace(rows, df=df.withColumn(ID, F.col(VALUE)) if ID in rows.df.columns else df)


class Exclude(Op):
    def __init__(self, inner: Operand):
        self.inner = inner

    def apply(self, rows):
        got = self.rowwise(rows, rows.val)
        if got is not None:
            kept = rows.where(got[0])
        else:
            gone = self.inner.forward(rows)
            kept = rows.matching(gone.df, [] if self.inner.one else [(ID, ID)] if rows.indexed else [(VALUE, VALUE)], "left_anti")
        return _once(kept) if self.inner.role == "indices" and rows.entity == "node" and not self.inner.one else kept

    def rowwise(self, rows, val):
        got = self.inner.rowwise(rows, val)
        return None if got is None or self.inner.moves_ids() else (V.negated(got[0]), val)

    def local(self):
        return self.inner.local()

    def clone(self):
        return Exclude(self.inner._snapshot())


# --- operands


class Operand:
    """A point in a query: where its rows come from, and what is done to them."""

    role = "entity"
    #: Whether there is at most one row (per group).
    one = False

    def __init__(self, graph, source: Callable[[], Rows], grouped: bool = False, ops: list[Op] | None = None):
        self.graph, self.source, self.grouped, self.ops = graph, source, grouped, ops if ops is not None else []

    def _snapshot(self):
        return type(self)(self.graph, self.source, self.grouped, [op.clone() for op in self.ops])

    def clone(self):
        """An independent copy of this operand and its operations."""
        return self._snapshot()

    def rows(self) -> Rows:
        return self.forward(self.source())

    def forward(self, rows: Rows) -> Rows:
        for op in self.ops:
            rows = op.apply(rows)
        return rows

    def rowwise(self, rows: Rows, val: Val | None) -> tuple[Column, Val | None] | None:
        """All operations as one predicate and value, or None."""
        kept = F.lit(True)
        for op in self.ops:
            got = op.rowwise(rows, val)
            if got is None:
                return None
            kept, val = kept & got[0], got[1]
        return kept, val

    def local(self) -> bool:
        return all(op.local() for op in self.ops)

    def moves_ids(self) -> bool:
        """Whether ids are changed, so that parents match against the new ones."""
        return self.role == "indices" and any(isinstance(op, (Transform, WithScalar)) for op in self.ops)

    def _derive(self, cls, project, grouped=None):
        snap = self._snapshot()
        return cls(self.graph, lambda: project(snap.rows()), self.grouped if grouped is None else grouped)

    def _follow(self, cls, project, link, direct=None, grouped=None, exists=None):
        child = self._derive(cls, project, grouped)
        self.ops.append(Child(child, project, link, direct, exists))
        return child

    def _fresh(self):
        return type(self)(self.graph, self.source, self.grouped)

    def either_or(self, first, second) -> None:
        """Keep rows that pass either function; both see the same rows."""
        left, right = self._fresh(), self._fresh()
        first(left)
        second(right)
        self.ops.append(EitherOr(left, right))

    def exclude(self, query) -> None:
        """Drop rows that pass the function."""
        inner = self._fresh()
        query(inner)
        self.ops.append(Exclude(inner))


def _as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple, set)) else [x]


class EntityOperand(Operand):
    """Nodes or edges."""

    entity = "node"

    def attribute(self, name) -> ValuesOperand:
        """Values of an attribute; entities without it are dropped."""

        def project(rows: Rows) -> Rows:
            present, val = rows.graph.attribute_of(rows.entity, name)
            return replace(rows.where(present), val=val).with_value(val)

        return self._follow(ValuesOperand, project, [(ID, ID)], lambda rows: rows.graph.attribute_of(rows.entity, name))

    def attributes(self) -> AttributesTreeOperand:
        """The list of attribute names of each entity."""

        def project(rows: Rows) -> Rows:
            return replace(rows, df=rows.df.withColumn(TREE, rows.graph.attribute_names(rows.entity)))

        child = self._derive(AttributesTreeOperand, project)
        self.ops.append(TreeChild(child, project))
        return child

    def has_attribute(self, names, mode: MatchMode = MatchMode.ALL) -> None:
        names, mode = _unpack(names, mode)

        def test(rows: Rows, _val):
            return _combine([rows.graph.attribute_of(rows.entity, n)[0] for n in names], mode)

        self.ops.append(Filter(test))

    def in_group(self, groups, mode: MatchMode = MatchMode.ALL) -> None:
        names, mode = _unpack(groups, mode)
        self.ops.append(InGroup([group_key(g) for g in names], mode))

    def index(self) -> IndicesOperand:
        """The ids."""

        def direct(rows: Rows):
            return F.lit(True), Val(rows.graph.id_kind(rows.entity), F.col(ID))

        def project(rows: Rows) -> Rows:
            return rows.with_value(direct(rows)[1])

        return self._follow(IndicesOperand, project, [(ID, ID)], direct)

    def group_by(self, by):
        """Groups; every later verb works inside each group."""

        def project(rows: Rows) -> Rows:
            columns = {f"__{name}": column for name, column in _key_columns(rows, by).items()}
            df, keys = rows.df.withColumns(columns), list(columns)
            return replace(rows, df=df, keys=tuple(keys), universe=df.select(*keys).distinct())

        return self._follow(type(self), project, [(ID, ID)], lambda _rows: (F.lit(True), None), grouped=True)

    def ungroup(self):
        """Back to one stream; filters put on it also reach the groups."""
        if not self.grouped:
            raise QueryError("ungroup() needs a grouped operand")
        return self._follow(type(self), _without_keys, [(ID, ID)], lambda _rows: (F.lit(True), None), grouped=False)


class TreeChild(Op):
    """An attribute list: its filters work inside the list and keep the entity;
    only aggregates below it can drop entities."""

    def __init__(self, child: AttributesTreeOperand, project):
        self.child, self.project = child, project

    def apply(self, rows):
        for op in self.child.ops:
            if isinstance(op, Child):
                return rows.matching(self.child.forward(self.project(rows)).df, [(ID, ID)])
        return rows

    def rowwise(self, rows, val):
        return None if any(isinstance(op, Child) for op in self.child.ops) else (F.lit(True), val)

    def local(self):
        return self.child.local()

    def clone(self):
        return TreeChild(self.child._snapshot(), self.project)


def _without_keys(rows: Rows) -> Rows:
    return replace(rows, df=rows.df.drop(*rows.keys), keys=(), universe=None)


def group_key(group) -> str:
    """Text form of a group or attribute name; numbers and texts stay apart."""
    return group if isinstance(group, str) else f"#{group}"


def _unpack(names, mode):
    if isinstance(names, tuple) and len(names) == 2 and isinstance(names[1], MatchMode):
        names, mode = names
    return _as_list(names), mode


def _combine(tests: list[Column], mode: MatchMode) -> Column:
    """All or any; an empty list matches nothing."""
    out = tests[0] if tests else F.lit(False)
    for t in tests[1:]:
        out = out & t if mode == MatchMode.ALL else out | t
    return out


def _key_columns(rows: Rows, by) -> dict[str, Column]:
    if isinstance(by, Discriminator.Attribute):
        present, val = rows.graph.attribute_of(rows.entity, by.name)
        return {"group": F.when(present, val.col), "group_present": present}  # a missing key and Null are two groups
    if rows.entity == "edge":
        if by == Discriminator.SOURCE_NODE:
            return {"group": F.col(SRC)}
        if by == Discriminator.TARGET_NODE:
            return {"group": F.col(DST)}
        if by == Discriminator.PARALLEL:
            return {"group_source": F.col(SRC), "group_target": F.col(DST)}
    raise QueryError(f"{rows.entity}s cannot be grouped by {by}")


class NodeOperand(EntityOperand):
    entity = "node"

    def edges(self, direction: EdgeDirection = EdgeDirection.BOTH) -> EdgeOperand:
        """Incident edges; a self loop shows twice under BOTH."""

        def incident(rows: Rows) -> list[tuple[str, DataFrame]]:
            return [(end, rows.graph.edges_from(end, rows.within)) for end, skip in ((SRC, EdgeDirection.INCOMING), (DST, EdgeDirection.OUTGOING)) if direction != skip]

        def led(rows: Rows, parts: list[DataFrame]) -> Rows:
            return replace(rows, df=parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), entity="edge", val=None, within=None)

        def project(rows: Rows) -> Rows:
            start = rows.df.select(F.col(ID).alias(PARENT), *map(quoted, rows.keys))
            return led(rows, [start.join(edges, F.col(PARENT) == F.col(end)) for end, edges in incident(rows)])

        def exists(rows: Rows):
            return led(rows, [edges.withColumn(PARENT, F.col(end)) for end, edges in incident(rows)]), ID, PARENT

        return self._follow(EdgeOperand, project, [(ID, PARENT)], exists=exists)

    def neighbors(self, direction: EdgeDirection = EdgeDirection.BOTH) -> NodeOperand:
        """Adjacent nodes: one per edge, or under BOTH one per node and neighbour."""

        def steps(rows: Rows) -> list[DataFrame]:
            return [
                rows.graph.edges_from(a, rows.within).select(F.col(a).alias("__from"), F.col(b).alias("__next"))
                for a, b, skip in ((SRC, DST, EdgeDirection.INCOMING), (DST, SRC, EdgeDirection.OUTGOING))
                if direction != skip
            ]

        def led(rows: Rows, met: DataFrame) -> Rows:
            within = rows.graph.reachable(rows.within, direction != EdgeDirection.INCOMING, direction != EdgeDirection.OUTGOING)
            return replace(rows, df=met.join(rows.graph.nodes_within(within), F.col("__next") == F.col(ID)).drop("__next", "__from"), entity="node", val=None, within=within)

        def project(rows: Rows) -> Rows:
            start = rows.df.select(F.col(ID).alias(PARENT), *map(quoted, rows.keys))
            parts = [start.join(step, F.col(PARENT) == F.col("__from")).drop("__from") for step in steps(rows)]
            return led(rows, parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct())

        def exists(rows: Rows):
            parts = steps(rows)
            return led(rows, (parts[0] if len(parts) == 1 else parts[0].union(parts[1])).withColumn(PARENT, F.col("__from"))), ID, PARENT

        return self._follow(NodeOperand, project, [(ID, PARENT)], exists=exists)


class EdgeOperand(EntityOperand):
    entity = "edge"

    def _end(self, end: str) -> NodeOperand:
        def project(rows: Rows) -> Rows:
            start = rows.df.select(F.col(ID).alias(PARENT), F.col(end).alias("__next"), *map(quoted, rows.keys))
            return replace(rows, df=start.join(rows.graph.nodes, F.col("__next") == F.col(ID)).drop("__next"), entity="node", val=None, within=None)

        def exists(rows: Rows):
            return replace(rows, df=rows.graph.nodes, entity="node", val=None, within=None), end, ID

        return self._follow(NodeOperand, project, [(ID, PARENT)], exists=exists)

    def source_node(self) -> NodeOperand:
        """The source of each edge."""
        return self._end(SRC)

    def target_node(self) -> NodeOperand:
        """The target of each edge."""
        return self._end(DST)


class _Comparable(Operand):
    """Verbs on values, ids and attribute names, single or many."""

    def _compare(self, name: str, other) -> None:
        use = V.COMPARE[name]
        if isinstance(other, Operand):
            self.ops.append(WithScalar(other._snapshot(), use))
        else:
            value = V.literal(other)
            self.ops.append(Filter(lambda _rows, v: use(v, value)))

    def _arithmetic(self, name: str, other) -> None:
        if isinstance(other, Operand):
            self.ops.append(WithScalar(other._snapshot(), lambda a, b: V.arithmetic(name, a, b)))
        else:
            value = V.literal(other)
            self.ops.append(Transform(lambda v: V.arithmetic(name, v, value)))

    def is_in(self, values) -> None:
        if isinstance(values, Operand):
            self.ops.append(WithMany(values._snapshot(), True))
        else:
            self.ops.append(Filter(lambda _rows, v: V.is_in(v, _as_list(values))))

    def is_not_in(self, values) -> None:
        if isinstance(values, Operand):
            self.ops.append(WithMany(values._snapshot(), False))
        else:
            self.ops.append(Filter(lambda _rows, v: V.negated(V.is_in(v, _as_list(values)))))

    def slice(self, start: int, end: int) -> None:
        self.ops.append(Transform(lambda v: V.slice_text(v, start, end)))

    def _is(self, kind: Kind) -> None:
        self.ops.append(Filter(lambda _rows, v: V.has_kind(v, kind)))

    def is_string(self) -> None:
        self._is(Kind.STRING)

    def is_int(self) -> None:
        self._is(Kind.INT)


class _ValueTypes(_Comparable):
    """Verbs that only values have."""

    def divide(self, other) -> None:
        self._arithmetic("divide", other)

    def is_float(self) -> None:
        self._is(Kind.FLOAT)

    def is_bool(self) -> None:
        self._is(Kind.BOOL)

    def is_datetime(self) -> None:
        self._is(Kind.DATETIME)

    def is_duration(self) -> None:
        self._is(Kind.DURATION)

    def is_null(self) -> None:
        self._is(Kind.NULL)


def _verb(cls, name: str, f: Callable) -> None:
    f.__name__ = name
    setattr(cls, name, f)


for _name in V.COMPARE:
    _verb(_Comparable, _name, lambda self, other, _n=_name: self._compare(_n, other))
for _name in ("add", "subtract", "multiply", "power", "modulo"):
    _verb(_Comparable, _name, lambda self, other, _n=_name: self._arithmetic(_n, other))
for _name in ("absolute", "trim", "trim_start", "trim_end", "lowercase", "uppercase"):
    _verb(_Comparable, _name, lambda self, _n=_name: self.ops.append(Transform(V.UNARY[_n])))
for _name in ("round", "ceil", "floor", "sqrt"):
    _verb(_ValueTypes, _name, lambda self, _n=_name: self.ops.append(Transform(V.UNARY[_n])))


class _Many(_Comparable):
    """Verbs that turn many values into one."""

    single: type

    def _aggregate(self, aggregate: Callable[[Rows], tuple[Column, Kind]], keep_id: bool = False, on_empty=None, before: Callable[[DataFrame], DataFrame] = lambda df: df):
        def project(rows: Rows) -> Rows:
            value, kind = aggregate(rows)
            df = before(rows.df).groupBy(*map(quoted, rows.keys)).agg(value.alias("__a"), F.count(F.lit(1)).alias("__n"))
            if on_empty is not None and rows.universe is not None:
                same = F.lit(True)
                named = rows.universe.select(*[quoted(k).alias(f"__u{i}") for i, k in enumerate(rows.keys)])
                for i, k in enumerate(rows.keys):
                    same = same & quoted(k).eqNullSafe(F.col(f"__u{i}"))
                df = named.join(df, same, "left").select(*[F.col(f"__u{i}").alias(k) for i, k in enumerate(rows.keys)], F.coalesce("__a", F.lit(on_empty)).alias("__a"), F.lit(1).alias("__n"))
            elif on_empty is None:
                df = df.where("__n > 0")
            keys = list(map(quoted, rows.keys))
            df = df.select(*keys, F.col("__a.k").alias(ID), F.col("__a.v").alias(VALUE)) if keep_id else df.select(*keys, F.col("__a").alias(VALUE))
            return replace(rows, df=df, val=Val(kind, F.col(VALUE)), indexed=keep_id)

        child = self._derive(self.single, project)
        self.ops.append(Gate(child, project))
        return child

    def _extreme(self, greatest: bool):
        keep = self.role != "indices" and self.has_index

        return self._aggregate(lambda rows: V.extreme(rows.val, greatest, F.col(ID) if keep else None), keep)

    has_index = True

    def max(self):
        """The greatest value, with its id where values have one."""
        return self._extreme(True)

    def min(self):
        """The least value, with its id where values have one."""
        return self._extreme(False)

    def count(self):
        """The number of values; 0 of none."""
        return self._aggregate(lambda _rows: (F.count(F.lit(1)), Kind.INT), on_empty=0)

    def sum(self):
        """All values added up; none of none (0 for edge ids)."""
        empty = 0 if self.role == "indices" and getattr(self, "of_edges", False) else None

        def aggregate(rows: Rows):
            value, kind = V.total(rows.val, F.col(ID) if ID in rows.df.columns else None)
            return (F.coalesce(value, F.lit(0)), kind) if empty == 0 else (value, kind)

        return self._aggregate(aggregate, on_empty=empty)

    def random(self):
        """One value, each as likely."""
        keep = self.role != "indices" and self.has_index
        pick = F.struct(F.col(ID).alias("k"), F.col(VALUE).alias("v")) if keep else F.col(VALUE)
        return self._aggregate(lambda rows: (F.max_by(pick, "__r"), rows.val.kind), keep, before=lambda df: df.withColumn("__r", F.rand()))

    def is_max(self) -> None:
        self.ops.append(Extreme(True))

    def is_min(self) -> None:
        self.ops.append(Extreme(False))


def _spread(operand: Operand, cls):
    """One row per group as one stream."""
    if not operand.grouped:
        raise QueryError("ungroup() needs a grouped operand")

    def project(rows: Rows) -> Rows:
        flat = _without_keys(rows)
        return replace(flat, df=flat.df.withColumn(ID, rows.val.col)) if operand.role == "indices" else flat

    return operand._derive(cls, project, grouped=False)


class ValueOperand(_ValueTypes):
    """One value (per group), with or without an id."""

    role = "values"
    one = True

    def ungroup(self) -> PlainValuesOperand:
        """The values of all groups."""
        return _spread(self, ValuesOperand if self.source().indexed else PlainValuesOperand)


class _ManyValues(_Many, _ValueTypes):
    """Verbs of many values."""

    role = "values"
    single = ValueOperand

    def mean(self):
        return self._aggregate(lambda rows: V.mean(rows.val))

    def median(self):
        return self._aggregate(lambda rows: V.median(rows.val))

    def std(self):
        """Population standard deviation."""
        return self._aggregate(lambda rows: V.spread(rows.val, False))

    def var(self):
        """Population variance."""
        return self._aggregate(lambda rows: V.spread(rows.val, True))

    def mode(self):
        """The most frequent value; of several, that of the least id."""

        def project(rows: Rows) -> Rows:
            first = F.min(ID) if rows.indexed and ID in rows.df.columns else F.min(VALUE)
            counted = rows.df.groupBy(*map(quoted, rows.keys), F.col(VALUE)).agg(F.count(F.lit(1)).alias("__n"), first.alias("__first"))
            best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("f"), F.col(VALUE).alias("v")))
            df = counted.groupBy(*map(quoted, rows.keys)).agg(best.alias("__b"), F.count(F.lit(1)).alias("__c")).where("__c > 0")
            return replace(rows, df=df.select(*map(quoted, rows.keys), F.col("__b.v").alias(VALUE)), indexed=False)

        child = self._derive(ValueOperand, project)
        self.ops.append(Gate(child, project))
        return child

    def ungroup(self):
        """Back to one stream; filters put on it also reach the groups."""
        if not self.grouped:
            raise QueryError("ungroup() needs a grouped operand")
        return self._follow(type(self), _without_keys, [(ID, ID)], lambda rows: (F.lit(True), rows.val), grouped=False)


class ValuesOperand(_ManyValues):
    """Values with the ids of their entities."""


class PlainValuesOperand(_ManyValues):
    """Values without ids."""

    has_index = False


class IndexOperand(_Comparable):
    """One id."""

    role = "indices"
    one = True

    def ungroup(self) -> IndicesOperand:
        """The ids of all groups."""
        return _spread(self, IndicesOperand)

    def moves_ids(self) -> bool:
        return False


class IndicesOperand(_Many):
    """Ids of nodes or edges."""

    role = "indices"
    single = IndexOperand

    @property
    def of_edges(self) -> bool:
        return self.source().entity == "edge"

    def ungroup(self):
        if not self.grouped:
            raise QueryError("ungroup() needs a grouped operand")
        return self._follow(IndicesOperand, _without_keys, [(ID, ID)], lambda rows: (F.lit(True), rows.val), grouped=False)


class AttributeOperand(_Comparable):
    """One attribute name."""

    role = "attributes"
    one = True

    def ungroup(self) -> AttributesOperand:
        """The names of all groups."""
        return _spread(self, AttributesOperand)


class AttributesOperand(_Many):
    """One attribute name per entity."""

    role = "attributes"
    single = AttributeOperand

    def ungroup(self) -> AttributesOperand:
        if not self.grouped:
            raise QueryError("ungroup() needs a grouped operand")
        return self._follow(AttributesOperand, _without_keys, [(ID, ID)], lambda rows: (F.lit(True), rows.val), grouped=False)

    def to_values(self) -> ValuesOperand:
        """The value of each named attribute; a name without value is an error."""

        def project(rows: Rows) -> Rows:
            return rows.with_value(rows.graph.value_named(rows.entity, F.col(VALUE)))

        return self._follow(ValuesOperand, project, [(ID, ID)])


class AttributesTreeOperand(_Comparable):
    """A list of attribute names per entity; filters and changes work inside it."""

    role = "tree"

    def forward(self, rows: Rows) -> Rows:
        for op in self.ops:
            rows = op.apply(rows) if isinstance(op, (Child, InTree)) else InTree(op).apply(rows)
        return rows

    def rowwise(self, rows, val):
        return None

    def ungroup(self) -> AttributesTreeOperand:
        """The lists of all groups as one stream."""
        if not self.grouped:
            raise QueryError("ungroup() needs a grouped operand")
        return self._derive(AttributesTreeOperand, _without_keys, grouped=False)

    def _per_entity(self, pick: Callable[[Column], Column], kind: Kind, what: str):
        """An aggregate over each entity's list; an empty list is an error."""

        def project(rows: Rows) -> Rows:
            bad = F.raise_error(F.lit(f"no attributes to {what}")).cast(V.spark_type(kind))
            value = pick(F.col(TREE))
            if what != "count":
                value = F.when(F.size(TREE) == 0, bad).otherwise(value)
            return replace(rows, df=rows.df.withColumn(VALUE, value), val=Val(kind, F.col(VALUE)))

        return self._follow(AttributesOperand, project, [(ID, ID)])

    def max(self):
        return self._per_entity(F.array_max, Kind.STRING, "find the maximum of")

    def min(self):
        return self._per_entity(F.array_min, Kind.STRING, "find the minimum of")

    def count(self):
        return self._per_entity(lambda c: F.size(c).cast("bigint"), Kind.INT, "count")

    def sum(self):
        return self._per_entity(lambda c: F.array_join(c, ""), Kind.STRING, "add up")

    def random(self):
        return self._per_entity(lambda c: F.element_at(F.shuffle(c), 1), Kind.STRING, "choose from")

    def is_max(self) -> None:
        self.ops.append(InTree(lambda t: F.filter(t, lambda x: x == F.array_max(t))))

    def is_min(self) -> None:
        self.ops.append(InTree(lambda t: F.filter(t, lambda x: x == F.array_min(t))))

    def either_or(self, first, second) -> None:
        left, right = self._fresh(), self._fresh()
        first(left)
        second(right)
        self.ops.append(InTree(lambda t: F.array_union(left.changed(t), right.changed(t))))

    def exclude(self, query) -> None:
        inner = self._fresh()
        query(inner)
        self.ops.append(InTree(lambda t: F.array_except(t, inner.changed(t))))

    def changed(self, tree: Column) -> Column:
        for op in self.ops:
            tree = (op if isinstance(op, InTree) else InTree(op)).change(tree)
        return tree


class InTree(Op):
    """An operation on each name of a list."""

    def __init__(self, how: Op | Callable[[Column], Column]):
        self.how = how

    def change(self, tree: Column) -> Column:
        if not isinstance(self.how, Op):
            return self.how(tree)
        if isinstance(self.how, Filter):
            return F.filter(tree, lambda x: self.how.test(None, Val(Kind.STRING, x)))
        if isinstance(self.how, Transform):
            return F.transform(tree, lambda x: self.how.change(Val(Kind.STRING, x)).col)
        raise QueryError("a choice inside attribute lists compares with literal values only")

    def apply(self, rows):
        if isinstance(self.how, (WithScalar, WithMany)):
            return self._with_operand(rows)
        return replace(rows, df=rows.df.withColumn(TREE, self.change(F.col(TREE))))


    def _with_operand(self, rows: Rows) -> Rows:
        """Against the value or the values of another operand: one row either way,
        since attribute names are few."""
        other = self.how.other.rows()
        if isinstance(self.how, WithMany):
            one = other.df.agg(F.collect_set(other.val.col.cast("string")).alias("__s"))
            kept = F.filter(TREE, lambda x: F.array_contains("__s", x) == self.how.inside)
        else:
            got = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("No value to compare")).cast(V.spark_type(other.val.kind))).otherwise(F.first(other.val.col))
            one = other.df.agg(got.alias("__s"))
            scalar = Val(other.val.kind, F.col("__s"))
            sample = self.how.use(Val(Kind.STRING, F.lit("")), scalar)
            use = lambda x: self.how.use(Val(Kind.STRING, x), scalar)
            kept = F.transform(TREE, lambda x: use(x).col) if isinstance(sample, Val) else F.filter(TREE, use)
        return replace(rows, df=rows.df.crossJoin(F.broadcast(one)).withColumn(TREE, kept).drop("__s"))


# --- results


def result_frame(operand: Operand) -> DataFrame:
    """The rows of a returned operand with plain column names."""
    rows = operand.rows()
    columns = [quoted(k).alias(k.removeprefix("__")) for k in rows.keys]
    if operand.role == "entity":
        return rows.df.select(*columns, F.col(ID).alias("id"))
    if operand.role == "tree":
        return rows.df.select(*columns, F.col(ID).alias("id"), F.col(TREE).alias("attributes"))
    if isinstance(operand, IndicesOperand):
        return rows.df.select(*columns, rows.val.col.alias("id"))
    if rows.indexed and ID in rows.df.columns:
        return rows.df.select(*columns, F.col(ID).alias("id"), rows.val.col.alias("value"))
    return rows.df.select(*columns, rows.val.col.alias("value"))


def python_value(x):
    """A collected cell as a plain value; MIXED structs are unpacked."""
    if hasattr(x, "asDict") and "t" in x.asDict():
        d = x.asDict()
        return None if d["t"] == 0 else d[V.FIELD[Kind(d["t"])]]
    return x


def python_result(operand: Operand):
    """Collected: dicts for values by id, lists, tuples and scalars; grouped
    results as a list of (group, result), emptied groups included."""
    rows = operand.rows()
    frame = result_frame(operand)
    groups = [c for c in frame.columns if c.startswith("group")]
    names = [c for c in frame.columns if c not in groups]
    collected = [tuple(python_value(x) for x in r) for r in frame.collect()]
    n = len(groups)

    def shape(found: list[tuple]):
        if operand.role == "tree":
            return dict(found)
        if isinstance(operand, (IndicesOperand, EntityOperand)):
            return [r[0] for r in found]
        if isinstance(operand, (ValuesOperand, AttributesOperand)) and len(names) == 2:
            return dict(found)
        if isinstance(operand, PlainValuesOperand) or (isinstance(operand, (ValuesOperand, AttributesOperand)) and len(names) == 1):
            return [r[0] for r in found]
        if not found:
            return None
        return found[0] if len(names) == 2 else found[0][0]

    if not n:
        return shape(collected)
    every = [tuple(python_value(x) for x in r) for r in rows.universe.collect()] if rows.universe is not None else []
    by: dict[tuple, list[tuple]] = {k: [] for k in every}
    for r in collected:
        by.setdefault(r[:n], []).append(r[n:])
    # an attribute key has a presence flag behind it
    key = lambda k: k[0] if len(k) == 1 or (len(k) == 2 and isinstance(k[1], bool)) else k
    return [(key(k), shape(v)) for k, v in by.items()]
