"""The graph container: two frames, a schema, plugins, and the query entry points.

``nodes`` has one row per node (id, groups, attributes), ``edges`` one per edge
(id, source, target, groups, attributes).  Groups are an array column, so a
graph united from tables of one group each is pruned to the right table by
constant folding.  Frames are immutable; a mutation replaces them.

Checks that need a job (unique ids, known endpoints) run where ``checked`` is
set: by default for Python and pandas inputs, not for Spark frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .errors import QueryError, SchemaError
from .functions import values as V
from .functions.values import Kind, Val
from .operators import operands as O
from .plans.rows import DST, END_GROUP, GROUPS, ID, SRC, Rows, attribute_column, presence_column, quoted
from .plugins import Plugin
from .sources import frames
from .sources.frames import Loaded

group_key = O.group_key


ENDS = {"node": [ID], "edge": [ID, SRC, DST]}


class _Frames(dict):
    """Entity frames; parts that were added are united when they are first used."""

    def __init__(self, empty: dict[str, Loaded]):
        super().__init__(empty)
        self._parts: dict[str, list[Loaded]] = {}

    def add(self, entity: str, loaded: Loaded) -> None:
        old = super().__getitem__(entity)
        kept = [] if not old.attributes and old.ids == Kind.NULL else [old]
        self._parts.setdefault(entity, kept).append(loaded)

    def __getitem__(self, entity: str) -> Loaded:
        if parts := self._parts.pop(entity, None):
            super().__setitem__(entity, frames.united(parts, ENDS[entity]))
        return super().__getitem__(entity)

    def __setitem__(self, entity: str, loaded: Loaded) -> None:
        self._parts.pop(entity, None)
        super().__setitem__(entity, loaded)

    def items(self):
        return [(e, self[e]) for e in self]

    def copy(self) -> _Frames:
        return _Frames(dict(self.items()))


class PropertyGraph:
    """A directed multigraph with attributes and groups on nodes and edges."""

    def __init__(self, spark: SparkSession, schema: S.Schema | None = None, plugins: list[Plugin] | None = None):
        self.spark = spark
        self.schema = schema.copy() if schema else S.Schema()
        self._plugins: list[Plugin] = []
        self._empty()
        for p in plugins or []:
            self.add_plugin(p)

    def _empty(self) -> None:
        self._frames = _Frames({
            "node": Loaded(self.spark.createDataFrame([], f"{ID} string, {GROUPS} array<string>"), {}, Kind.NULL),
            "edge": Loaded(self.spark.createDataFrame([], f"{ID} bigint, {SRC} string, {DST} string, {END_GROUP[SRC]} string, {END_GROUP[DST]} string, {GROUPS} array<string>"), {}, Kind.NULL),
        })
        self._groups: list[str] = []
        self._next_edge = 0
        self._disjoint = True  # no node is in two groups, and none has changed groups
        self._ends: set[tuple[str, str] | None] = set()  # promised groups of edge ends; None: some are not promised

    # --- construction

    @staticmethod
    def builder(spark: SparkSession) -> GraphBuilder:
        """Collect inputs first, build once."""
        return GraphBuilder(spark)

    @classmethod
    def with_schema(cls, spark: SparkSession, schema: S.Schema) -> PropertyGraph:
        return cls(spark, schema)

    @staticmethod
    def with_connector(spark: SparkSession, connector, data=None):
        """A graph whose connector is at hand for ingest and export."""
        from .sources.connectors import ConnectedGraph

        return ConnectedGraph(spark, connector, data)

    @classmethod
    def with_plugins(cls, spark: SparkSession, plugins: list[Plugin]) -> PropertyGraph:
        return cls(spark, plugins=plugins)

    @classmethod
    def from_tuples(cls, spark: SparkSession, nodes: list[tuple], edges: list[tuple] | None = None, schema: S.Schema | None = None) -> PropertyGraph:
        graph = cls(spark, schema)
        graph.add_nodes(nodes)
        if edges:
            graph.add_edges(edges)
        return graph

    @classmethod
    def from_dataframes(cls, spark: SparkSession, nodes, edges=None, schema: S.Schema | None = None) -> PropertyGraph:
        """nodes: (frame, id column) or a list of them; edges: (frame, source, target)."""
        graph = cls(spark, schema)
        graph.add_nodes(nodes)
        if edges:
            graph.add_edges(edges)
        return graph

    from_pandas = from_polars = from_dataframes

    # --- frames and names

    @property
    def nodes(self) -> DataFrame:
        return self._frames["node"].df

    @property
    def edges(self) -> DataFrame:
        return self._frames["edge"].df

    def id_kind(self, entity: str) -> Kind:
        if entity == "edge":
            return Kind.INT
        kind = self._frames["node"].ids
        return Kind.STRING if kind == Kind.NULL else kind

    def edges_from(self, end: str, within: frozenset[str] | None) -> DataFrame:
        """Edges whose ``end`` may be in the groups; those added with another group
        for that end are left out, which prunes their table."""
        if within is None or not self._disjoint:
            return self.edges
        known = F.col(END_GROUP[end])
        return self.edges.where(known.isNull() | known.isin(sorted(within)) if within else known.isNull())

    def reachable(self, within: frozenset[str] | None, outgoing: bool, incoming: bool) -> frozenset[str] | None:
        """Groups that one step from the groups can lead to; None if that is not known."""
        if within is None or not self._disjoint or None in self._ends:
            return None
        return frozenset([t for s, t in self._ends if outgoing and s in within] + [s for s, t in self._ends if incoming and t in within])

    def nodes_within(self, within: frozenset[str] | None) -> DataFrame:
        """Nodes that may be in the groups; other tables are pruned."""
        if within is None:
            return self.nodes
        test = F.lit(False)
        for g in sorted(within):
            test = test | F.array_contains(GROUPS, g)
        return self.nodes.where(test)

    def attribute_of(self, entity: str, name) -> tuple[Column, Val]:
        """(whether an entity has the attribute, its value)."""
        name = group_key(name)
        known = self._frames[entity].attributes.get(name)
        if known is None:
            return F.lit(False), Val(Kind.NULL, F.lit(None))
        kind, flagged = known
        return (quoted(presence_column(name)) if flagged else F.lit(True)), Val(kind, quoted(attribute_column(name)))

    def attribute_names(self, entity: str) -> Column:
        names = sorted(self._frames[entity].attributes)
        if not names:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(self.attribute_of(entity, n)[0], F.lit(n)) for n in names]))

    def value_named(self, entity: str, name: Column) -> Val:
        """The value of the attribute that a column names; none is an error."""
        kind = Kind.NULL
        for k, _ in self._frames[entity].attributes.values():
            kind = V.common_kind(kind, k)
        kind = Kind.STRING if kind == Kind.NULL else kind
        out = F
        for n in sorted(self._frames[entity].attributes):
            present, val = self.attribute_of(entity, n)
            out = out.when((name == n) & present, V.as_kind(val, kind).col)
        bad = F.raise_error(F.concat(F.lit("no attribute "), name)).cast(V.spark_type(kind))
        return Val(kind, bad if out is F else out.otherwise(bad))

    # --- hooks

    def _hooked(self, hook: str, context: dict, run: Callable[[dict], None], bypass: bool = False) -> None:
        plugins = [] if bypass else list(self._plugins)
        for p in plugins:
            context = getattr(p, f"pre_{hook}")(self, context)
        run(context)
        for p in plugins:
            getattr(p, f"post_{hook}")(self, context)

    def add_plugin(self, plugin: Plugin) -> None:
        self._plugins.append(plugin)
        plugin.initialize(self)

    def remove_plugin(self, plugin: Plugin) -> None:
        if plugin not in self._plugins:
            raise IndexError("no such plugin")
        self._plugins.remove(plugin)
        plugin.finalize(self)

    @property
    def plugins(self) -> list[Plugin]:
        return list(self._plugins)

    # --- adding

    @staticmethod
    def _suffix(groups: list[str] | None, plural: bool) -> str:
        if not groups:
            return ""
        return "_with_groups" if plural or len(groups) > 1 else "_with_group"

    def add_nodes(self, nodes, group=None, groups: list | None = None, checked: bool | None = None, bypass_plugins: bool = False) -> None:
        """nodes: (id, attributes), a list of such, (frame, id column), or a list of
        such.  Unknown groups are created."""
        names = [group_key(g) for g in ([group] if group is not None else []) + list(groups or [])]
        one = _is_frame_input(nodes, 2) or (isinstance(nodes, tuple) and isinstance(nodes[-1], dict))
        self._disjoint = self._disjoint and len(names) < 2
        inputs = [nodes] if one else list(nodes)
        framed = bool(inputs) and _is_frame_input(inputs[0], 2)
        hook = ("add_nodes_dataframes" if framed else "add_node" if one else "add_nodes") + self._suffix(names, groups is not None)

        def run(context: dict) -> None:
            for part in _parts(context["nodes"], framed):
                loaded = frames.load_nodes(frames.to_spark(self.spark, part[0]), part[1], context["groups"]) if framed else frames.load_tuples(self.spark, part, "node", context["groups"])
                spark_frame = framed and isinstance(part[0], DataFrame)
                self._append("node", loaded, context["groups"], not spark_frame if checked is None else checked)

        self._hooked(hook, {"nodes": inputs, "groups": names}, run, bypass_plugins)

    def add_edges(self, edges, group=None, groups: list | None = None, edge_id: str | None = None, order_by: list[str] | None = None, ends: tuple = (None, None), checked: bool | None = None, bypass_plugins: bool = False) -> list[int] | None:
        """edges: (source, target, attributes), a list of such, (frame, source column,
        target column), or a list of such.  Returns the ids of tuples.  ``ends``
        promises groups that all sources and all targets of a frame are in."""
        names = [group_key(g) for g in ([group] if group is not None else []) + list(groups or [])]
        one = _is_frame_input(edges, 3) or (isinstance(edges, tuple) and isinstance(edges[-1], dict))
        inputs = [edges] if one else list(edges)
        framed = bool(inputs) and _is_frame_input(inputs[0], 3)
        hook = ("add_edges_dataframes" if framed else "add_edge" if one else "add_edges") + self._suffix(names, groups is not None)
        made: list[int] = []

        def run(context: dict) -> None:
            if context["edges"]:
                self._ends.add(tuple(ends) if framed and None not in ends else None)
            for part in _parts(context["edges"], framed):
                if framed:
                    df = frames.to_spark(self.spark, part[0])
                    start = self._next_id() if edge_id is None else 0
                    loaded = frames.load_edges(df, part[1], part[2], context["groups"], edge_id, start, order_by, ends)
                    self._next_edge = None if loaded.rows is None else start + loaded.rows
                else:
                    start = self._next_id()
                    loaded = frames.load_tuples(self.spark, part, "edge", context["groups"], start)
                    made.extend(range(start, start + len(part)))
                    self._next_edge = start + len(part)
                spark_frame = framed and isinstance(part[0], DataFrame)
                self._append("edge", loaded, context["groups"], not spark_frame if checked is None else checked)

        self._hooked(hook, {"edges": inputs, "groups": names}, run, bypass_plugins)
        return made or None

    def _next_id(self) -> int:
        if self._next_edge is None:
            top = self.edges.agg(F.max(ID)).first()[0]
            self._next_edge = 0 if top is None else top + 1
        return self._next_edge

    def _append(self, entity: str, loaded: Loaded, groups: list[str], checked: bool) -> None:
        if checked:
            self._check(entity, loaded)
        self._learn(entity, loaded, groups or [None], checked)
        self._frames.add(entity, loaded)
        self._groups += [g for g in groups if g not in self._groups]

    def _check(self, entity: str, loaded: Loaded) -> None:
        if entity == "node":
            twice = loaded.df.groupBy(ID).count().where("count > 1").limit(1).collect()
            known = self._frames["node"]
            if not twice and known.ids == loaded.ids:
                twice = loaded.df.join(known.df.select(ID), ID, "left_semi").limit(1).collect()
            if twice:
                raise AssertionError(f"node {twice[0][ID]!r} exists already")
            return
        if self.id_kind("node") == loaded.ids:
            for end in (SRC, DST):
                lost = loaded.df.select(F.col(end).alias(ID)).join(self.nodes.select(ID), ID, "left_anti").limit(1).collect()
                if lost:
                    raise IndexError(f"cannot find node {lost[0][ID]!r}")
        else:
            raise IndexError("edges name nodes by another kind of id")

    def _observed(self, loaded: Loaded, exact: bool) -> S.AttributeSchema:
        """Types of the attributes: from column kinds, and with ``exact`` from one
        aggregate over Nulls, missing keys and the kinds of mixed attributes."""
        if not loaded.attributes:
            return {}
        seen: S.AttributeSchema = {}
        measured = {}
        if exact:
            aggs = []
            for i, (n, (kind, flagged)) in enumerate(loaded.attributes.items()):
                c, present = quoted(attribute_column(n)), quoted(presence_column(n)) if flagged else F.lit(True)
                null = c["t"] == 0 if kind == Kind.MIXED else c.isNull()
                aggs += [F.max(present & null).alias(f"n{i}"), F.max(~present).alias(f"m{i}"), F.collect_set(F.when(present, c["t"]) if kind == Kind.MIXED else F.lit(int(kind))).alias(f"k{i}"), F.max(present & ~null).alias(f"v{i}")]
            row = loaded.df.agg(*aggs).first()
            measured = {n: (row[f"n{i}"], row[f"m{i}"], row[f"k{i}"], row[f"v{i}"]) for i, n in enumerate(loaded.attributes)}
        for n, (kind, flagged) in loaded.attributes.items():
            null, missing, kinds, some = measured.get(n, (False, flagged, [int(kind)], True))
            found = frozenset(Kind(k) for k in kinds) - {Kind.NULL, Kind.MIXED}
            found = found if some else frozenset({Kind.NULL})
            t = S.DataType(found or frozenset({Kind.STRING}), bool((null and some) or missing))
            seen[n] = S.AttributeDataType(t)
        return seen

    def _learn(self, entity: str, loaded: Loaded, groups: list, exact: bool) -> None:
        seen = self._observed(loaded, exact)
        for g in groups:
            own = self.schema.ungrouped if g is None else self.schema.groups.get(g)
            if self.schema.provided:
                if own is None:
                    raise SchemaError(f"group {g!r} has no schema")
                S.validate(own.of(entity), seen, f"{entity}s of {g or 'no group'}")
                continue
            first = own is None or not own.of(entity)
            grown = S.update((own or S.GroupSchema()).of(entity), seen, first)
            new = (own or S.GroupSchema()).with_(entity, grown)
            if g is None:
                self.schema.ungrouped = new
            else:
                self.schema.groups[g] = new

    # --- selecting

    def _ids(self, entity: str, selector) -> tuple[Column, DataFrame | None]:
        """A predicate for literal ids, or a frame of ids for queries and frames."""
        if callable(selector) and not isinstance(selector, O.Operand):
            selector = (self._compiled(entity, selector))
        if isinstance(selector, O.Operand):
            rows = selector.rows()
            return F.lit(True), rows.df.select((rows.val.col if rows.val is not None else F.col(ID)).alias(ID)).distinct()
        if isinstance(selector, DataFrame):
            return F.lit(True), selector.select(F.col(selector.columns[0]).alias(ID)).distinct()
        return V.is_in(Val(self.id_kind(entity), F.col(ID)), O._as_list(selector)), None

    def _without(self, df: DataFrame, column: str, test: Column | None, ids: DataFrame | None) -> DataFrame:
        if ids is None:
            return df.where(~test)
        return df.join(ids.select(F.col(ID).alias(column)), column, "left_anti").select(*df.columns)

    def _changed(self, entity: str, selector, change: dict[str, Column]) -> None:
        """Columns replaced on the selected rows."""
        self._disjoint = self._disjoint and not (entity == "node" and GROUPS in change)
        test, ids = self._ids(entity, selector)
        f = self._frames[entity]
        df = f.df
        if ids is not None:
            df, test = df.join(ids.withColumn("__hit", F.lit(True)), ID, "left"), F.coalesce("__hit", F.lit(False))
        df = df.withColumns({c: F.when(test, v).otherwise(quoted(c)) for c, v in change.items()}).select(*f.df.columns)
        self._frames[entity] = Loaded(df, f.attributes, f.ids)

    # --- removing

    def _taken(self, entity: str, selector):
        """Attributes of what is about to go: a dictionary for one literal id, one by
        id for a list, a frame for a query or a frame of ids."""
        if callable(selector) or isinstance(selector, (DataFrame, O.Operand)):
            f = self._frames[entity]
            _, ids = self._ids(entity, selector)
            columns = [F.when(present, val.col).alias(n) for n in sorted(f.attributes) for present, val in [self.attribute_of(entity, n)]]
            return f.df.join(ids, ID, "left_semi").select(F.col(ID).alias("id"), *columns)
        from .indexers import Indexer

        return Indexer(self, entity)[selector]

    def remove_nodes(self, nodes, bypass_plugins: bool = False):
        """Nodes with their edges and memberships; unknown literal ids raise.

        Returns the attributes that went: see ``_taken``.
        """
        taken = []

        def run(context: dict) -> None:
            taken.append(self._taken("node", context["nodes"]))
            test, ids = self._ids("node", context["nodes"])
            n, e = self._frames["node"], self._frames["edge"]
            edges = e.df
            for end in (SRC, DST):
                own = V.is_in(Val(n.ids, F.col(end)), O._as_list(context["nodes"])) if ids is None else None
                edges = self._without(edges, end, own, ids)
            self._frames = _Frames({"node": Loaded(self._without(n.df, ID, test, ids), n.attributes, n.ids), "edge": Loaded(edges, e.attributes, e.ids)})

        self._hooked("remove_node", {"nodes": nodes}, run, bypass_plugins)
        return taken[0]

    def remove_edges(self, edges, bypass_plugins: bool = False):
        """Edges; returns the attributes that went."""
        taken = []

        def run(context: dict) -> None:
            taken.append(self._taken("edge", context["edges"]))
            test, ids = self._ids("edge", context["edges"])
            e = self._frames["edge"]
            self._frames["edge"] = Loaded(self._without(e.df, ID, test, ids), e.attributes, e.ids)

        self._hooked("remove_edge", {"edges": edges}, run, bypass_plugins)
        return taken[0]

    def _known(self, entity: str, selector, ids: DataFrame | None) -> None:
        if ids is not None:
            return
        wanted = set(O._as_list(selector))
        test, _ = self._ids(entity, list(wanted))
        found = {O.python_value(r[0]) for r in self._frames[entity].df.where(test).select(ID).collect()}
        if wanted - found:
            raise IndexError(f"cannot find {entity} {sorted(wanted - found, key=str)[0]!r}")

    def clear(self, bypass_plugins: bool = False) -> None:
        """Drop all data; the schema stays."""
        self._hooked("clear", {}, lambda _c: self._empty(), bypass_plugins)

    def clear_edges(self) -> None:
        e = self._frames["edge"]
        self._frames["edge"] = Loaded(e.df.limit(0), e.attributes, e.ids)
        self._next_edge = 0

    # --- groups

    def add_group(self, group, nodes=None, edges=None, bypass_plugins: bool = False) -> None:
        def run(context: dict) -> None:
            if context["group"] in self._groups:
                raise AssertionError(f"group {context['group']!r} exists already")
            self._groups.append(context["group"])
            if context["nodes"] is not None:
                self._join("node", context["group"], context["nodes"])
            if context["edges"] is not None:
                self._join("edge", context["group"], context["edges"])

        self._hooked("add_group", {"group": group_key(group), "nodes": nodes, "edges": edges}, run, bypass_plugins)

    def remove_groups(self, groups, bypass_plugins: bool = False) -> None:
        """Drop groups; their schemas stay."""
        for g in O._as_list(groups):

            def run(context: dict) -> None:
                self._group(context["group"])
                self._disjoint = False
                for entity in ("node", "edge"):
                    f = self._frames[entity]
                    self._frames[entity] = Loaded(f.df.withColumn(GROUPS, F.array_remove(GROUPS, context["group"])), f.attributes, f.ids)
                self._groups.remove(context["group"])

            self._hooked("remove_group", {"group": group_key(g)}, run, bypass_plugins)

    def _group(self, group) -> str:
        key = group_key(group)
        if key not in self._groups:
            raise IndexError(f"cannot find group {group!r}")
        return key

    def _join(self, entity: str, group: str, selector) -> None:
        test, ids = self._ids(entity, selector)
        if ids is None:
            self._known(entity, selector, None)
            inside = self._frames[entity].df.where(test & F.array_contains(GROUPS, group)).limit(1).collect()
            if inside:
                raise AssertionError(f"{entity} {inside[0][ID]!r} is in group {group!r} already")
        f = self._frames[entity]
        members = f.df.where(test) if ids is None else f.df.join(ids, ID, "left_semi")
        self._learn(entity, Loaded(members, f.attributes, f.ids), [group], ids is None)
        self._changed(entity, selector, {GROUPS: F.array_union(GROUPS, F.array(F.lit(group)))})

    def _membership(self, entity: str, groups, selector, add: bool, bypass: bool) -> None:
        names = [group_key(g) for g in O._as_list(groups)]
        plural = len(names) > 1
        many = isinstance(selector, (list, tuple, DataFrame)) or callable(selector)
        verb, word = ("add", "to") if add else ("remove", "from")
        hook = f"{verb}_{entity}{'s' if many else ''}_{word}_group{'s' if plural or many else ''}"

        def run(context: dict) -> None:
            for g in context["groups"]:
                if add:
                    if g not in self._groups:
                        self._groups.append(g)
                    self._join(entity, g, context["members"])
                else:
                    self._group(g)
                    _, ids = self._ids(entity, context["members"])
                    self._known(entity, context["members"], ids)
                    self._changed(entity, context["members"], {GROUPS: F.array_remove(GROUPS, g)})

        self._hooked(hook, {"groups": names, "members": selector}, run, bypass)

    def add_nodes_to_group(self, group, nodes, bypass_plugins: bool = False) -> None:
        self._membership("node", group, nodes, True, bypass_plugins)

    def add_edges_to_group(self, group, edges, bypass_plugins: bool = False) -> None:
        self._membership("edge", group, edges, True, bypass_plugins)

    def remove_nodes_from_group(self, group, nodes, bypass_plugins: bool = False) -> None:
        self._membership("node", group, nodes, False, bypass_plugins)

    def remove_edges_from_group(self, group, edges, bypass_plugins: bool = False) -> None:
        self._membership("edge", group, edges, False, bypass_plugins)

    def groups(self) -> list[str]:
        return list(self._groups)

    def group_count(self) -> int:
        return len(self._groups)

    def contains_group(self, group) -> bool:
        return group_key(group) in self._groups

    def _members(self, entity: str, group) -> DataFrame:
        return self._frames[entity].df.where(F.array_contains(GROUPS, self._group(group))).select(F.col(ID).alias("id"))

    def nodes_in_group(self, group) -> DataFrame:
        return self._members("node", group)

    def edges_in_group(self, group) -> DataFrame:
        return self._members("edge", group)

    def group(self, group) -> dict[str, list]:
        """Ids of a group's nodes and edges, collected."""
        return {"nodes": self._listed(self.nodes_in_group(group)), "edges": self._listed(self.edges_in_group(group))}

    def ungrouped_nodes(self) -> DataFrame:
        return self.nodes.where(F.size(GROUPS) == 0).select(F.col(ID).alias("id"))

    def ungrouped_edges(self) -> DataFrame:
        return self.edges.where(F.size(GROUPS) == 0).select(F.col(ID).alias("id"))

    def groups_of_node(self, node) -> list[str]:
        return self._groups_of("node", node)

    def groups_of_edge(self, edge) -> list[str]:
        return self._groups_of("edge", edge)

    def _groups_of(self, entity: str, one) -> list[str]:
        found = self._frames[entity].df.where(self._ids(entity, one)[0]).select(GROUPS).collect()
        if not found:
            raise IndexError(f"cannot find {entity} {one!r}")
        return sorted(found[0][0])

    # --- structure

    @staticmethod
    def _listed(df: DataFrame) -> list:
        return [O.python_value(r[0]) for r in df.collect()]

    def node_indices(self) -> DataFrame:
        return self.nodes.select(F.col(ID).alias("id"))

    def edge_indices(self) -> DataFrame:
        return self.edges.select(F.col(ID).alias("id"))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def contains_node(self, node) -> bool:
        return not self.nodes.where(self._ids("node", node)[0]).isEmpty()

    def contains_edge(self, edge) -> bool:
        return not self.edges.where(self._ids("edge", edge)[0]).isEmpty()

    def _end(self, column: str, selector) -> Column:
        return V.is_in(Val(self.id_kind("node"), F.col(column)), O._as_list(selector))

    def outgoing_edges(self, nodes) -> DataFrame:
        return self.edges.where(self._end(SRC, nodes)).select(F.col(ID).alias("id"), F.col(SRC).alias("node"))

    def incoming_edges(self, nodes) -> DataFrame:
        return self.edges.where(self._end(DST, nodes)).select(F.col(ID).alias("id"), F.col(DST).alias("node"))

    def edge_endpoints(self, edges=None) -> DataFrame:
        df = self.edges if edges is None else self.edges.where(self._ids("edge", edges)[0])
        return df.select(F.col(ID).alias("id"), F.col(SRC).alias("source"), F.col(DST).alias("target"))

    def edges_connecting(self, sources, targets, undirected: bool = False) -> DataFrame:
        """Edges from any of the sources to any of the targets."""
        test = self._end(SRC, sources) & self._end(DST, targets)
        if undirected:
            test = test | (self._end(DST, sources) & self._end(SRC, targets))
        return self.edges.where(test).select(F.col(ID).alias("id"))

    def neighbors(self, nodes, direction: O.EdgeDirection = O.EdgeDirection.OUTGOING) -> DataFrame:
        """(node, neighbor): one row per edge, distinct under BOTH."""
        out = self.edges.where(self._end(SRC, nodes)).select(F.col(SRC).alias("node"), F.col(DST).alias("neighbor"))
        back = self.edges.where(self._end(DST, nodes)).select(F.col(DST).alias("node"), F.col(SRC).alias("neighbor"))
        return {O.EdgeDirection.OUTGOING: out, O.EdgeDirection.INCOMING: back}.get(direction, out.union(back).distinct())

    # --- attributes

    @property
    def node(self):
        """``graph.node[ids, attributes]``: read, assign and delete."""
        from .indexers import Indexer

        return Indexer(self, "node")

    @property
    def edge(self):
        from .indexers import Indexer

        return Indexer(self, "edge")

    # --- schema

    def get_schema(self) -> S.Schema:
        return self.schema.copy()

    def set_schema(self, schema: S.Schema, bypass_plugins: bool = False) -> None:
        """Check (provided) or infer (otherwise) over all data, then swap."""

        def run(context: dict) -> None:
            old, self.schema = self.schema, context["schema"].copy()
            try:
                self._learn_all()
            except SchemaError:
                self.schema = old
                raise

        self._hooked("set_schema", {"schema": schema}, run, bypass_plugins)

    def set_schema_unchecked(self, schema: S.Schema) -> None:
        """Swap the schema; the data is not looked at and no hook runs."""
        self.schema = schema.copy()

    def infer_schema(self) -> S.Schema:
        """The schema that the data alone gives; the graph keeps its own."""
        other = self.clone()
        other.schema = S.Schema()
        other._learn_all()
        return other.schema

    def _learn_all(self) -> None:
        """Check all data against the schema, or widen it."""
        for entity, f in self._frames.items():
            for g in [None, *self._groups]:
                members = f.df.where(F.size(GROUPS) == 0) if g is None else f.df.where(F.array_contains(GROUPS, g))
                if not members.isEmpty():
                    held = {n: a for n, a in f.attributes.items() if not a[1] or not members.where(quoted(presence_column(n))).isEmpty()}
                    self._learn(entity, Loaded(members, held, f.ids), [g], True)

    def freeze_schema(self, bypass_plugins: bool = False) -> None:
        self._hooked("freeze_schema", {}, lambda _c: self.schema.freeze(), bypass_plugins)

    def unfreeze_schema(self, bypass_plugins: bool = False) -> None:
        self._hooked("unfreeze_schema", {}, lambda _c: self.schema.unfreeze(), bypass_plugins)

    # --- queries

    def _root(self, entity: str) -> O.EntityOperand:
        cls = O.NodeOperand if entity == "node" else O.EdgeOperand
        return cls(self, lambda: Rows(self, self._frames[entity].df, entity))

    def _compiled(self, entity: str, query):
        return query(self._root(entity))

    def query_nodes_df(self, query):
        """The result of a query as a DataFrame (a list of them for several)."""
        return self._frame_of(self._compiled("node", query))

    def query_edges_df(self, query):
        return self._frame_of(self._compiled("edge", query))

    def query_nodes(self, query):
        """The result of a query, collected."""
        return self._result_of(self._compiled("node", query))

    def query_edges(self, query):
        return self._result_of(self._compiled("edge", query))

    def _frame_of(self, out):
        if isinstance(out, (list, tuple)):
            return [self._frame_of(x) for x in out]
        if not isinstance(out, O.Operand):
            raise QueryError("a query returns an operand or a list of operands")
        return O.result_frame(out)

    def _result_of(self, out):
        if isinstance(out, (list, tuple)):
            return [self._result_of(x) for x in out]
        if not isinstance(out, O.Operand):
            raise QueryError("a query returns an operand or a list of operands")
        return O.python_result(out)

    # --- copies, overview, export

    def clone(self) -> PropertyGraph:
        other = PropertyGraph(self.spark, self.schema.copy())
        other._frames, other._groups, other._next_edge, other._plugins, other._disjoint, other._ends = self._frames.copy(), list(self._groups), self._next_edge, list(self._plugins), self._disjoint, set(self._ends)
        return other

    def checkpoint(self) -> None:
        """Cut the lineage that many mutations leave; needs spark.checkpoint.dir."""
        for entity, f in self._frames.items():
            self._frames[entity] = Loaded(f.df.checkpoint(), f.attributes, f.ids)

    def overview(self):
        from .overview import overview

        return overview(self)

    def group_overview(self, group):
        from .overview import group_overview

        return group_overview(self, self._group(group))

    def to_dataframes(self) -> dict[str | None, dict[str, DataFrame]]:
        """Per group (None: ungrouped) a node and an edge table in the group's schema."""
        return {g: {"nodes": self.export("node", g), "edges": self.export("edge", g)} for g in [None, *self._groups]}

    def export(self, entity: str, group: str | None) -> DataFrame:
        names = sorted((self.schema.ungrouped if group is None else self.schema.groups.get(group, S.GroupSchema())).of(entity))
        reserved = {"node_index"} if entity == "node" else {"edge_index", "source_node_index", "target_node_index"}
        if reserved & set(names):
            raise ValueError(f"attribute names {sorted(reserved & set(names))} are reserved")
        f = self._frames[entity]
        members = f.df.where(F.size(GROUPS) == 0) if group is None else f.df.where(F.array_contains(GROUPS, group))
        ids = [F.col(ID).alias("node_index")] if entity == "node" else [F.col(ID).alias("edge_index"), F.col(SRC).alias("source_node_index"), F.col(DST).alias("target_node_index")]
        values = []
        for n in names:
            present, val = self.attribute_of(entity, n)
            values.append(F.when(present, val.col).alias(n) if n in f.attributes else F.lit(None).alias(n))
        return members.select(*ids, *values)

    def to_pandas(self) -> dict:
        return {g: {k: df.toPandas() for k, df in t.items()} for g, t in self.to_dataframes().items()}

    def to_polars(self) -> dict:
        import polars

        return {g: {k: polars.from_arrow(df.toArrow()) for k, df in t.items()} for g, t in self.to_dataframes().items()}

    def save(self, path: str, format: str = "parquet") -> None:
        """A snapshot directory; see ``sources.snapshot``."""
        from .sources.snapshot import save

        save(self, path, format)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        from .sources.snapshot import load

        return load(spark, path)


def _is_frame_input(x, width: int) -> bool:
    return isinstance(x, tuple) and len(x) == width and not isinstance(x[0], (str, int, tuple)) and all(isinstance(c, str) for c in x[1:])


def _parts(inputs: list, framed: bool) -> list:
    return inputs if framed else [inputs] if inputs else []


class GraphBuilder:
    """Inputs collected for one ``build``."""

    def __init__(self, spark: SparkSession):
        self.spark, self._nodes, self._edges, self._groups = spark, [], [], []
        self._schema, self._plugins = None, []

    def add_nodes(self, nodes, group=None) -> GraphBuilder:
        self._nodes.append((nodes, group))
        return self

    def add_edges(self, edges, group=None) -> GraphBuilder:
        self._edges.append((edges, group))
        return self

    def add_group(self, group, nodes=None, edges=None) -> GraphBuilder:
        self._groups.append((group, nodes, edges))
        return self

    def with_schema(self, schema: S.Schema) -> GraphBuilder:
        self._schema = schema
        return self

    def add_plugin(self, plugin: Plugin) -> GraphBuilder:
        self._plugins.append(plugin)
        return self

    def with_plugins(self, plugins: list[Plugin]) -> GraphBuilder:
        self._plugins += plugins
        return self

    def build(self) -> PropertyGraph:
        graph = PropertyGraph(self.spark, self._schema, self._plugins)
        for nodes, group in self._nodes:
            graph.add_nodes(nodes, group)
        for edges, group in self._edges:
            graph.add_edges(edges, group)
        for group, nodes, edges in self._groups:
            graph.add_group(group, nodes, edges)
        return graph
