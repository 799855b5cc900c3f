"""``graph.node[ids, attributes]`` and ``graph.edge[...]``: read, assign, delete.

ids: one id, a list, a query function, or ``:`` for all; attributes: one name,
a list, or ``:``.  Reading one id gives its attributes (or value), reading
several a dictionary by id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import values as V
from .functions.values import Kind, Val
from .operators import operands as O
from .plans.rows import ID, attribute_column, presence_column, quoted
from .sources.frames import Loaded


class Indexer:
    def __init__(self, graph, entity: str):
        self.graph, self.entity = graph, entity

    def _split(self, key):
        ids, names = key if isinstance(key, tuple) else (key, slice(None))
        if isinstance(ids, slice):
            if ids != slice(None):
                raise ValueError("only the full slice is supported")
            return None, names
        return ids, names

    def __getitem__(self, key):
        ids, names = self._split(key)
        f = self.graph._frames[self.entity]
        df = f.df
        if ids is not None:
            test, frame = self.graph._ids(self.entity, ids)
            df = df.where(test) if frame is None else df.join(frame, ID, "left_semi")
        wanted = sorted(f.attributes) if isinstance(names, slice) else [O.group_key(n) for n in O._as_list(names)]
        columns = []
        for n in wanted:
            present, val = self.graph.attribute_of(self.entity, n)
            columns += [val.col, present]
        single_id = ids is not None and not isinstance(ids, (list, tuple)) and not callable(ids)
        single_name = not isinstance(names, (slice, list, tuple))
        out = {}
        for row in df.select(ID, *columns).collect():
            held = {n: O.python_value(row[1 + 2 * i]) for i, n in enumerate(wanted) if row[2 + 2 * i]}
            lost = [n for n in wanted if n not in held]
            if lost and not isinstance(names, slice):
                raise KeyError(f"{self.entity} {row[0]!r} has no attribute {lost[0]!r}")
            out[O.python_value(row[0])] = held[wanted[0]] if single_name else held
        if ids is not None and not callable(ids):
            lost = [i for i in O._as_list(ids) if i not in out]
            if lost:
                raise IndexError(f"cannot find {self.entity} {lost[0]!r}")
        return out[ids] if single_id else out

    def __setitem__(self, key, value) -> None:
        ids, names = self._split(key)
        if isinstance(names, slice) and isinstance(value, dict):
            self._replace(ids, value)
            return
        known = list(self.graph._frames[self.entity].attributes) if isinstance(names, slice) else O._as_list(names)
        for n in known:
            self._assign(ids, O.group_key(n), value)

    def _selected(self, ids):
        if ids is None:
            return F.lit(True), None
        test, frame = self.graph._ids(self.entity, ids)
        self.graph._known(self.entity, ids, frame)
        return test, frame

    def _assign(self, ids, name: str, value) -> None:
        """Add or change one attribute on the selected entities."""
        g, f = self.graph, self.graph._frames[self.entity]
        test, frame = self._selected(ids)
        new = V.literal(value)
        old, flagged = f.attributes.get(name, (Kind.NULL, True))
        kind = V.common_kind(old, new.kind)
        kind = Kind.STRING if kind == Kind.NULL else kind
        df = f.df
        if frame is not None:
            df, test = df.join(frame.withColumn("__hit", F.lit(True)), ID, "left"), F.coalesce("__hit", F.lit(False))
        present, val = g.attribute_of(self.entity, name)
        flagged = flagged or name not in f.attributes
        columns = {attribute_column(name): F.when(test, V.as_kind(new, kind).col).otherwise(V.as_kind(Val(old, val.col), kind).col)}
        if flagged:
            columns[presence_column(name)] = test | present
        keep = [quoted(c) for c in f.df.columns if c not in columns]
        g._frames[self.entity] = Loaded(df.select(*keep, *[c.alias(n) for n, c in columns.items()]), f.attributes | {name: (kind, flagged)}, f.ids)
        self._learn(ids)

    def _replace(self, ids, attributes: dict) -> None:
        for n in list(self.graph._frames[self.entity].attributes):
            self._drop(ids, n, strict=False)
        for n, v in attributes.items():
            self._assign(ids, O.group_key(n), v)

    def _learn(self, ids) -> None:
        """Check or widen the schemas of all groups that the entities are in."""
        g, f = self.graph, self.graph._frames[self.entity]
        test, frame = (F.lit(True), None) if ids is None else g._ids(self.entity, ids)
        df = f.df.where(test) if frame is None else f.df.join(frame, ID, "left_semi")
        names = df.select(F.explode_outer("__groups").alias("g")).distinct().collect()
        for (group,) in names:
            members = df.where(F.size("__groups") == 0) if group is None else df.where(F.array_contains("__groups", group))
            held = {n: a for n, a in f.attributes.items() if not a[1] or not members.where(quoted(presence_column(n))).isEmpty()}
            g._learn(self.entity, Loaded(members, held, f.ids), [group], True)

    def _drop(self, ids, name: str, strict: bool = True) -> None:
        g, f = self.graph, self.graph._frames[self.entity]
        if name not in f.attributes:
            if strict:
                raise KeyError(name)
            return
        test, frame = self._selected(ids)
        df = f.df
        if frame is not None:
            df, test = df.join(frame.withColumn("__hit", F.lit(True)), ID, "left"), F.coalesce("__hit", F.lit(False))
        present, val = g.attribute_of(self.entity, name)
        if strict and not df.where(test & ~present).isEmpty():
            raise KeyError(name)
        columns = {attribute_column(name): F.when(~test, val.col), presence_column(name): present & ~test}
        keep = [quoted(c) for c in f.df.columns if c not in columns]
        g._frames[self.entity] = Loaded(df.select(*keep, *[c.alias(n) for n, c in columns.items()]), f.attributes | {name: (f.attributes[name][0], True)}, f.ids)

    def __delitem__(self, key) -> None:
        ids, names = self._split(key)
        for n in list(self.graph._frames[self.entity].attributes) if isinstance(names, slice) else O._as_list(names):
            self._drop(ids, O.group_key(n), strict=not isinstance(names, slice))
