"""A stream of rows while a query is compiled: a DataFrame and what its columns mean."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val

if TYPE_CHECKING:
    from ..graph import PropertyGraph

ID, SRC, DST, GROUPS, PARENT, VALUE, TREE = "__id", "__src", "__dst", "__groups", "__parent", "__v", "__t"
#: Groups that an edge's ends are known to be of, by end.
END_GROUP = {SRC: "__src_group", DST: "__dst_group"}


def attribute_column(name: str) -> str:
    return f"a:{name}"


def presence_column(name: str) -> str:
    return f"h:{name}"


def quoted(column: str) -> Column:
    return F.col(f"`{column}`")


@dataclass(frozen=True)
class Rows:
    """``keys`` are group keys that ride along; ``universe`` has all groups, also
    those that filters have emptied; ``val`` is the value of a value stream;
    ``indexed`` tells whether a value still has its entity's id; ``within``
    names groups that all rows are of, if a filter has said so."""

    graph: PropertyGraph
    df: DataFrame
    entity: str
    keys: tuple[str, ...] = ()
    universe: DataFrame | None = None
    val: Val | None = None
    indexed: bool = True
    within: frozenset[str] | None = None

    def where(self, condition: Column) -> Rows:
        return replace(self, df=self.df.where(condition))

    def with_value(self, val: Val) -> Rows:
        """The value computed into its own column."""
        return replace(self, df=self.df.withColumn(VALUE, val.col), val=Val(val.kind, F.col(VALUE)))

    def matching(self, other: DataFrame, columns: list[tuple[str, str]], how: str = "left_semi") -> Rows:
        """Rows with (or without) a match: (own column, other's column); group
        keys match null-safe."""
        pairs = [(a, b, False) for a, b in columns] + [(k, k, True) for k in self.keys]
        slim = other.select(*[quoted(b).alias(f"__m{i}") for i, (_, b, _) in enumerate(pairs)])
        condition = F.lit(True)
        for i, (a, _, safe) in enumerate(pairs):
            own, theirs = quoted(a), F.col(f"__m{i}")
            condition = condition & (own.eqNullSafe(theirs) if safe else own == theirs)
        if not pairs:  # one row or none: keep all or nothing
            return replace(self, df=self.df.join(F.broadcast(slim.select(F.lit(1).alias("__one")).limit(1)), F.lit(True), how))
        return replace(self, df=self.df.join(slim, condition, how))
