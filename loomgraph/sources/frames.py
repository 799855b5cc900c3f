"""Inputs of all kinds as entity frames: an id column, attribute columns, presence flags."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConversionError
from ..functions import values as V
from ..functions.values import Kind, Val
from ..plans.rows import DST, END_GROUP, GROUPS, ID, SRC, attribute_column, presence_column, quoted
from .scratch import write_scratch


@dataclass
class Loaded:
    """A frame with its attributes: name -> (kind, has a presence flag), and the
    number of its rows where numbering them has told it."""

    df: DataFrame
    attributes: dict[str, tuple[Kind, bool]]
    ids: Kind
    rows: int | None = None


def to_spark(spark: SparkSession, frame) -> DataFrame:
    """A Spark, pandas, Polars or Arrow table as a Spark frame."""
    if isinstance(frame, DataFrame):
        return frame
    if hasattr(frame, "to_arrow"):  # Polars
        return spark.createDataFrame(frame.to_arrow())
    return spark.createDataFrame(frame)


def _id_value(df: DataFrame, column: str) -> Val:
    kind = V.kind_of_type(df.schema[column].dataType)
    if kind not in (Kind.INT, Kind.STRING, Kind.MIXED):
        raise ConversionError(f"ids must be Int or String, column {column!r} is {kind.name}")
    return Val(kind, quoted(column).cast(V.spark_type(kind)))


def _attributes(df: DataFrame, skip: Iterable[str]) -> tuple[list, dict[str, tuple[Kind, bool]]]:
    columns, attributes = [], {}
    for f in df.schema.fields:
        if f.name not in skip:
            kind = V.kind_of_type(f.dataType)
            attributes[f.name] = (kind, False)
            columns.append(quoted(f.name).cast(V.spark_type(kind)).alias(attribute_column(f.name)))
    return columns, attributes


def load_nodes(df: DataFrame, index: str, groups: list[str]) -> Loaded:
    """Every other column becomes an attribute; a null cell is the value Null."""
    columns, attributes = _attributes(df, {index})
    ids = _id_value(df, index)
    return Loaded(df.select(ids.col.alias(ID), group_array(groups), *columns), attributes, ids.kind)


def load_edges(df: DataFrame, source: str, target: str, groups: list[str], edge_id: str | None = None, start: int = 0, order_by: list[str] | None = None, ends: tuple[str | None, str | None] = (None, None)) -> Loaded:
    """Ids come from an integer column, or are numbered from ``start`` in the order given."""
    columns, attributes = _attributes(df, {source, target} | ({edge_id} if edge_id else set()))
    s, t = _id_value(df, source), _id_value(df, target)
    rows = None
    if edge_id is None:
        df, number, rows = numbered(df, start, order_by)
    else:
        number = quoted(edge_id)
    slim = df.select(number.cast("bigint").alias(ID), s.col.alias(SRC), t.col.alias(DST), *end_groups(ends), group_array(groups), *columns)
    return Loaded(slim, attributes, V.common_kind(s.kind, t.kind), rows)


def end_groups(ends: tuple[str | None, str | None] = (None, None)) -> list:
    return [F.lit(g).cast("string").alias(c) for g, c in zip(ends, END_GROUP.values(), strict=True)]


def group_array(groups: list[str]):
    return (F.array(*[F.lit(g) for g in groups]) if groups else F.array().cast("array<string>")).alias(GROUPS)


def numbered(df: DataFrame, start: int, order_by: list[str] | None) -> tuple[DataFrame, object, int]:
    """Dense numbers in row order without a one-partition window: (frame, number,
    count).

    The rows are sorted by range and stored once with their place in their
    partition, so that counting the partitions (one small row of each) and every
    later query see the same places.  Ties go by the other columns.
    """
    spark = df.sparkSession
    given = list(order_by or [])
    ties = [f.name for f in df.schema.fields if f.name not in given and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ordered = df.orderBy(*[quoted(c) for c in [*given, *ties]])
    place = F.monotonically_increasing_id()
    placed, _ = write_scratch(ordered.withColumn("__part", F.shiftright(place, 33)).withColumn("__row", place.bitwiseAND((1 << 33) - 1)), "numbered")
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(F.col("__part").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, at = [], start
    for p, n in counts:
        offsets.append((p, at))
        at += n
    # one row for each partition of the sort
    table = spark.createDataFrame(offsets, "__p bigint, __offset bigint")
    met = placed.join(F.broadcast(table), placed["__part"] == table["__p"])
    return met, F.col("__offset") + F.col("__row"), at - start


def load_tuples(spark: SparkSession, rows: list[tuple], entity: str, groups: list[str], start: int = 0) -> Loaded:
    """(id, attributes) or (source, target, attributes) tuples; a missing key and
    None stay apart."""
    width = 1 if entity == "node" else 2
    names: dict[str, Kind] = {}
    for r in rows:
        for k, v in r[width].items():
            names[_name(k)] = V.common_kind(names.get(_name(k), Kind.NULL), V.kind_of_value(v))
    ids = Kind.NULL
    for r in rows:
        for x in r[:width]:
            ids = V.common_kind(ids, V.kind_of_value(x))
    ids = Kind.STRING if ids == Kind.NULL else ids
    flagged = {n: not all(n in {_name(k) for k in r[width]} for r in rows) for n in names}
    ends = [ID] if entity == "node" else [ID, SRC, DST]
    fields = [T.StructField(c, T._parse_datatype_string("bigint" if c == ID and entity == "edge" else V.spark_type(ids))) for c in ends]
    fields.append(T.StructField(GROUPS, T.ArrayType(T.StringType())))
    for n, kind in names.items():
        fields.append(T.StructField(attribute_column(n), T._parse_datatype_string(V.spark_type(Kind.STRING if kind == Kind.NULL else kind))))
        if flagged[n]:
            fields.append(T.StructField(presence_column(n), T.BooleanType()))
    out = []
    for i, r in enumerate(rows):
        own = {_name(k): v for k, v in r[width].items()}
        row = [cell(x, ids) for x in r[:width]]
        row = row if entity == "node" else [start + i, *row]
        row.append(groups)
        for n, kind in names.items():
            row.append(cell(own.get(n), kind))
            if flagged[n]:
                row.append(n in own)
        out.append(tuple(row))
    df = spark.createDataFrame(out, T.StructType(fields))
    if entity == "edge":
        df = df.select("*", *end_groups())
    return Loaded(df, {n: (k, flagged[n]) for n, k in names.items()}, ids)


def _name(k) -> str:
    return k if isinstance(k, str) else f"#{k}"


def cell(v, kind: Kind):
    """A Python value as a cell of a column of ``kind``."""
    if kind != Kind.MIXED:
        return v
    own = V.kind_of_value(v)
    return (int(own), *[v if own == k else None for k in V.FIELD])


def united(parts: list[Loaded], ends: list[str]) -> Loaded:
    """All frames with common attributes; kinds widen, presence flags appear where
    some frame lacks an attribute."""
    if len(parts) == 1:
        return parts[0]
    kinds: dict[str, Kind] = {}
    flagged: dict[str, bool] = {}
    ids = Kind.NULL
    for x in parts:
        ids = V.common_kind(ids, x.ids)
        for n, (kind, flag) in x.attributes.items():
            kinds[n] = V.common_kind(kinds.get(n, Kind.NULL), kind)
            flagged[n] = flagged.get(n, False) or flag
    for n in kinds:
        flagged[n] = flagged[n] or any(n not in x.attributes for x in parts)

    def aligned(x: Loaded) -> DataFrame:
        wide = {}  # columns that change their kind are rewritten first
        for c in ends if x.ids != ids else ():
            if c != ID or ends == [ID]:
                wide[c] = V.as_kind(Val(x.ids, F.col(c)), ids).col
        for n, (own, _) in x.attributes.items():
            if own not in (kinds[n], Kind.NULL):
                wide[attribute_column(n)] = V.as_kind(Val(own, quoted(attribute_column(n))), kinds[n]).col
        df = x.df.withColumns(wide) if wide else x.df
        columns = [*ends, *(END_GROUP.values() if ends != [ID] else ()), GROUPS]
        for n, kind in kinds.items():
            stored = V.spark_type(Kind.STRING if kind == Kind.NULL else kind)  # a column of Nulls only
            a, h = f"`{attribute_column(n)}`", f"`{presence_column(n)}`"
            own, flag = x.attributes.get(n, (Kind.NULL, False))
            known = n in x.attributes
            if own != Kind.NULL or kind == Kind.NULL:
                columns.append(a if known else f"cast(null as {stored}) as {a}")
            else:
                columns.append(_nulls(stored, kind, known, n))
            if flagged[n]:
                columns.append(h if flag else f"{str(known).lower()} as {h}")
        return df.selectExpr(*columns)

    frames = [aligned(x) for x in parts]
    df = frames[0]
    for other in frames[1:]:
        df = df.union(other)
    return Loaded(df, {n: (k, flagged[n]) for n, k in kinds.items()}, ids)


def _nulls(stored: str, kind: Kind, known: bool, name: str) -> str:
    """Null values of a frame that has only Null, or no values at all."""
    a = attribute_column(name)
    if kind == Kind.MIXED and known:
        fields = ", ".join(f"'{f}', cast(null as {V.SPARK_TYPE[k]})" for k, f in V.FIELD.items())
        return f"named_struct('t', cast(0 as tinyint), {fields}) as `{a}`"
    return f"cast(null as {stored}) as `{a}`"
