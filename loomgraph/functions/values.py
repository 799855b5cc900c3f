"""Typed values as Spark columns, and the operators on them.

A ``Val`` is a column with a kind known when the plan is built.  Attributes
that hold several kinds are ``MIXED``: a tagged struct whose field ``t`` tells
the kind and whose other fields hold the value; an operator on them is lifted
over the kinds that occur.

Null is a value: it equals itself, and every ordering against another value
is false.  Arithmetic on Null is an error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConversionError, QueryError


class Kind(IntEnum):
    """Kinds in the order that sorts values of different kinds."""

    NULL = 0
    BOOL = 1
    INT = 2
    FLOAT = 3
    STRING = 4
    DATETIME = 5
    DURATION = 6
    MIXED = 7


SPARK_TYPE = {Kind.BOOL: "boolean", Kind.INT: "bigint", Kind.FLOAT: "double", Kind.STRING: "string", Kind.DATETIME: "timestamp_ntz", Kind.DURATION: "interval day to second", Kind.NULL: "void"}
FIELD = {Kind.BOOL: "b", Kind.INT: "i", Kind.FLOAT: "f", Kind.STRING: "s", Kind.DATETIME: "ts", Kind.DURATION: "d"}
MIXED_TYPE = "struct<t:tinyint," + ",".join(f"{FIELD[k]}:{SPARK_TYPE[k]}" for k in FIELD) + ">"
NUMERIC = (Kind.INT, Kind.FLOAT)


@dataclass(frozen=True)
class Val:
    """A column of a known kind."""

    kind: Kind
    col: Column


def spark_type(kind: Kind) -> str:
    return MIXED_TYPE if kind == Kind.MIXED else SPARK_TYPE[kind]


def kind_of_type(t: T.DataType) -> Kind:
    """The kind that a Spark column type is loaded as."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return Kind.FLOAT
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return Kind.STRING
    if isinstance(t, T.BooleanType):
        return Kind.BOOL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Kind.DATETIME
    if isinstance(t, T.DayTimeIntervalType):
        return Kind.DURATION
    if isinstance(t, T.NullType):
        return Kind.NULL
    if t.simpleString() == MIXED_TYPE:
        return Kind.MIXED
    raise ConversionError(f"no value kind for {t.simpleString()}")


def kind_of_value(v: object) -> Kind:
    if v is None:
        return Kind.NULL
    if isinstance(v, bool):
        return Kind.BOOL
    if isinstance(v, int):
        return Kind.INT
    if isinstance(v, float):
        return Kind.FLOAT
    if isinstance(v, str):
        return Kind.STRING
    if isinstance(v, dt.datetime):
        return Kind.DATETIME
    if isinstance(v, dt.timedelta):
        return Kind.DURATION
    raise ConversionError(f"no value kind for {type(v).__name__}")


def literal(v: object) -> Val:
    kind = kind_of_value(v)
    if kind == Kind.DATETIME:
        return Val(kind, F.lit(v.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"))
    return Val(kind, F.lit(v).cast(SPARK_TYPE[kind]) if kind != Kind.NULL else F.lit(None))


def tagged(v: Val) -> Column:
    """The value as a MIXED struct; Null by its tag."""
    if v.kind == Kind.MIXED:
        return v.col
    tag = F.lit(0) if v.kind == Kind.NULL else F.when(v.col.isNull(), 0).otherwise(int(v.kind))
    fields = [tag.cast("tinyint").alias("t")]
    fields += [(v.col if k == v.kind else F.lit(None)).cast(SPARK_TYPE[k]).alias(FIELD[k]) for k in FIELD]
    return F.struct(*fields)


def as_kind(v: Val, kind: Kind) -> Val:
    """The same values in a wider representation."""
    if kind == v.kind:
        return v
    if kind == Kind.MIXED:
        return Val(kind, tagged(v))
    if v.kind == Kind.NULL:
        return Val(kind, F.lit(None).cast(spark_type(kind)))
    raise ConversionError(f"{v.kind.name} is not {kind.name}")


def common_kind(a: Kind, b: Kind) -> Kind:
    if a == b or b == Kind.NULL:
        return a
    return b if a == Kind.NULL else Kind.MIXED


def members(v: Val) -> list[Val]:
    return [Val(k, v.col[FIELD[k]]) for k in FIELD]


def _lift_bool(v: Val, f: Callable[[Val], Column]) -> Column:
    """A predicate over the kinds of a MIXED value."""
    out = F.when(v.col["t"] == 0, f(Val(Kind.NULL, F.lit(None))))
    for m in members(v):
        out = out.when(v.col["t"] == int(m.kind), f(m))
    return F.coalesce(out, F.lit(False))


def _lift_val(v: Val, f: Callable[[Val], Val]) -> Val:
    """A transform over the kinds of a MIXED value."""
    out = F.when(v.col["t"] == 0, tagged(Val(Kind.NULL, F.lit(None))))
    for m in members(v):
        try:
            out = out.when(v.col["t"] == int(m.kind), tagged(f(m)))
        except QueryError as e:
            out = out.when(v.col["t"] == int(m.kind), F.raise_error(F.lit(str(e))).cast(MIXED_TYPE))
    return Val(Kind.MIXED, out)


# --- comparison


def equals(a: Val, b: Val) -> Column:
    """Null-safe and type-aware; Int equals Float only without loss."""
    if a.kind == Kind.MIXED:
        return _lift_bool(a, lambda m: equals(m, b))
    if b.kind == Kind.MIXED:
        return equals(b, a)
    if a.kind == b.kind:
        return a.col.eqNullSafe(b.col)
    both_null = a.col.isNull() & b.col.isNull()
    if {a.kind, b.kind} == set(NUMERIC):
        i, f = (a, b) if a.kind == Kind.INT else (b, a)
        fits = (f.col >= -(2.0**63)) & (f.col < 2.0**63)
        return both_null | F.coalesce(fits & (i.col.cast("double") == f.col) & (F.when(fits, f.col).cast("bigint") == i.col), F.lit(False))
    return both_null


def join_key(v: Val) -> Column:
    """A struct that is equal for two values exactly if ``equals`` holds, whatever
    their kinds, so that Spark can join on it: never null itself."""

    def key(rank: int, whole=None, fraction=None, text=None) -> Column:
        parts = (F.lit(rank).cast("tinyint").alias("r"), *[(F.lit(None) if c is None else c).cast(t).alias(n) for c, t, n in ((whole, "bigint", "i"), (fraction, "double", "f"), (text, "string", "s"))])
        return F.struct(*parts)

    null = key(0)
    if v.kind == Kind.MIXED:
        out = F.when(v.col["t"] == 0, null)
        for m in members(v):
            out = out.when(v.col["t"] == int(m.kind), join_key(m))
        return F.coalesce(out, null)
    if v.kind == Kind.NULL:
        return null
    if v.kind == Kind.FLOAT:
        fits = (v.col >= -(2.0**63)) & (v.col < 2.0**63)
        whole = F.when(fits, v.col).cast("bigint")
        own = F.when(fits & (whole.cast("double") == v.col), key(2, whole=whole)).otherwise(key(3, fraction=v.col))
    else:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        own = {
            Kind.BOOL: lambda: key(1, whole=v.col.cast("int")), Kind.INT: lambda: key(2, whole=v.col), Kind.STRING: lambda: key(4, text=v.col),
            Kind.DATETIME: lambda: key(5, whole=F.timestamp_diff("MICROSECOND", epoch, v.col)), Kind.DURATION: lambda: key(6, text=v.col.cast("string")),
        }[v.kind]()
    return F.when(v.col.isNull(), null).otherwise(own)


def _ordered(a: Val, b: Val, less: bool, or_equal: bool) -> Column:
    if a.kind == Kind.MIXED:
        return _lift_bool(a, lambda m: _ordered(m, b, less, or_equal))
    if b.kind == Kind.MIXED:
        return _lift_bool(b, lambda m: _ordered(a, m, less, or_equal))
    both_null = a.col.isNull() & b.col.isNull() if or_equal else F.lit(False)
    if a.kind != b.kind and not (a.kind in NUMERIC and b.kind in NUMERIC):
        return both_null
    if a.kind == Kind.NULL:
        return both_null
    test = {(True, False): a.col < b.col, (True, True): a.col <= b.col, (False, False): a.col > b.col, (False, True): a.col >= b.col}[less, or_equal]
    larger = b if less else a  # Spark sorts NaN last, so only this side can be NaN where the test holds
    if larger.kind == Kind.FLOAT:
        test = test & (larger.col <= float("inf"))
    return both_null | test if or_equal else test


def text(v: Val) -> Column:
    """Text that prefix, suffix and substring tests see; other kinds have none.

    Whole floats are shown without a fraction.
    """
    if v.kind == Kind.STRING:
        return v.col
    if v.kind == Kind.INT:
        return v.col.cast("string")
    if v.kind == Kind.FLOAT:
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e18)
        return F.when(whole, F.when(whole, v.col).cast("decimal(38,0)").cast("string")).otherwise(v.col.cast("string"))
    return F.lit(None).cast("string")


def _texts(a: Val, b: Val, test: Callable[[Column, Column], Column]) -> Column:
    if a.kind == Kind.MIXED:
        return _lift_bool(a, lambda m: _texts(m, b, test))
    if b.kind == Kind.MIXED:
        return _lift_bool(b, lambda m: _texts(a, m, test))
    return test(text(a), text(b))


def negated(condition: Column) -> Column:
    """The opposite of a filter.  Filters may be null for false, which leaves
    them plain enough to reach the scan; so nulls count as false here."""
    return ~F.coalesce(condition, F.lit(False))


COMPARE: dict[str, Callable[[Val, Val], Column]] = {
    "equal_to": equals,
    "not_equal_to": lambda a, b: negated(equals(a, b)),
    "greater_than": lambda a, b: _ordered(a, b, False, False),
    "greater_than_or_equal_to": lambda a, b: _ordered(a, b, False, True),
    "less_than": lambda a, b: _ordered(a, b, True, False),
    "less_than_or_equal_to": lambda a, b: _ordered(a, b, True, True),
    "starts_with": lambda a, b: _texts(a, b, lambda x, y: x.startswith(y)),
    "ends_with": lambda a, b: _texts(a, b, lambda x, y: x.endswith(y)),
    "contains": lambda a, b: _texts(a, b, lambda x, y: x.contains(y)),
}


def is_in(v: Val, values: list[object]) -> Column:
    """Membership in a literal list; one native ``IN`` per kind."""
    if v.kind == Kind.MIXED:
        return _lift_bool(v, lambda m: is_in(m, values))
    same = [x for x in values if kind_of_value(x) == v.kind and v.kind != Kind.NULL]
    out = v.col.isin([literal(x).col for x in same]) if same else F.lit(False)
    for x in values:
        if kind_of_value(x) != v.kind or v.kind == Kind.NULL:
            out = out | equals(v, literal(x))
    return out


def has_kind(v: Val, kind: Kind) -> Column:
    if v.kind == Kind.MIXED:
        return v.col["t"] == int(kind)
    if kind == Kind.NULL:
        return v.col.isNull()
    return v.col.isNotNull() if v.kind == kind else F.lit(False)


# --- arithmetic


def _seconds(c: Column) -> Column:
    """Whole epoch seconds of a zoneless time."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.floor(micros / 1_000_000)


def _from_seconds(c: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=c)


def _double(v: Val) -> Column:
    return v.col.cast("double")


def ieee_divide(a: Column, b: Column) -> Column:
    """Division of doubles with infinities and NaN instead of an error."""
    zero = F.when(a.isNull() | F.isnan(a) | (a == 0), F.when(a.isNotNull(), float("nan"))).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _not_null(v: Val, op: str) -> Val:
    bad = F.raise_error(F.lit(f"cannot {op} Null")).cast(SPARK_TYPE[v.kind])
    return Val(v.kind, F.coalesce(v.col, bad))


def _int_power(x: Column, y: Column) -> Column:
    """Exact, within 64 bits: of a base beyond 1 no power over the 63rd fits, and
    for 0, 1 and -1 the power of the same parity will do."""
    bad = lambda what: F.raise_error(F.lit(what)).cast("bigint")
    times = F.when(y < 64, y).otherwise(64 + y % 2).cast("int")
    made = F.aggregate(F.array_repeat(x, times), F.lit(1).cast("bigint"), lambda a, b: F.try_multiply(a, b))
    return F.when(y < 0, bad("Int to a negative power")).otherwise(F.coalesce(made, bad("power beyond 64 bits")))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """a op b; kinds that do not go together raise QueryError."""
    if a.kind == Kind.MIXED:
        return _lift_val(a, lambda m: arithmetic(op, m, b))
    if b.kind == Kind.MIXED:
        return _lift_val(b, lambda m: arithmetic(op, a, m))
    if Kind.NULL in (a.kind, b.kind):
        raise QueryError(f"cannot {op} {a.kind.name} and {b.kind.name}")
    a, b = _not_null(a, op), _not_null(b, op)
    kinds = (a.kind, b.kind)
    numbers = a.kind in NUMERIC and b.kind in NUMERIC
    whole = kinds == (Kind.INT, Kind.INT)
    x, y = a.col, b.col
    if op == "add":
        if kinds == (Kind.STRING, Kind.STRING):
            return Val(Kind.STRING, F.concat(x, y))
        if kinds == (Kind.DATETIME, Kind.DATETIME):
            return Val(Kind.DATETIME, _from_seconds(_seconds(x) + _seconds(y)))
        if kinds in ((Kind.DATETIME, Kind.DURATION), (Kind.DURATION, Kind.DATETIME)):
            return Val(Kind.DATETIME, x + y)
        if kinds == (Kind.DURATION, Kind.DURATION):
            return Val(Kind.DURATION, x + y)
        if numbers:
            return Val(Kind.INT if whole else Kind.FLOAT, x + y)
    elif op == "subtract":
        if kinds == (Kind.DATETIME, Kind.DATETIME):
            return Val(Kind.DURATION, x - y)
        if kinds == (Kind.DATETIME, Kind.DURATION):
            return Val(Kind.DATETIME, x - y)
        if kinds == (Kind.DURATION, Kind.DURATION):
            return Val(Kind.DURATION, x - y)
        if numbers:
            return Val(Kind.INT if whole else Kind.FLOAT, x - y)
    elif op == "multiply":
        if kinds == (Kind.STRING, Kind.INT):
            return Val(Kind.STRING, F.repeat(x, y.cast("int")))
        if kinds == (Kind.INT, Kind.STRING):
            return Val(Kind.STRING, F.repeat(y, x.cast("int")))
        if kinds == (Kind.DURATION, Kind.INT):
            return Val(Kind.DURATION, x * y)
        if numbers:
            return Val(Kind.INT if whole else Kind.FLOAT, x * y)
    elif op == "divide":
        if kinds == (Kind.DURATION, Kind.INT):
            return Val(Kind.DURATION, x / y)
        if kinds == (Kind.DATETIME, Kind.INT):
            return Val(Kind.DATETIME, _from_seconds(F.floor(_seconds(x) / y)))
        if numbers:
            return Val(Kind.FLOAT, ieee_divide(_double(a), _double(b)))
    elif op == "power" and numbers:
        return Val(Kind.INT, _int_power(x, y)) if whole else Val(Kind.FLOAT, F.pow(x, y))
    elif op == "modulo" and numbers:
        if whole:
            return Val(Kind.INT, F.when(y == 0, F.raise_error(F.lit("modulo by zero")).cast("bigint")).otherwise(x % F.when(y != 0, y)))
        return Val(Kind.FLOAT, F.when(_double(b) == 0, float("nan")).otherwise(_double(a) % F.when(_double(b) != 0, _double(b))))
    raise QueryError(f"cannot {op} {a.kind.name} and {b.kind.name}")


# --- unary


def _on(kinds: tuple[Kind, ...], f: Callable[[Val], Val]) -> Callable[[Val], Val]:
    """Applied to the kinds named; other kinds pass unchanged."""

    def run(v: Val) -> Val:
        if v.kind == Kind.MIXED:
            return _lift_val(v, run)
        return f(v) if v.kind in kinds else v

    return run


def _string(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return _on((Kind.STRING,), lambda v: Val(v.kind, f(v.col)))


def _float(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return _on((Kind.FLOAT,), lambda v: Val(v.kind, f(v.col)))


def _rounded(c: Column) -> Column:
    """Half away from zero, at any size; the fraction is compared, since adding a
    half would itself round."""
    whole = F.floor(F.when(F.abs(c) < 2.0**52, F.abs(c))).cast("double")
    return F.when(F.abs(c) < 2.0**52, F.signum(c) * (whole + F.when(F.abs(c) - whole >= 0.5, 1.0).otherwise(0.0))).otherwise(c)


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.when(F.abs(c) < 2.0**52, f(F.when(F.abs(c) < 2.0**52, c)).cast("double")).otherwise(c)


UNARY: dict[str, Callable[[Val], Val]] = {
    "round": _float(_rounded),
    "ceil": _float(_whole(F.ceil)),
    "floor": _float(_whole(F.floor)),
    "absolute": _on(NUMERIC, lambda v: Val(v.kind, F.abs(v.col))),
    "sqrt": _on(NUMERIC, lambda v: Val(Kind.FLOAT, F.sqrt(v.col))),
    "trim": _string(lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")),
    "trim_start": _string(lambda c: F.regexp_replace(c, r"(?U)^\s+", "")),
    "trim_end": _string(lambda c: F.regexp_replace(c, r"(?U)\s+$", "")),
    "lowercase": _string(F.lower),
    "uppercase": _string(F.upper),
}


def slice_text(v: Val, start: int, end: int) -> Val:
    """Characters [start, end) of the text form; out of range is an error."""

    def cut(m: Val) -> Val:
        s = text(m) if m.kind != Kind.BOOL else m.col.cast("string")
        if m.kind not in (Kind.STRING, Kind.INT, Kind.FLOAT, Kind.BOOL):
            return m
        bad = F.raise_error(F.lit(f"slice {start}..{end} is out of range")).cast("string")
        return Val(Kind.STRING, F.when(F.char_length(s) < end, bad).otherwise(F.substring(s, start + 1, end - start)))

    return _lift_val(v, cut) if v.kind == Kind.MIXED else cut(v)


# --- aggregates


def _pure(v: Val, value: Column, what: str) -> Column:
    """``value``, or an error if Null or several kinds occur among other values."""
    if v.kind == Kind.MIXED:
        mixed = F.count_distinct(v.col["t"]) > 1
        return F.when(mixed, F.raise_error(F.lit(f"cannot {what} values of several kinds")).cast(MIXED_TYPE)).otherwise(value)
    nulls = (F.count(F.lit(1)) > F.count(v.col)) & (F.count(v.col) > 0)
    return F.when(nulls, F.raise_error(F.lit(f"cannot {what} Null and other values")).cast(spark_type(v.kind))).otherwise(value)


def extreme(v: Val, greatest: bool, key: Column | None = None) -> tuple[Column, Kind]:
    """Aggregate for max or min; with ``key`` a struct (key, value).

    Ties go to the least key for min and to the greatest for max.
    """
    what = "find the maximum of" if greatest else "find the minimum of"
    pick = F.max if greatest else F.min
    pure = _pure(v, pick(v.col), what)
    if key is None:
        return pure, v.kind
    both = pick(F.struct(v.col.alias("v"), key.alias("k")))
    return F.struct(both["k"].alias("k"), pure.alias("v")), v.kind


def total(v: Val, order: Column | None = None) -> tuple[Column, Kind]:
    """Aggregate for sum: numbers, durations, texts (in id order), times by epoch seconds."""
    if v.kind in (*NUMERIC, Kind.DURATION):
        return _pure(v, F.sum(v.col), "add"), v.kind
    if v.kind == Kind.NULL:
        return F.raise_error(F.lit("cannot add Null")), v.kind
    if v.kind == Kind.STRING:
        parts = F.array_sort(F.collect_list(F.struct((order if order is not None else v.col).alias("o"), v.col.alias("v"))))
        return _pure(v, F.array_join(F.transform(parts, lambda p: p["v"]), ""), "add"), v.kind
    if v.kind == Kind.DATETIME:
        return _from_seconds(F.sum(_seconds(v.col))), v.kind
    if v.kind == Kind.MIXED:
        return _mixed_number(v, F.sum, "add"), Kind.MIXED
    raise QueryError(f"cannot add up {v.kind.name}")


def _mixed_number(v: Val, f, what: str) -> Column:
    """Aggregate of Int and Float together; other kinds are an error."""
    number = F.coalesce(v.col["f"], v.col["i"].cast("double"))
    only_int = F.count(v.col["f"]) == 0
    bad = F.count(number) < F.count(F.lit(1))
    out = F.when(only_int & F.lit(f is F.sum), tagged(Val(Kind.INT, F.sum(v.col["i"])))).otherwise(tagged(Val(Kind.FLOAT, f(number))))
    return F.when(bad, F.raise_error(F.lit(f"cannot {what} values of these kinds")).cast(MIXED_TYPE)).otherwise(out)


def mean(v: Val) -> tuple[Column, Kind]:
    if v.kind in NUMERIC:
        return _pure(Val(Kind.FLOAT, v.col.cast("double")), F.avg(v.col), "average"), Kind.FLOAT
    if v.kind == Kind.DURATION:
        return F.avg(v.col).cast(SPARK_TYPE[Kind.DURATION]), v.kind
    if v.kind == Kind.DATETIME:
        return _from_seconds(F.floor(F.sum(_seconds(v.col)) / F.count(v.col))), v.kind
    if v.kind == Kind.MIXED:
        return _mixed_number(v, F.avg, "average"), Kind.MIXED
    raise QueryError(f"cannot average {v.kind.name}")


def median(v: Val) -> tuple[Column, Kind]:
    if v.kind in NUMERIC:
        return F.median(v.col).cast("double"), Kind.FLOAT
    if v.kind == Kind.DURATION:
        return F.median(v.col).cast(SPARK_TYPE[Kind.DURATION]), v.kind
    if v.kind == Kind.DATETIME:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        micros = F.median(F.timestamp_diff("MICROSECOND", epoch, v.col))
        return F.timestamp_add("MICROSECOND", F.floor(micros).cast("bigint"), epoch), v.kind
    if v.kind == Kind.MIXED:
        return _mixed_number(v, F.median, "take the median of"), Kind.MIXED
    raise QueryError(f"no median of {v.kind.name}")


def spread(v: Val, squared: bool) -> tuple[Column, Kind]:
    """Population variance or standard deviation."""
    f = F.var_pop if squared else F.stddev_pop
    if v.kind in NUMERIC:
        return f(v.col), Kind.FLOAT
    if v.kind == Kind.MIXED:
        return _mixed_number(v, f, "take the variance of"), Kind.MIXED
    raise QueryError(f"no variance of {v.kind.name}")
