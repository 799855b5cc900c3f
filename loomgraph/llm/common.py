"""Shared helpers: table reading, shared scratch tables, column hygiene."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path, write_scratch  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_count(df: DataFrame, row_bytes: int, task_bytes: int = 64 << 20) -> int:
    """Partitions for a range sort of a stored table: the session's number, more
    where ``row_bytes`` a row would give a partition over ``task_bytes``."""
    least = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-df.count() * row_bytes // task_bytes))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished jobs now, not when
    the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(column: str):
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def every_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of all rows, null text as the empty text."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Refuse ids that are not integers, which have no order with the others."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; ids are integers here")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows that have an id, null text as the empty text."""
    own = docs[id_col]
    return docs.where(own.isNotNull()).select(own.alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def unused_prefix(df: DataFrame, prefix: str) -> str:
    """A prefix that no column of ``df`` has, for columns that come and go."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that Python objects of few rows live at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _met(df: DataFrame, column: str, ids: DataFrame, log_bits: int, how: str) -> tuple[DataFrame, Column, list[str]]:
    """``df`` beside a bitmap of hashed ids, whether a row's bit is set, and the columns that came with it.

    The bitmap has ``2**log_bits`` bits and is broadcast: at most ``2**log_bits / 64``
    rows of two longs, whatever the input.
    """
    own = unused_prefix(df, "_map")
    at, word, bits = own + "_at", own + "_word", own + "_bits"
    place = lambda c: F.xxhash64(c.cast("bigint")).bitwiseAND(2**log_bits - 1)
    bit = lambda c: c.bitwiseAND(63).cast("int")
    words = ids.select(place(ids["id"]).alias(at)).select(F.shiftright(at, 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col(at))).alias(bits))
    words = words.groupBy(word).agg(F.bit_or(bits).alias(bits))
    met = df.withColumn(at, place(df[column])).join(F.broadcast(words), F.shiftright(at, 6) == F.col(word), how)
    return met, F.call_function("shiftright", F.col(bits), bit(F.col(at))).bitwiseAND(1) == 1, [at, word, bits]


def maybe_in(df: DataFrame, column: str, ids: DataFrame, log_bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose integer ``column`` may be among ``ids`` (column ``id``).

    No row is lost; a fuller bitmap only lets more rows through, so an exact
    join has to follow.
    """
    met, found, own = _met(df, column, ids, log_bits, "inner")
    return met.where(found).drop(*own)


def _matched(df: DataFrame, column: str, ids: DataFrame, log_bits: int, how: str) -> tuple[DataFrame, str]:
    """The rows of ``maybe_in`` joined to the ids, and the name of the column with the id met.

    ``ids`` are stored and distinct, so that no row is repeated; a semi- or
    anti-join would be pushed below the bitmap.
    """
    flag = unused_prefix(df, "_met") + "_id"
    maybe, those = maybe_in(df, column, ids, log_bits), ids.select(F.col("id").alias(flag))
    return maybe.join(those, maybe[column] == those[flag], how), flag


def rows_in(df: DataFrame, column: str, ids: DataFrame, log_bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose integer ``column`` is among ``ids`` (column ``id``); only
    rows that the bitmap lets through are shuffled."""
    rows, flag = _matched(df, column, ids, log_bits, "inner")
    return rows.drop(flag)


def not_in(df: DataFrame, column: str, ids: DataFrame, log_bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose integer ``column`` is null or not among ``ids`` (column ``id``);
    only rows that the bitmap lets through are shuffled."""
    met, found, own = _met(df, column, ids, log_bits, "left")
    clear = met.where(~F.coalesce(found, F.lit(False))).drop(*own)
    rest, flag = _matched(df, column, ids, log_bits, "left")
    return clear.union(rest.where(F.col(flag).isNull()).drop(flag))
