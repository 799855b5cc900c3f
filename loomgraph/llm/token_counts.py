"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens).
Texts are normalised (null to empty, nothing else, since the count must be the
raw text's), digested, and joined to the cache; of the misses one carrier row
per distinct digest is encoded, and the new counts are appended.

Copies of one text meet only in partial aggregates and in a join against a
side with unique keys, which adaptive execution can split.

Defined results: null and empty text count 0 tokens; an empty table gives an
empty table and appends nothing; every row is returned with its own text's count,
whether its id is null, repeated or another text's too; a row that repeats id
and text may be encoded again, which readers of the cache fold; further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import every_text, pieces, write_scratch

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def file_digest(path: str) -> str:
    """Identity of a tokenizer version: digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """texts -> counts, by the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache table; an absent one is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Counts for all documents; appends the distinct misses to the cache.

    A lost append leaves no partial file behind (Spark's commit protocol);
    a repeated one would add equal rows, so readers take one row per key.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    base = every_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = base.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select(F.col("content_digest").alias("digest"))
    carriers = keyed.groupBy("digest").agg(F.min("id").alias("carrier")).join(known, "digest", "left_anti").withColumnRenamed("digest", "missing")
    todo = base.join(carriers, (base["digest"] == carriers["missing"]) & base["id"].eqNullSafe(carriers["carrier"])).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            for part in pieces(batch, 64):
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    todo.mapInArrow(run, CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    counts = counts.groupBy(F.col("content_digest").alias("digest")).agg(F.max("n_tokens").alias("n_tokens"))
    counts, _ = write_scratch(counts, "token-counts")  # a stored side, so that a digest of very many rows can be split
    return keyed.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
