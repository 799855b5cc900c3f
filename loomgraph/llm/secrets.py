"""Secret scans with an incremental blob ledger, in Spark expressions only.

Every version of a path's text is a blob named by the SHA-256 of its bytes.
The ledger (blob, rule_version, spans) is a Parquet table.  A scan looks only
at blobs that the ledger lacks for the rule version, one carrier row per blob,
appends what it finds (blobs without findings too), and joins the ledger back
to all paths.

Spans are ``kind:start:end`` in code points, end exclusive.  Kinds: the base
ones ``assign``, ``access`` and ``hex``, and two of the method's own, ``pem``
(private-key headers) and ``jwt``.

Positions are running sums over the gaps between matches, taken in chunks, so
that a text's cost does not grow with the square of its matches.

Defined results: null text is empty and has no span; every row gets its own
text's spans, whether its id is null, repeated or another text's too; an empty
table gives an empty table; copies share one ledger row; further columns are
ignored (kept by ``redact``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import every_text, text_or_empty, unused_prefix, write_scratch

RULES_VERSION = "2"
#: Fixed patterns; kind, pattern, least code points of a match.  Runs of one
#: class are matched with their least length at once, which gives the same
#: leftmost matches as filtering whole runs.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE_KINDS = KINDS[:3]
LEAST_VALUE = 6
LEDGER_SCHEMA = "blob binary, rule_version string, spans array<struct<start:bigint,kind_no:int,end:bigint>>"


#: Matches that are put together at once.
CHUNK = 256
NO_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _per_chunk(items: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of each chunk of an array and its number; at least one chunk."""
    last = F.greatest(F.ceil(F.size(items) / CHUNK) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: use(F.slice(items, c * CHUNK + 1, F.lit(CHUNK)), c))


def _running(totals: Column, add: Callable[[Column, Column], Column]) -> Column:
    """0 and the running totals of an array with one entry for each chunk."""
    return F.aggregate(totals, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(add(F.element_at(done, -1), x))))


def _matches(text: Column, pattern: str, kind_no: int, value_group: int = 0, least: int = 0) -> Column:
    """All matches as (start, kind_no, end): gaps by splitting, matches by extraction."""
    length = lambda x: F.char_length(x).cast("bigint")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    columns = [F.transform(F.split(text, pattern, -1), length).alias("gap"), F.transform(found, length).alias("len")]
    if least:
        columns.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), length).alias("value"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end")))
        keep = x["len"].isNotNull() & (x["value"] >= least if least else F.lit(True))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def spans(pairs):
        sizes = _per_chunk(pairs, lambda part, _c: F.aggregate(part, F.lit(0).cast("bigint"), lambda n, x: n + x["gap"] + F.coalesce(x["len"], F.lit(0))))
        start = lambda at: F.struct(at.alias("at"), F.array().cast(NO_SPANS).alias("spans"))
        return _bound(_running(sizes, lambda n, x: n + x), lambda bases: F.flatten(_per_chunk(pairs, lambda part, c: F.aggregate(part, start(F.get(bases, c)), step)["spans"])))

    return F.when(text.rlike(pattern), _bound(F.arrays_zip(*columns), spans)).otherwise(F.array().cast(NO_SPANS))


def spans_of(text: Column) -> Column:
    """All spans of a text, by start and then by kind as listed."""
    return F.array_sort(
        F.concat(_matches(text, ASSIGN, 0, 2, LEAST_VALUE), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _matches(text, PEM, 3), _matches(text, JWT, 4))
    )


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger; an absent one is empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan(docs: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Update the ledger; return id, blob and spans of every row."""
    base = every_text(docs, id_col, text_col).withColumn("blob", F.unhex(F.sha2("text", 256)))
    keyed = base.select("id", "blob")
    known = read_ledger(docs.sparkSession, ledger_path).where(F.col("rule_version") == RULES_VERSION).select("blob")
    carriers = keyed.groupBy("blob").agg(F.min("id").alias("carrier")).join(known, "blob", "left_anti").withColumnRenamed("blob", "missing")
    unseen = base.join(carriers, (base["blob"] == carriers["missing"]) & base["id"].eqNullSafe(carriers["carrier"]))
    (
        unseen.select("blob", F.lit(RULES_VERSION).alias("rule_version"), spans_of(F.col("text")).alias("spans"))
        .write.mode("append").option("compression", "zstd").parquet(ledger_path)
    )
    return keyed.join(_findings(docs, ledger_path), "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))


def _findings(docs: DataFrame, ledger_path: str) -> DataFrame:
    """(blob, spans) of the blobs with spans; a stored side, so that a blob of very
    many paths can be split."""
    seen = read_ledger(docs.sparkSession, ledger_path).where((F.col("rule_version") == RULES_VERSION) & (F.size("spans") > 0))
    return write_scratch(seen.groupBy("blob").agg(F.max("spans").alias("spans")), "findings")[0]


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, digest of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("bigint")
    base = F.filter(F.col("spans"), lambda s: s["kind_no"] < len(BASE_KINDS))
    return found.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans")
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the union of the spans replaced, overlaps once.

    A chunk of spans is laid over its own stretch of the text: the stretch goes
    from where the spans before it end to where it ends itself.
    """
    cut = lambda x, at, n: F.substring(x, (at + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))

    def step(acc, s, stretch, begin):
        fresh = s["start"] >= acc["at"]
        gap = cut(stretch, acc["at"] - begin, s["start"] - acc["at"])
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def stretches(bases):
        def one(part, c):
            begin = F.get(bases, c)
            start = F.struct(F.lit("").alias("out"), begin.alias("at"))
            return _bound(cut(text, begin, F.get(bases, c + 1) - begin), lambda x: F.aggregate(part, start, lambda acc, s: step(acc, s, x, begin))["out"])

        return F.concat(F.array_join(_per_chunk(spans, one), ""), cut(text, F.element_at(bases, -1), F.lit(2147483647)))

    ends = _per_chunk(spans, lambda part, _c: F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), F.lit(0)))
    return F.when(F.size(spans) > 0, _bound(_running(ends, lambda n, x: F.greatest(n, x)), stretches)).otherwise(text)


def redact(docs: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, secrets in their text replaced; other columns kept.

    Rows are matched by blob, so ids play no part.
    """
    q = unused_prefix(docs, "_s")
    scan(docs, ledger_path, id_col, text_col)
    found = _findings(docs, ledger_path).select(F.col("blob").alias(f"{q}blob"), F.col("spans").alias(f"{q}spans"))
    joined = docs.withColumn(f"{q}blob", F.unhex(F.sha2(text_or_empty(text_col), 256))).join(found, f"{q}blob", "left")
    spans = F.col(f"{q}spans")
    out = joined.withColumn(text_col, F.when(spans.isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), spans)))
    return out.select(*docs.columns)
