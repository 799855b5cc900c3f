"""Benchmark decontamination by sharded training suffix arrays.

Each shard (a slice of documents) gets a suffix array over its words, cut
where the words leave the benchmark's vocabulary: a suffix whose next words
are not all benchmark words cannot begin a window, so leaving it out loses
nothing.  Every suffix of every benchmark item is binary-searched in it; the
run of equal prefixes gives the places of all verbatim matches, and walking
them on gives the longest match.

The benchmark is cut in blocks of at most ``block_words`` words, so what a
task holds has a fixed bound; an item beyond it is cut in parts that overlap by
a window less one word, which loses no window.  One pass over the documents is
made per block and the passes are merged per document.  A worker process lays
a block out for search once, not once a task.

Defined results: null or word-less texts have no words and no hits; items
without words have no window; repeated items all count; an item without id hits
words but is not listed; of an item in several parts ``longest`` is that within
a part; an empty benchmark or table is fine; further columns of the inputs are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, write_scratch

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 400_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all non-ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Queries:
    """The windows of a block of benchmark items, ready for binary search."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        #: window length -> window -> [(item, offset in the item)]
        self.by_length: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        get = self.vocabulary
        for k, (_, text) in enumerate(items):
            ids = np.array([get.setdefault(w, len(get)) for w in words_of(text)], ">u4")
            if n := len(ids):
                m = min(n, window)
                for i in range(n - m + 1):
                    self.by_length.setdefault(m, {}).setdefault(ids[i : i + m].tobytes(), []).append((k, i))
        self.wanted = {m: np.frombuffer(b"".join(w), np.dtype((np.void, 4 * m))) for m, w in self.by_length.items()}

    def search(self, ids: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
        """ids: words of a shard, -1 for words the benchmark lacks and between documents.

        Returns which words are hit, and the longest match in words of each
        (document, item) pair.
        """
        n = len(ids)
        edges = np.zeros(n + 1, np.int64)
        found: list[tuple[int, int, int, int, int]] = []
        stops = np.where(ids >= 0, n, np.arange(n))
        run = (np.minimum.accumulate(stops[::-1])[::-1] if n else stops) - np.arange(n)
        for m, windows in self.by_length.items():
            at = np.flatnonzero(run >= m)
            if not len(at):
                continue
            keys = np.ascontiguousarray(ids[at[:, None] + np.arange(m)].astype(">u4")).view(np.dtype((np.void, 4 * m))).ravel()
            order = np.argsort(keys, kind="stable")  # the suffix array to this depth
            ranked = keys[order]
            lo, hi = np.searchsorted(ranked, self.wanted[m], "left"), np.searchsorted(ranked, self.wanted[m], "right")
            meets = list(windows.values())
            for q in np.flatnonzero(hi > lo):
                places = at[order[lo[q] : hi[q]]]
                np.add.at(edges, places, 1)
                np.add.at(edges, places + m, -1)
                found += [(int(d), k, int(p) - i, int(p), m) for p, d in zip(places, doc_of[places], strict=True) for k, i in meets[q]]
        longest: dict[tuple[int, int], int] = {}
        found.sort()
        before, length = None, 0
        for d, k, diagonal, p, m in found:
            length = length + 1 if before == (d, k, diagonal, p - 1) else m
            before = (d, k, diagonal, p)
            longest[d, k] = max(length, longest.get((d, k), 0))
        return np.cumsum(edges[:-1]) > 0, longest


def _item_parts(text: str, window: int, most: int) -> Iterator[tuple[str, int]]:
    """An item in parts of at most ``most`` words, with a bound on their words."""
    bound = 1 + len(text) // 2
    if bound <= most:
        yield text, bound
        return
    words = words_of(text)
    step = max(most - window + 1, 1)
    for start in range(0, max(len(words) - window + 1, 1), step):
        part = words[start : start + step + window - 1]
        yield b" ".join(part).decode("utf-8", "surrogatepass"), len(part)


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``block_words`` words, streamed through the driver."""
    most = max(block_words, 2 * window)
    block, size, given = [], 0, 0
    for name, text in benchmark.toLocalIterator():
        for part, words in _item_parts(text, window, most):
            if block and size + words > most:
                yield block
                block, size, given = [], 0, given + 1
            block.append((name, part))
            size += words
    if block or not given:
        yield block


def _search_texts(queries: Queries, texts: pa.Array) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray, dict[tuple[int, int], int]]]:
    """Shards of whole texts: (number of the first, words in each, which words are
    hit, text of each word, longest matches); a word stands between texts."""
    start = 0
    while start < len(texts):
        shard, sizes, get = [], [], queries.vocabulary.get
        while start + len(sizes) < len(texts) and len(shard) < SHARD_WORDS:
            words = words_of(texts[start + len(sizes)].as_py() or "")
            shard += [get(w, -1) for w in words]
            shard.append(-1)
            sizes.append(len(words))
        doc_of = np.repeat(np.arange(len(sizes)), np.array(sizes) + 1)
        hit, longest = queries.search(np.array(shard, np.int64), doc_of)
        yield start, sizes, hit, doc_of, longest
        start += len(sizes)


def _index_of(held: dict, window: int) -> Queries:
    """The block of a broadcast, laid out; the broadcast outlives a task."""
    if "index" not in held:
        held["index"] = Queries(held["items"], window)
    return held["index"]


def find_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: id, n_words, spans (array of hit word ranges,
    end exclusive) and matches (array of item and longest match in words)."""
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"), F.lit(0).cast("bigint").alias("row"))
    items = benchmark.select(F.col(item_col).cast("string"), text_or_empty(item_text))
    blocks = _blocks(items, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is not None:  # the passes are put together by stored row numbers
        slim, _ = write_scratch(slim.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, matches array<struct<item:string,longest:bigint>>"
    types = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("item", pa.string()), ("longest", pa.int64())]))
    parts = []
    for block in chain((first, second) if second is not None else (first,), blocks):
        sent = spark.sparkContext.broadcast({"items": block})  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = _index_of(sent.value, window)
            for batch in batches:
                for start, sizes, hit, doc_of, longest in _search_texts(queries, batch.column(1)):
                    n = len(sizes)
                    spans: list[list[dict]] = [[] for _ in sizes]
                    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                    base = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
                    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                        d = doc_of[a]
                        spans[d].append({"start": int(a - base[d]), "end": int(b - base[d])})
                    best: dict[tuple[int, str], int] = {}
                    for (d, k), length in longest.items():
                        best[d, queries.names[k]] = max(length, best.get((d, queries.names[k]), 0))
                    matches: list[list[dict]] = [[] for _ in sizes]
                    for (d, item), length in best.items():
                        matches[d].append({"item": item, "longest": length})
                    columns = [batch.column(0).slice(start, n), batch.column(2).slice(start, n), pa.array(sizes, pa.int64()), pa.array(spans, types[0]), pa.array(matches, types[1])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n_words", "spans", "matches"])

        parts.append(slim.mapInArrow(run, schema))
    if len(parts) == 1:
        return parts[0].drop("row").withColumnRenamed("id", id_col)
    merged = None
    for part in parts:
        merged = part if merged is None else merged.unionByName(part)
    return (
        merged.groupBy("row", "id", "n_words")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches"))
        .withColumn("spans", _merged_spans("spans"))
        .drop("row")
        .withColumnRenamed("id", id_col)
    )


def _merged_spans(column: str):
    """Union of ranges: sort, then extend or append."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["start"] <= F.when(F.size(done) > 0, last["end"]))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(F.col(column)), empty, step)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and matches."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item"]))))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without any benchmark window, all their columns kept.

    Every row is judged by its own text in a map, whatever its id; blocks are
    maps one after another, so nothing is shuffled.
    """
    kept, at = docs, [c.lower() for c in docs.columns].index(text_col.lower())
    for block in _blocks(benchmark.select(F.col(item_col).cast("string"), text_or_empty(item_text)), window, block_words):
        sent = docs.sparkSession.sparkContext.broadcast({"items": block})  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = _index_of(sent.value, window)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, _, hit, doc_of, _ in _search_texts(queries, batch.column(at)):
                    clean[start + np.unique(doc_of[hit])] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
