"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``LENGTH`` bytes of a suffix matter: two suffixes that agree so
far are a repeated window.  The radix sort goes from the most significant
digit down, and after each pass drops the groups of one:

0. whole texts: a later copy of a text is covered entirely and leaves;
1. an anchor: of the 32-byte grams in a window the one of least hash (the
   rightmost of equal ones), which equal windows choose at the same place.
   About one suffix in 35 is sorted in this pass;
2. all remaining bytes through ``LENGTH``, for the windows of repeated anchors.

The order between groups is of no use, so digits are compared by hash (64
bits where a false match only costs work, 128 bits where it decides).

Equal rows are combined inside every task before each shuffle, so a passage
that very many documents share reaches a group once per task, and groups are
streamed in sorted order.  An anchor with more than ``MOST`` different windows
(a common phrase) is not held by one task: its windows are dealt once more by
their whole content.

Defined results: null text is empty; texts under ``LENGTH`` bytes lose
nothing; rows of one id have one text (equal rows get equal results); a row
without id has no place in the order, so it is compared with nothing and loses
nothing; ids that are not integers are refused; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, id_and_text, pieces, release, whole_ids, write_scratch

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20
#: Different windows of one anchor that a task holds.
MOST = 1 << 18
_POSITION = np.uint64((1 << 24) - 1)
_RNG = np.random.default_rng(424_242)
_LETTER = _RNG.integers(0, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 1 for x in _RNG.integers(2**60, 2**63, 2)]


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial hashes of substrings, for one of two bases."""

    def __init__(self, which: int):
        self.which = which
        self.base, self.inverse = _BASES[which], pow(_BASES[which], -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = _powers(self.base, 2 * len(data)), _powers(self.inverse, 2 * len(data))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[self.which][data] * self.up[: len(data)], dtype=np.uint64)))

    def at(self, sums: np.ndarray, starts, length: int) -> np.ndarray:
        return (sums[starts + length] - sums[starts]) * self.down[starts]

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return (sums[length:] - sums[:n]) * self.down[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of the windows of many texts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.roll = length, min(gram, length), Rolling(0)

    def chunks(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Joined parts of texts with, per part: text number, place in the text, size."""
        held, which, base, size, total = [], [], [], [], 0
        for k, t in enumerate(texts):
            for a in range(0, len(t) - self.length + 1, CHUNK):
                part = t[a : a + CHUNK + self.length - 1]
                held.append(part)
                which.append(k)
                base.append(a)
                size.append(len(part))
                total += len(part)
                if total >= CHUNK:
                    yield b"".join(held), np.array(which), np.array(base), np.array(size)
                    held, which, base, size, total = [], [], [], [], 0
        if held:
            yield b"".join(held), np.array(which), np.array(base), np.array(size)

    def runs(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, part, first window, last window, anchor place) of every run
        of windows that choose one anchor; places are in ``data``."""
        raw = np.frombuffer(data, np.uint8)
        h = mixed(self.roll.all(self.roll.sums(raw), self.gram))
        keys = (h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=np.uint64))
        chosen = (_POSITION - (sliding_min(keys, self.length - self.gram + 1) & _POSITION)).astype(np.int64)
        ends = np.cumsum(size)
        part = np.repeat(np.arange(len(size)), size)[: len(chosen)]
        starts = np.flatnonzero(np.arange(len(chosen)) + self.length <= ends[part])
        q = chosen[starts]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
        return h[q[first]].view(np.int64), part[starts[first]], starts[first], starts[last], q[first]


def _anchor_rows(length: int):
    """(key, h, copy, sure): an anchor and the digest of its text.

    An anchor that two texts of the batch, or two places of a text, have is
    repeated for sure: one row tells the group of its hash, the others are
    spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            hs, owners = [], []
            for part in pieces(batch):
                digests = part.column(1).to_numpy()
                for data, which, _, size in anchors.chunks(part.column(0).to_pylist()):
                    h, at, *_ = anchors.runs(data, size)
                    hs.append(h)
                    owners.append(digests[which[at]])
            if not hs:
                continue
            h, owner = np.concatenate(hs), np.concatenate(owners)
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new_h = np.concatenate(([True], h[1:] != h[:-1]))
            new = new_h | np.concatenate(([True], owner[1:] != owner[:-1]))
            group = np.cumsum(new_h) - 1
            sure = (np.bincount(group) > 1)[group]
            keep = np.flatnonzero(new)
            h, owner, sure, leads = h[keep], owner[keep], sure[keep], new_h[keep]
            spread = mixed(h.view(np.uint64) ^ mixed(owner.view(np.uint64))).view(np.int64)
            key = np.where(leads, h, spread)
            # rows of a group that does not lead are sure by now
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(owner), pa.array(sure)], names=["key", "h", "copy", "sure"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, copy) those whose anchor is repeated.

    A group is sure if any of its rows is, or if it has two texts.  Rows are
    held only while their group may go on.
    """
    key = h = copy = np.empty(0, np.int64)
    sure = np.empty(0, bool)

    def settled(key, h, copy, sure):
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
        sizes = np.bincount(group)
        live = ((sizes > 1) | (np.bincount(group, sure) > 0))[group]
        return pa.RecordBatch.from_arrays([pa.array(copy[live]), pa.array(h[live])], names=["copy", "h"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, hh, c, s = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        key, h, copy, sure = np.concatenate((key, k)), np.concatenate((h, hh)), np.concatenate((copy, c)), np.concatenate((sure, s))
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield settled(key[:cut], h[:cut], copy[:cut], sure[:cut])
            key, h, copy, sure = key[cut:], h[cut:], copy[cut:], sure[cut:]
        elif len(key) > 100_000:  # one group: surely repeated, its rows can go
            yield settled(key[:-1], h[:-1], copy[:-1], np.ones(len(key) - 1, bool))
            key, h, copy, sure = key[-1:], h[-1:], copy[-1:], np.ones(1, bool)
    if len(key):
        yield settled(key, h, copy, sure)


_CONTEXT = "h bigint, id bigint, start bigint, anchor int, context binary, stop bigint"


def _contexts(length: int):
    """Windows of repeated anchors as (h, id, start, anchor, context); a context
    that the batch has before goes out as a covered range (id, start, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            found: list[tuple[int, int, int, int, bytes]] = []
            for part in pieces(batch, 64):
                ids, texts, marks = part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2)
                sizes = np.array([len(x) for x in marks])
                flat = marks.flatten().to_numpy() if sizes.sum() else np.empty(0, np.int64)
                tag = lambda h, k: mixed(h.view(np.uint64) + mixed(k.astype(np.uint64)))
                wanted = np.unique(tag(flat, np.repeat(np.arange(len(ids)), sizes)))
                for data, which, base, size in anchors.chunks(texts):
                    h, at, first, last, q = anchors.runs(data, size)
                    live = np.isin(tag(h, which[at]), wanted)
                    shift = base - np.concatenate(([0], np.cumsum(size)[:-1]))
                    for hh, p, a, b, anchor in zip(h[live].tolist(), at[live].tolist(), first[live].tolist(), last[live].tolist(), q[live].tolist(), strict=True):
                        found.append((int(ids[which[p]]), a + int(shift[p]), hh, anchor - a, data[a : b + length]))
            found.sort(key=lambda x: x[:2])
            seen: set[tuple[int, bytes]] = set()
            rows = []
            before = None
            for i, start, hh, anchor, context in found:
                if before == (i, start):  # a repeated row
                    continue
                before = (i, start)
                if (anchor, context) in seen:
                    rows.append((None, i, start, None, None, start + len(context)))
                else:
                    seen.add((anchor, context))
                    rows.append((hh, i, start, anchor, context, None))
            if rows:
                c = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["h", "id", "start", "anchor", "context", "stop"])

    return run


_RANGE = "id bigint, start bigint, stop bigint, k1 bigint, k2 bigint"


def _ranges(ids, start, stop=None, keys=None) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    k1, k2 = (pa.array(np.asarray(k).view(np.int64)) for k in keys) if keys is not None else (none, none)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start), none if stop is None else pa.array(stop), k1, k2], names=["id", "start", "stop", "k1", "k2"])


def _covered(length: int, most: int):
    """Of contexts sorted by (h, id, start) the ranges of windows seen before, and
    (without a stop) the windows of anchors that have too many, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = Rolling(0), Rolling(1)
        open_h, open_keys, last, full = None, {}, None, False
        for batch in batches:
            for part in pieces(batch, 8192):
                keys = np.stack([part.column(k).to_numpy() for k in range(3)], axis=1)
                ahead = np.concatenate((keys[:1] - 1 if last is None else last, keys[:-1]))
                last = keys[-1:]
                part = part.filter(pa.array((keys != ahead).any(axis=1)))  # without repeated rows
                if not part.num_rows:
                    continue
                h, ids, start, anchor = (part.column(k).to_numpy() for k in range(4))
                contexts = part.column(4).to_pylist()
                raw = np.frombuffer(b"".join(contexts), np.uint8)
                size = np.array([len(x) for x in contexts])
                n = size - length + 1
                row = np.repeat(np.arange(len(n)), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum(size) - size, n) + j
                salt = mixed(h.view(np.uint64))[row] + (j - anchor[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                k1, k2 = (mixed(r.at(r.sums(raw), at, length) + salt) for r in rolls)
                order = np.lexsort((k2, k1))
                a, b = k1[order], k2[order]
                before = np.zeros(len(order), bool)
                before[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                late = np.zeros(len(order), bool)
                if h[0] == open_h:
                    held = int(np.searchsorted(row, np.searchsorted(h, open_h, "right"), "left"))
                    if full:
                        late[:held] = ~before[:held]
                    else:
                        for x in range(held):
                            if not before[x] and (int(k1[x]), int(k2[x])) in open_keys:
                                before[x] = True
                if h[-1] != open_h:
                    open_h, open_keys, full = h[-1], {}, False
                if not full:
                    tail = int(np.searchsorted(row, np.searchsorted(h, h[-1], "left"), "left"))
                    fresh = np.flatnonzero(~before[tail:]) + tail
                    places = zip(ids[row[fresh]].tolist(), (start[row[fresh]] + j[fresh]).tolist(), strict=True)
                    open_keys.update(zip(zip(k1[fresh].tolist(), k2[fresh].tolist(), strict=True), places, strict=True))
                    if len(open_keys) > most:
                        full = True
                        at_keys, at_places = np.array(list(open_keys), np.uint64), np.array(list(open_keys.values()), np.int64)
                        open_keys = {}
                        yield _ranges(at_places[:, 0], at_places[:, 1], keys=(at_keys[:, 0].copy(), at_keys[:, 1].copy()))
                if late.any():
                    r = row[late]
                    yield _ranges(ids[r], start[r] + j[late], keys=(k1[late], k2[late]))
                edge = np.concatenate(([True], row[1:] != row[:-1]))
                begin = np.flatnonzero(before & (edge | ~np.concatenate(([False], before[:-1]))))
                end = np.flatnonzero(before & (np.concatenate((edge[1:], [True])) | ~np.concatenate((before[1:], [False]))))
                r = row[begin]
                yield _ranges(ids[r], start[r] + j[begin], start[r] + j[end] + length)

    return run


def _seen_before(length: int):
    """Of windows sorted by key, id and start all but the first of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                keys = np.stack([batch.column(k).to_numpy() for k in (3, 4)], axis=1)
                ahead = np.concatenate((keys[:1] if last is None else last, keys[:-1]))
                again = (keys == ahead).all(axis=1)
                again[0] &= last is not None
                last = keys[-1:]
                ids, start = batch.column(0).to_numpy()[again], batch.column(1).to_numpy()[again]
                yield _ranges(ids, start, start + length)

    return run


def _cut(keep_text: bool):
    """Remove the union of the ranges from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 64):
                out = []
                for text, starts, stops in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    text = text.as_py()
                    kept, at, removed, spans, end = [], 0, 0, 0, -1
                    for a, b in sorted(zip(starts.as_py(), stops.as_py(), strict=True)):
                        if a > end:
                            spans += 1
                        if b > at:
                            kept.append(text[at:a] if a > at else b"")
                            removed += b - max(a, at)
                            at = b
                        end = max(end, b)
                    rest = b"".join([*kept, text[at:]])
                    out.append((removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if keep_text else None))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["id", "n_removed", "n_spans", "kept_sha256", "kept"]
                )

    return run


def covered_ranges(base: DataFrame, keyed: DataFrame, length: int = LENGTH, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(first texts: id, ranges: id, start, stop) of distinct texts; see the module."""
    spark = base.sparkSession
    long = base.where(F.octet_length("text") >= length)
    rows = long.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("copy")).mapInArrow(_anchor_rows(length), "key bigint, h bigint, copy bigint, sure boolean")
    pairs = rows.repartition("key").sortWithinPartitions("key", "copy")
    survivors, survivors_path = write_scratch(pairs.mapInArrow(_repeated, "copy bigint, h bigint"), "repeated-anchors")
    release(spark)
    firsts = keyed.where(F.col("n_bytes") >= length).groupBy("sha", "copy").agg(F.min("id").alias("id"))
    marks = survivors.groupBy("copy").agg(F.collect_set("h").alias("marks")).join(firsts, "copy").select("id", "marks")
    texts = long.select("id", F.col("text").cast("binary").alias("text")).join(marks, "id").select("id", "text", "marks")
    contexts, contexts_path = write_scratch(texts.mapInArrow(_contexts(length), _CONTEXT), "contexts")
    drop_paths(spark, survivors_path)
    release(spark)
    groups = contexts.where("h is not null").select("h", "id", "start", "anchor", "context").repartition("h").sortWithinPartitions("h", "id", "start")
    none = F.lit(None).cast("bigint")
    met, _ = write_scratch(groups.mapInArrow(_covered(length, most), _RANGE).union(contexts.where("h is null").select("id", "start", "stop", none, none)), "ranges")
    drop_paths(spark, contexts_path)
    release(spark)
    late = met.where("stop is null").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "id", "start").mapInArrow(_seen_before(length), _RANGE)
    return firsts.select("id"), met.where("stop is not null").union(late).select("id", "start", "stop")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False, most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the
    kept text (bytes that no longer form a character are replaced)."""
    whole_ids(docs, id_col)
    base = id_and_text(docs, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    keyed = base.select("id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("copy"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    firsts, ranges = covered_ranges(base, keyed, length, most)
    listed = ranges.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("r")).select("id", F.col("r.start").alias("starts"), F.col("r.stop").alias("stops"))
    wide = base.select("id", F.col("text").cast("binary").alias("text")).join(listed, "id").select("id", "text", "starts", "stops")
    cut = wide.mapInArrow(_cut(keep_text), "id bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string").dropDuplicates(["id"])
    whole = keyed.join(firsts.withColumn("is_first", F.lit(True)), "id", "left").join(cut, "id", "left")
    copy = (F.col("n_bytes") >= length) & F.col("is_first").isNull()
    out = whole.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("_kept"),
    )
    own = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    zero = F.lit(0).cast("bigint")
    nameless = docs.where(docs[id_col].isNull()).select(F.lit(None).cast("bigint").alias(id_col), F.octet_length(own).cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(own, 256).alias("kept_sha256"), own.alias("kept"))
    if not keep_text:
        return out.drop("_kept").union(nameless.drop("kept"))
    texts = base.dropDuplicates(["id"]).select(F.col("id").alias(id_col), "text")
    return out.join(texts, id_col).withColumn("kept", F.coalesce("_kept", "text")).drop("_kept", "text").union(nameless)
