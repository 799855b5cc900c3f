"""MinHash near-duplicate detection with an LSH forest.

Documents of equal shingle sets are one node.  Each node's signature gives
``TREES`` sorted orders, each starting at another place of the signature.  In
every order a node is compared with its next ``NEIGHBOURS`` nodes that share
at least ``LEAST_DEPTH`` values: the neighbours of longest common prefix, so
the depth adapts itself to how dense a region is.  A candidate whose set sizes
or whose sketches (four bits of 64 signature values) rule out the similarity
is dropped on the spot: at 0.75 the sketch errs in one case of 10^7.  The rest
are confirmed on full shingle sets.

Two waves keep large groups cheap: adjacent pairs of the first orders join
most of a group; later pairs are confirmed only between different components,
which loses no component.

Runs of equal least prefix that are longer than the neighbour window are
settled in two rounds.  Their rows get a fine sketch (two bits of 1,024 more hash
values), which rules out what is below 0.66 similar; it errs in one case of
10^7.  First the rows outside a run's largest component meet all its rows in
other components, and the best four partners of each are confirmed, so that a
centre with many copies joins them.  Then the rows with partners left meet all
rows still apart, full sets at hand, and only links leave the task, one for each
pair of components.  Rows and partners are dealt in a grid of chunks, which
bounds what a task holds.  Sketches are compared for all pairs that are apart:
where very many documents are alike but below the limit, that work is their
number squared.

At 0.75 similarity a pair shares three values in some of 32 orders but for
3 in 10^8 cases; a range-sorted order spreads a region of any size over tasks.

Defined results: a text of one to four words is one shingle; null or word-less
texts have none and are linked with nothing; copies and repeated rows form one
component; an empty table gives an empty table; further columns are ignored
(kept by ``keep_one``).  Ids are integers, others are refused; a row without one
is compared with nothing: it comes out with a null component, and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, id_and_text, maybe_in, not_in, pieces, range_count, release, rows_in, whole_ids, write_scratch
from .components import connected_components

SHINGLE_WORDS = 5
HASHES = 128
TREES = 32
STRIDE = HASHES // TREES
DEPTH = 6
LEAST_DEPTH = 3
NEIGHBOURS = 8
FIRST_WAVE_TREES = 2
#: Partners of a row in the first round over long runs; the second tries all.
PARTNERS = 4
#: Rows on either side of what one task compares at once in a long run.
CHUNK = 256
MIN_PERCENT = 75
#: Signature values in a sketch, and how many must agree at MIN_PERCENT: five
#: standard deviations below the mean.
SKETCH = 64
_EXPECTED = MIN_PERCENT / 100 + (1 - MIN_PERCENT / 100) / 16
LEAST_AGREEING = int(SKETCH * _EXPECTED - 5.2 * (SKETCH * _EXPECTED * (1 - _EXPECTED)) ** 0.5)
#: Values in the fine sketch of a long run's rows, two bits each, and how many
#: must agree, in the same way.
FINE = 1024
_FINE_EXPECTED = MIN_PERCENT / 100 + (1 - MIN_PERCENT / 100) / 4
FINE_AGREEING = int(FINE * _FINE_EXPECTED - 5.2 * (FINE * _FINE_EXPECTED * (1 - _FINE_EXPECTED)) ** 0.5)
WORD_CACHE = 300_000

_RNG = np.random.default_rng(20_240_601)
_ODD = (_RNG.integers(0, 2**32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, HASHES, np.uint64).astype(np.uint32)[:, None]
_PLACE = _RNG.integers(0, 2**63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_ODD = (_RNG.integers(0, 2**32, FINE, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_FINE_ADD = _RNG.integers(0, 2**32, FINE, np.uint64).astype(np.uint32)[:, None]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Distinct five-word shingles of a text as sorted 64-bit hashes."""

    def __init__(self):
        self._cache: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < SHINGLE_WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        cache, digest = self._cache, xxhash.xxh3_64_intdigest
        if len(cache) > WORD_CACHE:
            cache.clear()
        ids = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = digest(w)
            ids.append(h)
        ids = np.array(ids, np.uint64)
        n = len(ids) - SHINGLE_WORDS + 1
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE_WORDS):
            total += ids[k : k + n] * _PLACE[k]
        return np.unique(_mixed(total))


def signature(shingles: np.ndarray, odd: np.ndarray = _ODD, add: np.ndarray = _ADD) -> np.ndarray:
    """Least value of each hash function over the set."""
    low = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    small = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(small), 2048):
        low = np.minimum(low, (small[None, i : i + 2048] * odd + add).min(axis=1))
    return low


def fine_sketch(shingles: np.ndarray) -> bytes:
    """Two bit planes of FINE values; the middle bits, since the lowest ones of a
    product vary least."""
    values = signature(shingles, _FINE_ODD, _FINE_ADD) >> np.uint32(16)
    return np.packbits(np.stack((values & 1, values >> 1 & 1)).astype(np.uint8), axis=1).tobytes()


_SIGNED = "id bigint, n_shingles bigint, digest binary, sig binary, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in pieces(batch):
            n, digests, signatures, sketches = [], [], [], []
            for x in part.column(1):
                s = shingler(x.as_py())
                n.append(len(s))
                sig = signature(s)
                low = (sig[HASHES - SKETCH :] & np.uint32(15)).astype(np.uint8)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(sig.astype(">u4").tobytes() if len(s) else None)
                sketches.append((low[::2] << 4 | low[1::2]).tobytes() if len(s) else None)
            columns = [part.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, signatures, sketches)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "digest", "sig", "sketch"])


def _near(rows: tuple[np.ndarray, ...], fresh: int) -> pa.RecordBatch:
    """Pairs of a row from ``fresh`` on with up to NEIGHBOURS rows before it."""
    tree, keys, ids, n, sketch = rows
    least = 4 * LEAST_DEPTH
    out_a, out_b, first = [], [], []
    for gap in range(1, NEIGHBOURS + 1):
        lo = max(0, fresh - gap)
        if lo + gap >= len(ids):
            continue
        a, b = slice(lo, len(ids) - gap), slice(lo + gap, len(ids))
        same = (tree[a] == tree[b]) & (keys[a, :least] == keys[b, :least]).all(axis=1) & (ids[a] != ids[b])
        same &= 100 * np.minimum(n[a], n[b]) >= MIN_PERCENT * np.maximum(n[a], n[b])
        at = np.flatnonzero(same)
        if len(at):
            differ = sketch[a][at] ^ sketch[b][at]
            at = at[((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1) >= LEAST_AGREEING]
        if len(at):
            x, y = ids[a][at], ids[b][at]
            out_a.append(np.minimum(x, y))
            out_b.append(np.maximum(x, y))
            first.append((tree[b][at] < FIRST_WAVE_TREES) & (gap == 1))
    empty = np.empty(0, np.int64)
    cat = lambda xs, none: np.concatenate(xs) if xs else none
    return _row_batch("pair", cat(out_a, empty), cat(out_b, empty), cat(first, np.empty(0, bool)), [None] * sum(map(len, out_a)))


def _row_batch(kind: str, a, b, first, keys) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(a), pa.string()), pa.array(np.asarray(a), pa.int64()), pa.array(np.asarray(b), pa.int64()), pa.array(np.asarray(first, bool)), pa.array(keys, pa.binary())],
        names=["kind", "a", "b", "first", "key"],
    )


_ROWS = "kind string, a bigint, b bigint, first boolean, key binary"


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """tree, key, id, set size and sketch of sorted rows."""
    fixed = lambda k, width: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, width)
    return batch.column(0).to_numpy(), fixed(1, 4 * DEPTH), batch.column(2).to_numpy(), batch.column(3).to_numpy(), fixed(4, SKETCH // 2)


def _packed(rows: tuple[np.ndarray, ...]) -> list[bytes]:
    return [b"".join((int(t).to_bytes(4, "big"), k.tobytes(), int(n).to_bytes(8, "big"), s.tobytes())) for t, k, _, n, s in zip(*rows, strict=True)]


def _unpacked(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(k for k, _ in rows), np.uint8).reshape(len(rows), -1)
    a, b = 4 + 4 * DEPTH, 12 + 4 * DEPTH
    number = lambda x: np.array([int.from_bytes(r.tobytes(), "big") for r in x])
    return number(raw[:, :4]), raw[:, 4:a], np.array([i for _, i in rows], np.int64), number(raw[:, a:b]), raw[:, b:]


class _LongRuns:
    """Rows of runs longer than the neighbour window.  The first and the last
    run of a partition go out too, since they may go on in another one."""

    def __init__(self):
        self.held = self.key = None
        self.going = True

    @staticmethod
    def _batch(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        tree, keys, ids, n, _ = rows
        data = np.concatenate((tree.astype(">i4").view(np.uint8).reshape(-1, 4), keys[:, : 4 * LEAST_DEPTH]), axis=1)
        return _row_batch("run", ids, n, np.zeros(len(ids), bool), [x.tobytes() for x in data])

    def add(self, rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            rows = tuple(np.concatenate(x) for x in zip(self.held, rows, strict=True))
        tree, keys = rows[0], rows[1][:, : 4 * LEAST_DEPTH]
        starts = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(tree)))
        out = sizes > NEIGHBOURS + 1
        out[0] |= self.going and self.key in (None, (tree[0], keys[0].tobytes()))
        self.key, self.going = (tree[-1], keys[-1].tobytes()), bool(out[-1])
        self.held = None if self.going else tuple(x[starts[-1] :] for x in rows)
        if out.any():
            yield self._batch(tuple(x[np.repeat(out, sizes)] for x in rows))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            yield self._batch(self.held)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within a sorted partition; its first and last rows go out too, so
    that pairs across partitions can be made of them."""
    part = TaskContext.get().partitionId()
    last = head = None
    runs = _LongRuns()
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, fresh = _arrays(batch), 0
        yield from runs.add(rows)
        if last is not None:
            fresh = len(last[0])
            rows = tuple(np.concatenate(x) for x in zip(last, rows, strict=True))
        yield _near(rows, fresh)
        if head is None or fresh < NEIGHBOURS:
            head = tuple(x[:NEIGHBOURS] for x in rows)
        last = tuple(x[-NEIGHBOURS:] for x in rows)
    yield from runs.rest()
    if head is not None:
        for kind, rows in (("head", head), ("tail", last)):
            yield _row_batch(kind, rows[2], np.full(len(rows[2]), part), np.zeros(len(rows[2]), bool), _packed(rows))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs between the end of a partition and the start of the next ones."""
    ends: dict[tuple[int, str], list[tuple[bytes, int]]] = {}
    for batch in batches:
        for kind, a, b, _, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ends.setdefault((b, kind), []).append((key, a))
    order = lambda row: (row[0][: 4 + 4 * DEPTH], row[1])
    carry: list[tuple[bytes, int]] = []
    for part in sorted({p for p, _ in ends}):
        head, tail = sorted(ends[part, "head"], key=order), sorted(ends[part, "tail"], key=order)
        if carry:
            yield _near(_unpacked(carry + head), len(carry))
        carry = (carry + tail if len(tail) < NEIGHBOURS else tail)[-NEIGHBOURS:]


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, n_shingles, sig, sketch) -> distinct (a, b, first) of the
    neighbour windows, and the rows (run, id, n) of longer runs."""
    spark = nodes.sparkSession
    twice = F.concat("sig", "sig")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.select("id", twice.alias("twice"), tree.alias("tree"), "n_shingles", "sketch")
    rows = rows.select("tree", F.expr(f"substring(twice, tree * {4 * STRIDE} + 1, {4 * DEPTH})").alias("key"), "id", "n_shingles", "sketch")
    parts = range_count(nodes, TREES * (8 * DEPTH + SKETCH))
    ranged = rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found, _ = write_scratch(ranged.mapInArrow(_scan, _ROWS), "forest-pairs")
    # two times NEIGHBOURS rows of each partition: bounded by their number
    ends = found.where("kind in ('head', 'tail')").coalesce(1).mapInArrow(_across, _ROWS)
    runs = found.where("kind = 'run'").select(F.col("key").alias("run"), F.col("a").alias("id"), F.col("b").alias("n"))
    return found.where("kind = 'pair'").union(ends).groupBy("a", "b").agg(F.max("first").alias("first")), runs


def _planes(sketches: list[bytes]) -> np.ndarray:
    """Fine sketches as words: plane, word, row."""
    return np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), 2, -1).transpose(1, 2, 0))


_DEALT = ("run", "pc", "rc", "probe", "id", "n", "component", "sketch")


class _Cell:
    """Rows of one cell of a run's grid: probes against rows of other components."""

    def __init__(self, rows: list[tuple]):
        _, _, _, probe, ids, n, component, sketch, *sets = zip(*rows, strict=True)
        self.ids, self.n, self.component, self.planes = np.array(ids, np.int64), np.array(n, np.int64), np.array(component, np.int64), _planes(sketch)
        self.sets = sets[0] if sets else ()
        probe = np.array(probe)
        self.p, self.r = np.flatnonzero(probe), np.flatnonzero(~probe)

    def fits(self) -> tuple[np.ndarray, np.ndarray]:
        """(agreeing values, whether a pair is worth trying), probe by row."""
        agree = np.full((len(self.p), len(self.r)), FINE, np.int64)
        for low, high in zip(*self.planes, strict=True):
            agree -= np.bitwise_count((low[self.p][:, None] ^ low[self.r][None, :]) | (high[self.p][:, None] ^ high[self.r][None, :]))
        a, b = self.n[self.p][:, None], self.n[self.r][None, :]
        apart = self.component[self.p][:, None] != self.component[self.r][None, :]
        return agree, (agree >= FINE_AGREEING) & apart & (100 * np.minimum(a, b) >= MIN_PERCENT * np.maximum(a, b))

    def best(self) -> Iterator[pa.RecordBatch]:
        """(p, r, agree, more): best partners; ``more`` if others remain."""
        agree, fit = self.fits()
        more = fit.sum(axis=1) > PARTNERS
        if len(self.r) > PARTNERS:
            top = np.argpartition(np.where(fit, -agree, 1), PARTNERS - 1, axis=1)[:, :PARTNERS]
            chosen = np.zeros_like(fit)
            np.put_along_axis(chosen, top, True, axis=1)
            fit &= chosen
        x, y = np.nonzero(fit)
        if len(x):
            columns = [pa.array(self.ids[self.p[x]]), pa.array(self.ids[self.r[y]]), pa.array(agree[x, y]), pa.array(more[x])]
            yield pa.RecordBatch.from_arrays(columns, names=["p", "r", "agree", "more"])

    def links(self, min_percent: int) -> Iterator[pa.RecordBatch]:
        """(a, b): a confirmed pair for each pair of components that has one."""
        agree, fit = self.fits()
        x, y = np.nonzero(fit)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.argsort(-agree[x, y], kind="stable"):
            i, j = self.p[x[k]], self.r[y[k]]
            key = tuple(sorted((int(self.component[i]), int(self.component[j]))))
            if key not in found:
                both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                if 100 * both >= min_percent * (len(self.sets[i]) + len(self.sets[j]) - both):
                    found[key] = (int(self.ids[i]), int(self.ids[j]))
        if found:
            a, b = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _own_arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each list as an array of its own, eight bytes a number."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]


def _cells(use):
    """``use`` of each cell of rows sorted by run and chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done():
            cell = _Cell(held)
            if len(cell.p) and len(cell.r):
                yield from use(cell)

        for batch in batches:
            for part in pieces(batch):
                columns = [c.to_pylist() if not pa.types.is_list(c.type) else _own_arrays(c) for c in part.columns]
                for row in zip(*columns, strict=True):
                    if held and held[0][:3] != row[:3]:
                        yield from done()
                        held = []
                    held.append(row)
        if held:
            yield from done()

    return run


def _labelled(rows: DataFrame, component: DataFrame) -> DataFrame:
    """Rows with ``component``; a node without links is its own."""
    of = component.select("id", F.col("component").alias("_of"))
    return rows.join(of, "id", "left").select(*rows.columns, F.coalesce("_of", "id").alias("component"))


def _chunks(rows):
    """Chunks of a side of a run's grid."""
    return F.ceil(rows / CHUNK).cast("int")


def _dealt(rows: DataFrame, signed: DataFrame, parts: int) -> DataFrame:
    """Stored rows (run, id, n, component, chosen, pcs, rcs) in a grid for each run:
    the chosen ones on one side, all on the other; each is repeated for the other
    side's chunks.  Sketches (and sets) come from ``signed``."""
    at = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = rows.where("chosen").join(signed, "id").withColumn("pc", at(1, "pcs")).withColumn("rc", every("rcs")).withColumn("probe", F.lit(True))
    own = rows.join(signed, "id").withColumn("rc", at(2, "rcs")).withColumn("pc", every("pcs")).withColumn("probe", F.lit(False))
    both = probes.unionByName(own).select(*_DEALT, *[c for c in signed.columns if c == "set"])
    return both.repartition(parts, "run", "pc", "rc").sortWithinPartitions("run", "pc", "rc")


def _open_rows(rows: DataFrame, component: DataFrame, open_ids: DataFrame) -> DataFrame:
    """Rows of the runs that hold an open id (column ``p``) and several components,
    for the second round.  Each meets the sizes of its run once."""
    spark = rows.sparkSession
    rows = _labelled(rows.select("run", "id", "n"), component).join(open_ids, F.col("id") == F.col("p"), "left")
    rows, path = write_scratch(rows.withColumn("chosen", F.col("p").isNotNull()).drop("p"), "run-rows")
    sizes = rows.groupBy("run").agg(_chunks(F.count(F.when(F.col("chosen"), 1))).alias("pcs"), _chunks(F.count("*")).alias("rcs"), (F.min("component") < F.max("component")).alias("apart"))
    met, _ = write_scratch(rows.join(sizes.where("pcs > 0 and apart").drop("apart"), "run"), "run-rows")
    drop_paths(spark, path)
    return met


def settle_runs(base: DataFrame, runs: DataFrame, tested: DataFrame, component: DataFrame, min_percent: int) -> DataFrame:
    """Components after every pair of a long run that is still apart was tried.

    ``tested``: pairs (a, b) already confirmed or refused.  Texts of the rows
    concerned are read once, for sets and fine sketches.
    """
    each = _labelled(runs.select("run", "id"), component).groupBy("run", "component").agg(F.count("*").alias("k"))
    mixed = each.groupBy("run").agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("components"))
    mixed = mixed.where((F.col("k") > NEIGHBOURS + 1) & (F.col("components") > 1))
    mixed, _ = write_scratch(mixed.select("run", "largest", _chunks(F.col("k") - F.col("most")).alias("pcs"), _chunks(F.col("k")).alias("rcs")), "mixed-runs")
    if mixed.isEmpty():
        return component
    rows = _labelled(runs.join(mixed, "run"), component).withColumn("chosen", F.col("component") != F.col("largest"))
    rows, _ = write_scratch(rows.drop("largest"), "run-rows")
    ids = rows.select("id").distinct()
    signed = _texts_of(base, ids).mapInArrow(_sets_and_sketches, "id bigint, set array<bigint>, sketch binary")
    signed, _ = write_scratch(signed, "run-sets")
    parts = range_count(signed, TREES * FINE // 4)
    found = _dealt(rows, signed.select("id", "sketch"), parts).mapInArrow(_cells(_Cell.best), "p bigint, r bigint, agree bigint, more boolean")
    best = found.groupBy("p").agg(F.sort_array(F.collect_set(F.struct((-F.col("agree")).alias("rank"), "r"))).alias("best"), F.max("more").alias("more"))
    best, _ = write_scratch(best.select("p", F.slice("best", 1, PARTNERS).alias("best"), (F.col("more") | (F.size("best") > PARTNERS)).alias("more")), "best-partners")
    fresh = best.select("p", F.explode("best.r").alias("r")).select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    component = _joined(component, confirmed(fresh, signed.select("id", "set"), min_percent))
    open_ids = best.where("more").select("p")
    if open_ids.isEmpty():
        return component
    parts = range_count(signed, TREES * (FINE // 4 + 8 * int(signed.agg(F.avg(F.size("set"))).first()[0] or 0)))
    links = _dealt(_open_rows(rows, component, open_ids), signed, parts).mapInArrow(_cells(lambda cell: cell.links(min_percent)), "a bigint, b bigint")
    return _joined(component, links)


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def _sets_and_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in pieces(batch, 64):
            sets = [shingler(x.as_py()) for x in part.column(1)]
            columns = [part.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([fine_sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "set", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in pieces(batch):
            sets = [shingler(x.as_py()).view(np.int64) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])


def confirmed(pairs: DataFrame, sets: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = 100 * both >= min_percent * (F.size("sa") + F.size("sb") - both)
    # sizes alone rule out most false candidates before sets are intersected
    lo, hi = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    return pairs.join(a, "a").join(b, "b").where((100 * lo >= min_percent * hi) & near).select("a", "b")


def _needed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """One (id, text) of each of the distinct ids; repeated ids go before the texts
    become sets, which are larger."""
    # an inner join adds no row here; a semi-join would be pushed below the bitmap
    return maybe_in(base, "id", ids).join(ids, "id").select("id", "text").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_percent: int = MIN_PERCENT) -> DataFrame:
    """id, n_shingles, component_id (least id of the component) and kept.

    Orders, sizes and sketches are laid out for MIN_PERCENT, so a lower limit is
    refused.
    """
    if min_percent < MIN_PERCENT:
        raise ValueError(f"min_percent is {min_percent}; pairs below {MIN_PERCENT} are not searched")
    whole_ids(docs, id_col)
    base = id_and_text(docs, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    spark = docs.sparkSession
    wide, wide_path = write_scratch(base.mapInArrow(_sign, _SIGNED), "signatures")
    signed, _ = write_scratch(wide.select("id", "n_shingles", "digest"), "digests")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("node"))
    copies = signed.where("n_shingles > 0").select("id").join(classes.select(F.col("node").alias("id")), "id", "left_anti").distinct()
    copies, _ = write_scratch(copies, "copies")
    nodes = not_in(wide.where("n_shingles > 0").select("id", "n_shingles", "sig", "sketch"), "id", copies)
    pairs, runs = candidate_pairs(nodes)
    pairs, _ = write_scratch(pairs, "candidates")
    drop_paths(spark, wide_path)
    release(spark)
    sets, sets_path = write_scratch(_texts_of(base, _needed(pairs)).mapInArrow(_sets, "id bigint, set array<bigint>"), "shingle-sets")
    first, _ = write_scratch(confirmed(pairs.where("first"), sets, min_percent), "links")
    joined = connected_components(first, stored=True)
    ca, cb = joined.select(F.col("id").alias("a"), F.col("component").alias("ca")), joined.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = pairs.where(~F.col("first")).join(ca, "a", "left").join(cb, "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    release(spark)
    component = connected_components(first.union(confirmed(rest, sets, min_percent)))
    drop_paths(spark, sets_path)
    release(spark)
    component = settle_runs(base, runs, pairs.select("a", "b"), component, min_percent)
    of_class = classes.join(component, classes["node"] == component["id"], "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    of_class, _ = write_scratch(of_class, "classes")  # a stored side, so that a digest of very many rows can be split
    full = signed.where("n_shingles > 0").select("id", "n_shingles", "digest").join(of_class, "digest").select("id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    named = full.union(empty).select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    none = F.lit(None).cast("bigint")
    nameless = docs.where(docs[id_col].isNull()).select(F.lit(0).cast("bigint").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    sizes = nameless.mapInArrow(_sign, _SIGNED).select(none.alias(id_col), "n_shingles", none.alias("component_id"), F.lit(True).alias("kept"))
    return named.union(sizes)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, all columns kept.

    Rows without id are compared with nothing and all stay.  Of rows that repeat
    a kept id and its text one stays; another text of that id stays too.
    """
    rows = near_duplicates(docs.where(docs[id_col].isNotNull()), id_col, text_col, **options)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.count(F.when(F.col("kept"), 1)).alias("rows"))
    # ids whose rows do not simply stay, which are few: other rows pass without a shuffle
    marked, _ = write_scratch(rows.where("rows <> 1"), "not-once")
    release(docs.sparkSession)
    often = rows_in(docs, id_col, marked.where("rows > 1").select("id")).dropDuplicates([id_col, text_col])
    return not_in(docs, id_col, marked.select("id")).union(often)
