"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are present or absent: words, word stems (the first letters
of words, so that inflected forms share a feature), word pairs, word triples
and skip-grams (pairs with one or two words between), hashed to ``2**BITS``
places.
FTRL-proximal has a learning rate per coordinate and L1 sparsity, so the
learned weights are few and are broadcast; their number is bounded by
``2**BITS``.

It is fitted on at most ``MAX_TRAIN_ROWS`` labelled rows, chosen and ordered
by a hash of their id, in one task (that bound is what the task holds).
``ALPHA``, ``L1`` and ``EPOCHS`` were chosen inside the rows that are not held
out: learned on CRC remainders 0 and 1, judged on 3.

Defined results: null and empty texts score by the bias alone; null labels
are left out; with no labelled rows every score is 0.5; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_or_empty

MAX_TRAIN_ROWS = 12_000
BITS = 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
THRESHOLD = 0.3
WORD_CACHE = 300_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULT = np.random.default_rng(7).integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
#: Offsets of the words that a feature joins.
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
#: Letters of the stems.
STEMS = (3, 4, 5)


class Hasher:
    """Texts -> (document number, feature place) of all features."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self._cache: dict[bytes, int] = {}

    def _words(self, text: str) -> list[tuple[int, ...]]:
        """Hashes of each word and of its stems; 0 where a word is too short."""
        cache, digest, out = self._cache, xxhash.xxh3_64_intdigest, []
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split():
            h = cache.get(w)
            if h is None:
                letters = w.decode("utf-8", "surrogatepass")
                h = cache[w] = (digest(w), *[digest(letters[:n].encode("utf-8", "surrogatepass"), n) if len(letters) > n else 0 for n in STEMS])
            out.append(h)
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, sizes = [], []
        for t in texts:
            w = self._words(t)
            words += w
            sizes.append(len(w))
        every = np.array(words, np.uint64).reshape(-1, 1 + len(STEMS))
        h = np.ascontiguousarray(every[:, 0])
        doc = np.repeat(np.arange(len(texts)), sizes)
        docs, places = [], []
        for k, shape in enumerate(SHAPES):
            reach = shape[-1]
            n = len(h) - reach
            if n <= 0:
                continue
            same = doc[:n] == doc[reach : reach + n]
            mixed = np.full(n, _MULT[k], np.uint64)
            for j, offset in enumerate(shape):
                mixed = (mixed ^ (h[offset : offset + n] * _MULT[j + 3])) * _MULT[k]
                mixed ^= mixed >> np.uint64(29)
            places.append((mixed * _MULT[7] >> self.shift)[same].astype(np.int64))
            docs.append(doc[:n][same])
        for k in range(len(STEMS)):
            has = every[:, 1 + k] > 0
            places.append((every[has, 1 + k] * _MULT[6] >> self.shift).astype(np.int64))
            docs.append(doc[has])
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(docs), np.concatenate(places)


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights by place, and the bias, from rows of distinct feature places."""
    z, n = np.zeros(2**bits), np.zeros(2**bits)
    bias_z = bias_n = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g * g
    return weights(z, n), -bias_z / ((beta + bias_n**0.5) / alpha)


def held_out(id_col: str) -> Column:
    """Whether a row is for testing: the remainder 2 of its id's CRC-32 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> tuple[dict[int, float], float]:
    """(non-zero weights by place, bias), learned only from rows not held out."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull())
    chosen = chosen.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("ord", F.xxhash64("id")).repartition(1).sortWithinPartitions("ord", "id", "text").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, features, targets = Hasher(), [], []
        for batch in batches:
            for part in pieces(batch, 64):
                doc, place = hasher(part.column(0).to_pylist())
                cuts = np.searchsorted(order := np.sort((doc << BITS) | place), np.arange(part.num_rows + 1) << BITS)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    features.append(np.unique(order[a:b] & (2**BITS - 1)).astype(np.int32))
                targets += part.column(1).to_pylist()
        weights, bias = train_ftrl(features, np.array(targets)) if features else (np.zeros(2**BITS), 0.0)
        places = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], places)), pa.int64()), pa.array(np.concatenate(([bias], weights[places])), pa.float64())], names=["place", "weight"])

    learned = {r["place"]: r["weight"] for r in rows.mapInArrow(run, "place bigint, weight double").collect()}
    return learned, learned.pop(-1, 0.0)


def score(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of every document: a map, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights
    base = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse, bias = sent.value
        weights, hasher = np.zeros(2**BITS), Hasher()
        weights[list(sparse)] = list(sparse.values())
        used = weights != 0
        for batch in batches:
            for part in pieces(batch, 64):
                doc, place = hasher(part.column(1).to_pylist())
                live = used[place]
                keys = np.unique((doc[live] << BITS) | place[live])
                total = bias + np.bincount(keys >> BITS, weights[keys & (2**BITS - 1)], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["id", "score"])

    scored = base.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
