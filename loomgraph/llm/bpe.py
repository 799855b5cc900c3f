"""Byte-level BPE encoding and decoding by monoid tree reduction.

A pre-token that is no token itself is cut in halves down to single bytes, and
the encodings of the halves are joined up the tree, by looking at the tokens
beside the cut.  The join is proved by the pair rule of BPE: a token sequence is
*the* encoding of its bytes exactly if every adjacent token pair is the encoding
of its own two tokens' bytes.  So, if the two tokens at the cut form such a pair,
both sides stand as they are; otherwise a window around the cut is encoded anew
by ranks and grown until the pairs at both of its edges hold.  Short halves and
pairs recur and are remembered.  Decoding is the concatenation of token bytes,
which is associative, up the same tree.

Defined results: null text is the empty text (no ids, digest of nothing);
ties and repeated rows are encoded alike; an empty table gives an empty table;
further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, text_or_empty

CACHE_ENTRIES = 200_000
#: Halves up to so many bytes are remembered.
HALF_BYTES = 6


class TreeBPE:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        # every way to make a token of two others: (left, right) -> token
        self.merges = {(ranks[b[:k]] << 32) | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.single = [ranks.get(bytes([x]), -1) for x in range(256)]
        self._pairs: dict[int, tuple[int, ...] | None] = {}
        self._halves: dict[bytes, tuple[int, ...]] = {}
        self._cache: dict[str, tuple[str, int, bytes]] = {}
        self._older: dict[str, tuple[str, int, bytes]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> TreeBPE:
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def by_ranks(self, data: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        single, get, none = self.single, self.merges.get, 1 << 62
        ids = [single[x] for x in data]
        made = [get((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while made:
            token = min(made)
            if token == none:
                break
            k = made.index(token)
            ids[k : k + 2] = [token]
            del made[k]
            if k:
                made[k - 1] = get((ids[k - 1] << 32) | token, none)
            if k < len(made):
                made[k] = get((token << 32) | ids[k + 1], none)
        return tuple(ids)

    def _pair(self, a: int, b: int) -> tuple[int, ...] | None:
        """The encoding of two tokens' joint bytes; None if that is a then b."""
        key, pairs = (a << 32) | b, self._pairs
        if key in pairs:
            return pairs[key]
        made = self.by_ranks(self.bytes_of[a] + self.bytes_of[b])
        if len(pairs) >= CACHE_ENTRIES:
            pairs.clear()
        pairs[key] = out = None if made == (a, b) else made
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joint bytes of two encodings."""
        window = self._pair(left[-1], right[0]) if left and right else None
        if window is None:
            return left + right
        i = j = 1
        while True:
            ok_left = i == len(left) or self._pair(left[-i - 1], window[0]) is None
            ok_right = j == len(right) or self._pair(window[-1], right[j]) is None
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if ok_left else min(2 * i, len(left)), j if ok_right else min(2 * j, len(right))
            window = self.by_ranks(self.decode(left[-i:]) + self.decode(right[:j]))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Encode one pre-token; a whole-token match wins, as in the library."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Halves encoded and joined; the depth is the logarithm of the length."""
        got = self._halves.get(data)
        if got is not None:
            return got
        n = len(data)
        if n < 2:
            return tuple([self.single[x] for x in data])
        out = self.join(self.tree(data[: n >> 1]), self.tree(data[n >> 1 :]))
        if n <= HALF_BYTES:
            if len(self._halves) >= CACHE_ENTRIES:
                self._halves.clear()
            self._halves[data] = out
        return out

    def decode(self, ids: tuple[int, ...] | list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.encode_bytes(m.group().encode("utf-8"))
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, digest of the ids in decimal, digest of the decoded bytes).

        Leaves of the document's tree are its pre-tokens: no token crosses
        them, so the joins above are plain concatenations and can be streamed.
        """
        n = 0
        ids_hash, bytes_hash = hashlib.sha256(), hashlib.sha256()
        found = self.split.findall(text) if len(text) < 1_000_000 else None
        stream = [found] if found is not None else self._blocks(text)
        first = True
        for block in stream:
            known = list(map(self._cache.get, block))
            if None in known:
                known = [self._piece(piece) if got is None else got for piece, got in zip(block, known, strict=True)]
            if known:
                n += sum([x[1] for x in known])
                ids_hash.update((("" if first else " ") + " ".join([x[0] for x in known])).encode("ascii"))
                bytes_hash.update(b"".join([x[2] for x in known]))
                first = False
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        """Ids in decimal, their number and their bytes, kept for short pieces: of two
        generations the older is dropped whole, pieces in use move to the younger."""
        got = self._cache.get(piece) or self._older.get(piece)
        if got is None:
            ids = self.encode_bytes(piece.encode("utf-8"))
            got = (" ".join(map(str, ids)), len(ids), self.decode(ids))
            if len(piece) > 64:
                return got
        if len(self._cache) >= CACHE_ENTRIES:
            self._older, self._cache = self._cache, {}
        self._cache[piece] = got
        return got

    def _blocks(self, text: str, size: int = 100_000) -> Iterator[list[str]]:
        block: list[str] = []
        for m in self.split.finditer(text):
            block.append(m.group())
            if len(block) >= size:
                yield block
                block = []
        yield block


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode and decode every whole text: a map over partitions, no shuffle.

    Returns id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids``
    also ids and the decoded text.
    """
    slim = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    sent = docs.sparkSession.sparkContext.broadcast({})  # outlives a task: a worker process lays the tables out once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "bpe" not in sent.value:
            sent.value["bpe"] = TreeBPE.from_file(ranks_path, pattern)
        bpe = sent.value["bpe"]
        for batch in batches:
            for part in pieces(batch):
                rows = [bpe.digests(x.as_py()) for x in part.column(1)]
                n, ids, decoded = zip(*rows, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    full = [bpe.encode(x.as_py()) for x in part.column(1)]
                    columns += [pa.array(full, pa.list_(pa.int32())), pa.array([bpe.decode(x).decode("utf-8", "replace") for x in full], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
