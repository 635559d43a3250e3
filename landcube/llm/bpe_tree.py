"""Byte-level BPE by a tree reduction over a monoid.

An element of the monoid is the encoding of a run of bytes; the product of two
neighbours is the encoding of the joined run. ``encode`` cuts a run in halves,
encodes each, and multiplies. A product re-encodes a window of tokens around the
seam, growing it until both of its edges are stable.

Why a stable edge is proof: a token sequence is the BPE encoding of its bytes if
and only if each adjacent pair of its tokens is what BPE makes of that pair's
own bytes. (Merges run in the order of their ranks; a merge across a seam would
have to happen in the pair's bytes alone before either token is complete.)
Inside the halves and inside the window all pairs hold already, so only the
pairs at the window's two edges remain to be tested.

Null text counts as empty; an empty text has no ids and the digest of no bytes.
Repeated rows are each answered, further columns are dropped, ``doc_id`` may be
null and is passed on.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import read_ranks, splitter

#: Pieces that one worker remembers; when full, all are forgotten.
CACHE = 400_000
#: Bytes of a leaf of the tree; leaves recur in many words and are remembered.
LEAF = 8
#: Bytes from which a window is merged with a heap.
LONG_WINDOW = 128
NONE = 1 << 62


class TreeBPE:
    """Ranks and the monoid over them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _window(self, data: bytes) -> list[int]:
        """BPE of a window: always the pair of lowest rank, leftmost first."""
        if len(data) > LONG_WINDOW:
            return self._long_window(data)
        ranks = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        near = [ranks(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while near:
            best = min(near)
            if best == NONE:
                break
            i = near.index(best)
            parts[i] += parts.pop(i + 1)
            del near[i]
            if i < len(near):
                near[i] = ranks(parts[i] + parts[i + 1], NONE)
            if i:
                near[i - 1] = ranks(parts[i - 1] + parts[i], NONE)
        return [self.ranks[p] for p in parts]

    def _long_window(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list, for large windows."""
        ranks, n = self.ranks.get, len(data)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # the part at i is data[i:end[i]]; end 0: gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = prev[i]
            if h >= 0 and (r := ranks(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            got = self.pairs[a, b] = self._window(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product: left and right are encodings of neighbouring runs."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        lo, hi, n, m = 1, 1, len(left), len(right)
        while True:
            data = b"".join(map(self.bytes_of.__getitem__, left[n - lo :] + right[:hi]))
            mid = self._window(data)
            ok_left = lo == n or self.stable(left[n - lo - 1], mid[0])
            ok_right = hi == m or self.stable(mid[-1], right[hi])
            if ok_left and ok_right:
                return left[: n - lo] + mid + right[hi:]
            if not ok_left:
                lo = min(n, lo * 2)
            if not ok_right:
                hi = min(m, hi * 2)

    def encode_run(self, data: bytes) -> list[int]:
        """A run of bytes by halves, without recursion deeper than its logarithm."""
        n = len(data)
        if n > LEAF:
            half = n // 2
            return self.join(self.encode_run(data[:half]), self.encode_run(data[half:]))
        got = self.leaves.get(data)
        if got is None:
            if len(self.leaves) > CACHE:
                self.leaves.clear()
            got = self.leaves[data] = self._window(data)
        return got

    def piece(self, piece: str) -> tuple[int, ...]:
        """A pre-token; one that is a vocabulary entry is that entry."""
        data = piece.encode()
        whole = self.ranks.get(data)
        got = (whole,) if whole is not None else tuple(self.encode_run(data))
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(data) <= 64:
            self.pieces[piece] = got
        return got

    def encode(self, text: str, pattern: str) -> list[int]:
        """Pre-tokens never merge with each other: their product is concatenation."""
        ids: list[int] = []
        known, add = self.pieces.get, ids.extend
        for p in splitter(pattern)(text):
            add(known(p) or self.piece(p))
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        """Concatenation up the tree, level by level."""
        level = [b"".join(map(self.bytes_of.__getitem__, chunk)) for chunk in _chunks(ids, 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def _chunks(ids, n: int) -> Iterator:
    ids = list(ids)
    return (ids[i : i + n] for i in range(0, len(ids), n))


_made: dict[str, TreeBPE] = {}


def codec(path: str) -> TreeBPE:
    """One codec per worker process and vocabulary."""
    if path not in _made:
        _made[path] = TreeBPE(read_ranks(path))
    return _made[path]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): each whole text encoded, map side only."""

    def run(batches):
        bpe = codec(vocabulary)
        for b in batches:
            out = [bpe.encode(t or "", pattern) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): null ids decode to no bytes."""

    def run(batches):
        bpe = codec(vocabulary)
        for b in batches:
            out = [bpe.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "data"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, data binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both in one pass, without moving ids between
    processes: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        bpe = codec(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, digests, back = [], [], []
                for t in part.column(1).to_pylist():
                    ids = bpe.encode(t or "", pattern)
                    n.append(len(ids))
                    digests.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
