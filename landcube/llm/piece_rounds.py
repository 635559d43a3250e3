"""Encoding and decoding with a sentence-piece vocabulary, by vectorised merge rounds.

The words of a batch that are not yet known stand behind each other in one flat
array of symbols, cut into segments where no piece of the vocabulary holds the
two neighbouring characters. In a round every segment finds the best rank among
its pairs of neighbours and merges all places of that rank, from the left, at
once; then the arrays are compacted, and segments without a pair drop out.

Merging at once is exact as long as no merge makes a pair of the same or a better
rank, which would come before places further right. A segment in which that
happens is merged one place at a time for that rank (``Pieces.one_by_one``).

Null text counts as empty: no ids. Characters outside the vocabulary become the
pieces of their UTF-8 bytes. Repeated rows are each answered, further columns are
dropped, the id column may be null and is passed on.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import parts

SPACE = "▁"
#: Words that one worker remembers; when full, all are forgotten.
CACHE = 400_000
#: Characters that are merged in one go.
BATCH = 1 << 20
NONE = np.int64(1) << 62
GONE = np.int64(-1) << 62
#: Kinds of pieces as the model file numbers them.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


def _matches(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``want`` would stand in the sorted ``keys``, and whether it does."""
    at = np.searchsorted(keys, want)
    at[at == len(keys)] = 0
    return at, keys[at] == want


class Pieces:
    """A vocabulary, its pairs and what is known of words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        normal = dict(_fields(next(v for k, v in top if k == 3)))
        pieces = [{1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(v)) for k, v in top if k == 1]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only byte-fallback BPE models without rewriting of text are supported")
        if {p[3] for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if normal.get(3, 1) else ""
        text = [p[1].decode() for p in pieces]
        ids = {text[i]: i for i, p in enumerate(pieces) if p[3] == NORMAL}
        # equal scores have equal ranks: the place decides
        score = np.array([struct.unpack("<f", p[2])[0] for p in pieces], np.float32)
        rank = np.unique(-score, return_inverse=True)[1]
        pairs = [(ids[t[:k]] << 32 | ids[t[k:]], rank[i], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        pairs.sort()
        self.keys, self.ranks, self.to = (np.array(x, np.int64) for x in zip(*pairs))
        self.chars, self.char_ids = (np.array(x, np.int64) for x in zip(*sorted((ord(t), i) for t, i in ids.items() if len(t) == 1)))
        self.joined = np.array(sorted({ord(a) << 32 | ord(b) for t in ids for a, b in zip(t, t[1:])}), np.int64)
        self.byte_ids = {int(text[i][1:-1], 16): i for i, p in enumerate(pieces) if p[3] == BYTE}
        # a word is blanks and what follows them, if no piece goes on past a letter with a blank
        blank = ord(SPACE)
        inner = {int(k) >> 32 for k in self.joined} | {int(k) & 0xFFFFFFFF for k in self.joined}
        apart = "".join(re.escape(chr(c)) for c in range(128) if c not in inner)
        whole = any(int(k) & 0xFFFFFFFF == blank and int(k) >> 32 != blank for k in self.joined)
        self.words = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|[{apart}]+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self._pair: dict[int, tuple[int, int] | None] = {}
        self.bytes_of = [{UNKNOWN: " ⁇ ".encode(), CONTROL: b"", BYTE: bytes([int(t[1:-1], 16)]) if p[3] == BYTE else b""}.get(p[3], t.replace(SPACE, " ").encode()) for t, p in zip(text, pieces)]
        self.control = {i for i, p in enumerate(pieces) if p[3] == CONTROL}
        self.blank_first = [p[3] == NORMAL and t.startswith(SPACE) for t, p in zip(text, pieces)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs; symbols below 0 are characters without a piece."""
        at, found = _matches(self.keys, left << 32 | right & 0xFFFFFFFF)
        found &= (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NONE), self.to[at]

    def pair(self, left: int, right: int) -> tuple[int, int] | None:
        if left < 0 or right < 0:
            return None
        key = left << 32 | right
        if key not in self._pair:
            if len(self._pair) > CACHE:
                self._pair.clear()
            at, found = _matches(self.keys, np.array([key]))
            self._pair[key] = (int(self.ranks[at[0]]), int(self.to[at[0]])) if found[0] else None
        return self._pair[key]

    def one_by_one(self, sym: list[int], limit: int) -> list[int | None]:
        """Merge pairs of rank ``limit`` or better, the best first and the leftmost
        of equals, until none is left; None stands where a symbol went."""
        n, out = len(sym), list(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := self.pair(out[i], out[j])) and p[0] <= limit:
                heapq.heappush(heap, (p[0], i, out[i], out[j], p[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right, to = heapq.heappop(heap)
            j = after[i]
            if out[i] != left or j >= n or out[j] != right:
                continue  # one of the two has gone on
            out[i], out[j], after[i] = to, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as little-endian 32-bit integers."""
        cp = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at, found = _matches(self.chars, cp)
        sym = np.where(found, self.char_ids[at], -1 - cp)
        first = np.zeros(len(cp), bool)
        first[np.cumsum(size) - size] = True
        first[1:] |= ~_matches(self.joined, cp[:-1] << 32 | cp[1:])[1]
        seg = np.cumsum(first)
        out, pos = sym.copy(), np.arange(len(sym))  # ``out`` by the place of a symbol's first character
        rank, to = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)  # of the pair that begins at each symbol
        same = np.flatnonzero(seg[:-1] == seg[1:])
        rank[same], to[same] = self._rank(sym[same], sym[same + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            length = np.diff(np.r_[start, len(seg)])
            each = np.repeat(np.minimum.reduceat(rank, start), length)
            if (each == NONE).any():  # those segments are done
                out[pos[each == NONE]] = sym[each == NONE]
                keep = each != NONE
                sym, seg, pos, rank, to, each = sym[keep], seg[keep], pos[keep], rank[keep], to[keep], each[keep]
                continue
            hit = np.flatnonzero(rank == each)
            # in a run of overlapping places every second one holds, from its first
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) > 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            made = to[hit]
            slow = self._comes_first(sym, seg, rank[hit], hit, made)
            keep = np.ones(len(sym), bool)
            stale = []
            if len(slow):
                lo = np.searchsorted(seg, slow)
                hi = np.searchsorted(seg, slow, "right")
                fast = ~np.isin(seg[hit], slow)
                for a, b in zip(lo.tolist(), hi.tolist()):
                    done = self.one_by_one(sym[a:b].tolist(), int(each[a]))
                    keep[a:b] = [x is not None for x in done]
                    sym[a:b] = [GONE if x is None else x for x in done]
                    stale.append(np.flatnonzero(keep[a:b]) + a)
                hit, made = hit[fast], made[fast]
            sym[hit] = made
            keep[hit + 1] = False
            out[pos[~keep]] = GONE
            place = np.cumsum(keep) - 1  # where the symbols that stay stand now
            new = place[np.concatenate([hit, *stale])]
            sym, seg, pos, rank, to = sym[keep], seg[keep], pos[keep], rank[keep], to[keep]
            touched = np.zeros(len(seg) + 1, bool)
            touched[new], touched[new - 1] = True, True  # before the first one: the spare last
            rank[touched[:-1]] = NONE
            old = np.flatnonzero(touched[:-2] & (seg[:-1] == seg[1:]))
            rank[old], to[old] = self._rank(sym[old], sym[old + 1])
        return self._by_word(out, size)

    def _comes_first(self, sym, seg, rank, hit, made) -> np.ndarray:
        """Segments in which a merge at ``hit`` makes a pair that comes before, or
        is equal to, the pair that was merged."""
        n = len(sym)
        left = hit - 1
        has = (left >= 0) & (seg[np.maximum(left, 0)] == seg[hit])
        beside = sym[np.maximum(left, 0)]
        follows = np.flatnonzero(np.diff(hit) == 2) + 1  # the neighbour has just been merged as well
        beside[follows] = made[follows - 1]
        bad = has & (self._rank(beside, made)[0] <= rank)
        right = np.minimum(hit + 2, n - 1)
        has = (hit + 2 < n) & (seg[right] == seg[hit])
        bad |= has & (self._rank(made, sym[right])[0] <= rank)
        return np.unique(seg[hit[bad]]) if bad.any() else hit[:0]

    def _by_word(self, out: np.ndarray, size: np.ndarray) -> list[bytes]:
        stays = out != GONE
        ends = np.cumsum(stays)[np.cumsum(size) - 1]
        ids = out[stays]
        if (ids < 0).any():  # bytes for the characters without a piece
            split = [[int(x)] if x >= 0 else [self.byte_ids[b] for b in chr(-1 - x).encode()] for x in ids.tolist()]
            ends = np.cumsum([0, *map(len, split)])[ends]
            ids = np.array([i for x in split for i in x], np.int64)
        data, ends = ids.astype("<i4").tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text."""
        known = self.known
        split = [self.words((self.prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        fresh = {w for words in split for w in words}.difference(known)
        local: dict[str, bytes] = {}
        todo: list[str] = []
        size = 0
        for w in fresh:
            todo.append(w)
            size += len(w)
            if size >= BATCH:
                local.update(zip(todo, self.merge(todo)))
                todo, size = [], 0
        if todo:
            local.update(zip(todo, self.merge(todo)))
        if len(known) + len(local) > CACHE:
            again = {w for words in split for w in words} & known.keys()
            local |= {w: known[w] for w in again}
            known.clear()
        if len(local) <= CACHE:
            known.update(local)
            local = known
        get = local.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]

    def decode(self, ids) -> str:
        """The text of ids, without the blank that stands before each text."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        head = next((i for i in ids if self.bytes_of[i]), None) if self.prefix else None
        skip = int(head is not None and self.blank_first[head])
        if self.control.isdisjoint(ids):
            return data[skip:].decode("utf-8", "each_byte")
        # bytes on both sides of a control piece make no character together
        runs = [b"".join(self.bytes_of[i] for i in run) for is_control, run in itertools.groupby(ids, self.control.__contains__) if not is_control]
        return "".join(run.decode("utf-8", "each_byte") for run in runs)[skip:]


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One vocabulary per worker process and file."""
    return Pieces(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): each whole text encoded, map side only."""

    def run(batches):
        p = pieces(vocabulary)
        for b in batches:
            for part in parts(b):
                ids = p.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): null ids decode to an empty text."""

    def run(batches):
        p = pieces(vocabulary)
        for b in batches:
            texts = [p.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both in one pass, without moving ids between
    processes: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        p = pieces(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            for part in parts(b):
                ids = p.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(str, x.tolist()))) for x in ids], pa.string()),
                     pa.array([sha(p.decode(x)) for x in ids], pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
