"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that are not yet known stand behind each other in one
array of symbols, with the sequence of each symbol beside it. In a round every
sequence finds the lowest rank among its adjacent pairs and replaces all of that
pair's occurrences, left to right, at once; sequences without a ranked pair drop
out. What survives is counted. All occurrences may go at once because a merge
only ever makes pairs of later rank.

Null text counts as empty: 0 bytes, 0 tokens. Special strings in a text are one
token each, as the library's default has it. Repeated rows are each answered,
further columns are dropped, ``doc_id`` may be null and is passed on.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pretokens import byte_letters, parts, splitter

#: Pre-tokens that one worker remembers; when full, all are forgotten.
CACHE = 600_000
#: Symbols that are merged in one go.
BATCH = 1 << 20
NONE = np.int64(1) << 62


class RankMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        keys, ranks, to = [], [], []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            keys.append(vocab[a] << 32 | vocab[b])
            ranks.append(rank)
            to.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.to = np.array(to, np.int64)  # by rank
        special = [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.firsts = {s[0] for s in special}  # a text without any of them holds no special string
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        out = np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(sym), NONE)  # of the pair that begins at each symbol
        same = np.flatnonzero(seq[:-1] == seq[1:])
        rank[same] = self._rank(sym[same], sym[same + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(seq)])
            done = low == NONE
            out[seq[start[done]]] = length[done]
            each = np.repeat(low, length)
            hit = np.flatnonzero((rank == each) & (each != NONE))
            if not len(hit):
                break
            # in a run of overlapping hits every second one holds, from its first
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) > 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.to[each[hit]]
            keep = np.repeat(~done, length)
            keep[hit + 1] = False
            new = (np.cumsum(keep) - 1)[hit]  # where the merged symbols stand now
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            old = np.unique(np.r_[new, new - 1])
            old = old[old >= 0]
            inside = np.zeros(len(old), bool)
            inside[old + 1 < len(seq)] = seq[old[old + 1 < len(seq)]] == seq[old[old + 1 < len(seq)] + 1]
            rank[old] = NONE
            rank[old[inside]] = self._rank(sym[old[inside]], sym[old[inside] + 1])
        return out

    def count(self, texts: list[str | None], pattern: str) -> list[int]:
        find, known = splitter(pattern), self.known
        split: list[list[str]] = []
        extra: list[int] = []
        for t in texts:
            t, n = t or "", 0
            if self.special is not None and any(c in t for c in self.firsts) and (found := self.special.findall(t)):
                n = len(found)
                pieces = [p for part in self.special.split(t) for p in find(part)]
            else:
                pieces = find(t)
            split.append(pieces)
            extra.append(n)
        fresh: set[str] = set()
        for pieces in split:
            fresh.update(pieces)
        fresh.difference_update(known)
        todo, data, size = [], [], 0
        local: dict[str, int] = {}
        for p in fresh:
            todo.append(p)
            data.append(p.encode())
            size += len(data[-1])
            if size >= BATCH:
                local.update(zip(todo, self.merge(data).tolist()))
                todo, data, size = [], [], 0
        if todo:
            local.update(zip(todo, self.merge(data).tolist()))
        if len(known) + len(local) > CACHE:
            again = {p for pieces in split for p in pieces} & known.keys()
            local |= {p: known[p] for p in again}
            known.clear()
        if len(local) <= CACHE:
            known.update(local)
            local = known
        get = local.__getitem__
        return [sum(map(get, pieces)) + n for pieces, n in zip(split, extra)]


@functools.lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; map side only."""

    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            for part in parts(b):
                texts = part.column(1).to_pylist()
                n = np.array(m.count(texts, pattern), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
