"""Best-fit-decreasing packing of token sequences.

Pieces of equal length are interchangeable, so the placement depends on the
histogram of lengths alone: at most ``capacity`` counts, however many documents.
The planner takes lengths in decreasing order; a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and all bins of equal
remainder are filled in one step, which is just what best-fit decreasing does
piece by piece. The plan is a list of runs: ranks within a length to bins. Its
size follows the capacity (each length splits one interval of bins and opens two
at most), not the documents, and so it travels with the tasks.

Ranks within a length are counted in two levels (length and hash bucket, then
buckets in order), so that a length that holds a third of all pieces is spread.

Null and empty texts are one piece, the end id alone. Repeated rows are packed
each. A null ``doc_id`` is passed on. Further columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written
from .pretokens import parts

CAPACITY = 4096
END = 1
END_BYTES = np.array([END], "<u4").tobytes()
#: Words that one worker remembers beyond those in hand; when full, all are forgotten.
CACHE = 1_000_000
#: Texts of these characters alone are split here as the library would split them:
#: their normal form is themselves, and their lower case needs no context.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ]*").fullmatch
#: The library's split (a fixed value of the vocabulary file), and what it comes
#: to for lower-case texts of those characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PLAIN_SPLIT = f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+"
SPLIT_KEY = ("pre_tokenizer", "pretokenizers", 0, "pattern", "Regex")


class WordEncoder:
    """The library's ids, remembering those of single words.

    Words not yet known go to the library many at a time, apart by line ends,
    which its split drops; a token that ends a word says where each stops.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            at = json.load(f)
        ending = at["model"]["end_of_word_suffix"]
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if ending and t.endswith(ending)]] = True
        for k in SPLIT_KEY:
            at = at[k]
        self.plain = at == SPLIT
        self.find = re.compile(PLAIN_SPLIT).findall
        self.words = Tokenizer.from_file(path)  # for words in normal form already
        self.words.normalizer = None
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for lo in range(0, len(fresh), 500):
            some = fresh[lo : lo + 500]
            ids = np.array(self.words.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some):
                data, at = ids.tobytes(), 0
                for w, end in zip(some, (4 * stop).tolist()):
                    out[w] = data[at:end]
                    at = end
            else:
                out.update((w, self.whole(w)) for w in some)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [self.find(t.lower()) if self.plain and "<|" not in t and PLAIN(t) else None for t in texts]
        used: set[str] = set()
        for w in words:
            used.update(w or ())
        known = self.known
        if len(known) + len(used) > CACHE:
            known.clear()
        known.update(self.learn(sorted(used.difference(known))))
        get = known.__getitem__
        return [self.whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and
    the end id, cut only where longer than the capacity."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            for part in parts(b):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for i, got in enumerate(enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.frombuffer(got + END_BYTES, "<u4")
                    for p, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at : at + capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            data.append(cut.astype(np.int32))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(data, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Remainders:
    """Segment tree over remaining capacities: which have an open bin."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.n, bool)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, r: int) -> None:
        i = r + self.n
        self.some[i] = bool(self.bins[r])
        i >>= 1
        while i:
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]
            i >>= 1

    def push(self, r: int, first: int, n: int) -> None:
        if r and n:
            self.bins[r].append((first, n))
            self._mark(r)

    def pop(self, r: int) -> tuple[int, int]:
        got = self.bins[r].pop()
        self._mark(r)
        return got

    def tightest(self, need: int) -> int | None:
        """The smallest remainder of at least ``need`` with an open bin."""
        i = need + self.n
        if self.some[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces a bin, first bin, offset), and the bins."""
    open_, runs, bins = Remainders(capacity), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            r = open_.tightest(size)
            if r is None:
                r, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = open_.pop(r)
            each = r // size
            take = min(left, n * each)
            full, rest = divmod(take, each)
            runs.append((size, rank, each, first, capacity - r))
            open_.push(r, first + full + bool(rest), n - full - bool(rest))
            open_.push(r - each * size, first, full)
            if rest:
                open_.push(r - rest * size, first + full, 1)
            rank, left = rank + take, left - take
    return np.array(runs, np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    store = Written(spark)
    cut = store.write(pieces(docs, vocabulary, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs, _ = plan(counts, capacity)
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)).cast("int"))
    before = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    keys = runs[:, 0] << 40 | runs[:, 1]

    def place(batches):
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = order[np.searchsorted(sorted_, size << 40 | rank, "right") - 1]
            nth, each = rank - runs[at, 1], runs[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(runs[at, 3] + nth // each), pa.array(runs[at, 4] + nth % each * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each of at most
    ``capacity`` ids. ``doc_id`` has to be unique in ``docs``."""
    ids = pieces(docs, vocabulary, capacity, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
