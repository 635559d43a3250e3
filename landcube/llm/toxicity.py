"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct lower-case words and their beginnings of four to
six letters, each hashed to 32 bits. The machine scores

    w0 + sum(w[i]) + (1 / k) * sum over pairs i<j of <v[i], v[j]>

over the k terms present, so that a pair (an insult beside the mention of a group)
can weigh more than its two words. Only terms that tell the classes apart in the
training rows (log-likelihood ratio) carry weights, by themselves or in a pair of
common terms, of which neither may say anything alone: unknown words and the
length of a text say nothing.

Fitting uses at most ``Params.train_rows`` labelled documents, those whose ``doc_id``
has the smallest hashes, and of rows that share an id the least text; texts of equal
terms teach once, and not at all if their labels differ, so that the model does not
depend on the order of rows. Everything else covers all rows. Rows with a null text
count as empty and get the score of no terms, as do empty texts. Labels that are
null, ambiguous (an id labelled both ways) or without a document teach nothing;
with no toxic or no clean label the score is a constant, below 0.5 unless all
labels are toxic. Repeated rows are each answered; further columns of either
table are ignored. A null ``doc_id`` is never held out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Params:
    train_rows: int = 12_000  #: bound on the labelled rows that are fitted
    max_terms: int = 4_096  #: bound on the terms that carry weights
    min_llr: float = 24.0
    common_terms: int = 512  #: bound on the common terms whose pairs are looked at
    pair_terms: int = 128  #: bound on the terms that carry weights for their pairs
    pair_llr: float = 60.0  #: over that of the pair's better term
    rank: int = 4
    steps: int = 150
    rate: float = 0.1
    l2: float = 2e-5
    fold: int = 5  #: rows whose crc32 leaves 0 are held out


@dataclass
class Model:
    bias: float
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, at: list[int]) -> float:
        if not at:
            return self.bias
        v = self.factors[at]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()) / len(at))


def term_hashes(word: str) -> tuple[int, ...]:
    out = [zlib.crc32(("w " + word).encode())]
    for n in (4, 5, 6):
        if len(word) >= n:
            out.append(zlib.crc32((f"p{n} " + word[:n]).encode()))
    return tuple(out)


def held_out(doc_id: Column, fold: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == 0, F.lit(False))


def _features(batches):
    for b in batches:
        out = []
        for t in b.column(1).to_pylist():
            seen: set[int] = set()
            for w in set(WORD((t or "").lower())):
                seen.update(term_hashes(w))
            out.append(np.sort(np.fromiter(seen, np.uint32, len(seen))).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["toxic", "terms"])


def training_rows(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(toxic int, terms binary) of at most ``train_rows`` labelled rows; the
    documents stay where they are, as the chosen labels are few by that bound."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), p.fold))
        .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most"))
        .where("toxic = most").select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    return rows.mapInArrow(_features, "toxic int, terms binary")


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    seen: dict[bytes, tuple[np.ndarray, set[int]]] = {}
    table = training_rows(docs, labels, p).toArrow()
    for terms, toxic in zip(table.column("terms"), table.column("toxic").to_pylist()):
        data = terms.as_buffer()  # a view: the rows stay where Arrow has them
        seen.setdefault(hashlib.blake2b(data, digest_size=16).digest(), (np.frombuffer(data, np.uint32), set()))[1].add(toxic)
    once = [(terms, min(toxic)) for terms, toxic in seen.values() if len(toxic) == 1]
    x, y = [t for t, _ in once], [k for _, k in once]
    order = sorted(range(len(x)), key=lambda i: (int(x[i].sum(dtype=np.uint64)), len(x[i]), x[i].tobytes()))  # the same from any row order
    return _fit([x[i] for i in order], np.array([y[i] for i in order], float), p)


def _fit(x: list[np.ndarray], y: np.ndarray, p: Params) -> Model:
    none = np.zeros(0, np.uint32)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return Model(6.0 if pos else -6.0, none, np.zeros(0), np.zeros((0, p.rank)))
    row, col, names = _choose(x, y, pos, neg, p)
    m = len(names)
    rng = np.random.default_rng(7)
    w0, w, v = np.log(pos / neg), np.zeros(m), rng.normal(0, 0.02, (m, p.rank))
    moments = [np.zeros(1), np.zeros(m), np.zeros((m, p.rank))], [np.zeros(1), np.zeros(m), np.zeros((m, p.rank))]
    share = 1 / np.maximum(np.bincount(row, minlength=len(y)), 1)
    sums = lambda values: np.bincount(row, values, len(y))
    for step in range(1, p.steps + 1):
        s = np.stack([sums(v[col, f]) for f in range(p.rank)], axis=1) if m else np.zeros((len(y), p.rank))
        z = w0 + sums(w[col]) + 0.5 * share * ((s * s).sum(axis=1) - sums((v[col] ** 2).sum(axis=1)))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        each = (err * share)[row][:, None] * (s[row] - v[col])
        grads = [np.array([err.sum()]), np.bincount(col, err[row], m) + p.l2 * w,
                 np.stack([np.bincount(col, each[:, f], m) for f in range(p.rank)], axis=1) + 10 * p.l2 * v]
        move = []
        for g, a, b in zip(grads, *moments):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            move.append(p.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        w0, w, v = w0 - move[0][0], w - move[1], v - move[2]
    return Model(float(w0), names, w, v)


def _choose(x: list[np.ndarray], y: np.ndarray, pos: float, neg: float, p: Params):
    """(row, column) of the chosen terms' presences, and the terms.

    Presences are first counted in 2**22 buckets, a few rows at a time, so that
    memory follows the bound on the rows' chosen terms and not on all terms.
    """
    buckets = 1 << 22
    n1, n = np.zeros(buckets, np.int32), np.zeros(buckets, np.int32)
    for a, t in zip(x, y):
        at = a & (buckets - 1)
        np.add.at(n, at, 1)
        if t:
            np.add.at(n1, at, 1)
    hopeful = np.zeros(buckets, bool)
    for lo in range(0, buckets, 1 << 18):
        part = slice(lo, lo + (1 << 18))
        hopeful[part] = _llr(n1[part].astype(float), (n - n1)[part].astype(float), pos, neg) >= p.min_llr / 2
    # the buckets of the most common terms, for pairs
    middle = np.minimum(n, len(x) - n)
    often = np.argsort(-middle, kind="stable")[: 2 * p.common_terms]
    hopeful[often[middle[often] >= max(8, len(x) // 100)]] = True
    del n, n1, middle
    kept = [a[hopeful[a & (buckets - 1)]] for a in x]
    row = np.repeat(np.arange(len(x)), [len(a) for a in kept])
    term = np.concatenate(kept) if len(row) else np.zeros(0, np.uint32)
    names, at = np.unique(term, return_inverse=True)
    n1, n = np.bincount(at, y[row], len(names)), np.bincount(at, minlength=len(names))
    llr = _llr(n1, n - n1, pos, neg)
    chosen = np.argsort(-llr, kind="stable")[: p.max_terms]
    chosen = chosen[llr[chosen] >= p.min_llr]
    chosen = np.unique(np.r_[chosen, _paired(row, at, y, n, llr, pos, neg, p)]).astype(int)
    to = np.full(len(names), -1)
    to[chosen] = np.arange(len(chosen))
    keep = to[at] >= 0 if len(at) else np.zeros(0, bool)
    return row[keep], to[at][keep], names[chosen]


def _paired(row, at, y, n, llr, pos, neg, p: Params) -> np.ndarray:
    """The terms of those pairs of common terms that tell the classes apart
    clearly better than either term alone."""
    middle = np.minimum(n, len(y) - n)
    some = np.argsort(-middle, kind="stable")[: p.common_terms]
    some = some[middle[some] >= max(8, len(y) // 100)]
    if len(some) < 2:
        return np.zeros(0, int)
    to = np.full(len(n), -1)
    to[some] = np.arange(len(some))
    there = to[at] >= 0
    x = np.zeros((len(y), len(some)), np.float32)
    x[row[there], to[at[there]]] = 1
    both1, both = x[y > 0].T @ x[y > 0], x.T @ x
    i, j = np.triu_indices(len(some), 1)
    n1, n2 = both1[i, j].astype(float), both[i, j].astype(float)
    gain = _llr(n1, n2 - n1, pos, neg) - np.maximum(llr[some[i]], llr[some[j]])
    best = np.argsort(-gain, kind="stable")[: p.pair_terms // 2]
    best = best[gain[best] >= p.pair_llr]
    return np.unique(np.r_[some[i[best]], some[j[best]]])


def _llr(n1, n0, pos, neg):
    """G statistic of a term's presence against the class."""
    cells = np.stack([n1, n0, pos - n1, neg - n0])
    rows, cols = np.stack([n1 + n0] * 2 + [pos + neg - n1 - n0] * 2), np.array([pos, neg, pos, neg])[:, None]
    expect = rows * cols / (pos + neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.nansum(np.where(cells > 0, cells * np.log(cells / expect), 0), axis=0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    at = {int(h): i for i, h in enumerate(model.terms)}

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            out = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                found: set[int] = set()
                for w in set(WORD((t or "").lower())):
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[w] = tuple(at[h] for h in term_hashes(w) if h in at)
                    if hit:
                        found.update(hit)
                out.append(model.logit(sorted(found)))
            z = np.clip(np.array(out, float), -500, 500)
            s = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], names=[*b.schema.names, "score", "predicted"])

    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{c}` {k}" for c, k in kept.dtypes)
    return kept.mapInArrow(run, f"{schema}, score double, predicted int")
