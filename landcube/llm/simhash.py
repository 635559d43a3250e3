"""Near-duplicate documents by SimHash and vantage-point trees.

Fingerprints: 64 majority bits over the hashes of a text's word shingles. Two
fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints are
one node, so that a group of copies, however large, costs one.

Search: of two fingerprints within ``radius`` bits, one 32-bit half differs in
at most ``radius // 2`` bits. So each half gets a vantage-point tree of its own
over the Hamming distance of that half. The tree's upper part is fitted on a
bounded sample and deals all fingerprints to shards (its leaves); by the triangle
bound a fingerprint is also sent, as a query, to each shard that a ball of
``radius // 2`` around it can reach, if that shard's number is greater than its
own (the other direction is found from the other side). A shard goes on with a
tree of its own over all its rows, compares whole fingerprints at the leaves, and
returns a spanning forest of its links: never more edges than rows, however dense
it is. A dense group can't hold many rows in any case, as there are only 43,745
fingerprints within three bits of one.

Null text counts as empty; a text without words has fingerprint zero and links
like any other. Repeated rows share a fingerprint and a component and are each
answered. Rows with a null ``doc_id`` get a fingerprint and the component of
their group, but name none. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, connected_components, look_up, unused

SEED = 42


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    radius: int = 3
    sample: int = 1 << 20  #: bound on the fingerprints that the upper trees are fitted on
    to_leaf: int = 32  #: fingerprints of the sample to a shard, up to that bound
    shard_rows: int = 3_000  #: rows that a shard is meant to hold


def fingerprint(text: str | None, k: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= k:
        h = np.array([xxhash.xxh64_intdigest(data, SEED)], "<u8")
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        of = xxhash.xxh64_intdigest
        h = np.array([of(data[a:b], SEED) for a, b in zip(start[: -k + 1 or None].tolist(), end[k - 1 :].tolist())], "<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo : lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, digest, fp long) of each row; one pass, map side only. ``digest``
    tells rows apart that share a ``doc_id``."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t, p.shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f.view(np.int64))], names=["doc_id", "digest", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest long, fp long")


# --- vantage-point trees over a 32-bit half -------------------------------------


def _half(fp: np.ndarray, tree: int) -> np.ndarray:
    return (fp >> np.uint64(32 * tree)) & np.uint64(0xFFFFFFFF)


def _pick(x: np.ndarray) -> tuple[int, int] | None:
    """Vantage point and radius of the inner side, or None if nothing is divided."""
    for vp in x[np.linspace(0, len(x) - 1, 5).astype(int)]:
        d = np.bitwise_count(x ^ vp)
        mu = int(np.median(d))
        for m in (mu, mu - 1):
            if 0 < np.count_nonzero(d <= m) < len(x):
                return int(vp), m
    return None


def build(x: np.ndarray, leaf: int) -> list:
    """Nodes (vantage point, mu, inner, outer); leaves (number,)."""
    nodes: list = []
    leaves = 0

    def grow(part: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        cut = _pick(part) if len(part) > leaf else None
        if cut is None:
            nodes[at] = (leaves,)
            leaves += 1
        else:
            near = np.bitwise_count(part ^ np.uint64(cut[0])) <= cut[1]
            nodes[at] = (*cut, grow(part[near]), grow(part[~near]))
        return at

    grow(x)
    return nodes


def route(nodes: list, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, is the row's own leaf) of all leaves that a ball can reach."""
    rows, leaf, own = [], [], []
    todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        at, idx, mine = todo.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if len(node) == 1:
            rows.append(idx)
            leaf.append(np.full(len(idx), node[0]))
            own.append(mine)
            continue
        vp, mu, inner, outer = node
        d = np.bitwise_count(x[idx] ^ np.uint64(vp)).astype(np.int64)
        a, b = d - radius <= mu, d + radius > mu
        todo.append((inner, idx[a], mine[a] & (d[a] <= mu)))
        todo.append((outer, idx[b], mine[b] & (d[b] > mu)))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaf), np.concatenate(own)


class Forest:
    """Union-find over the rows of a shard, with labels kept for whole blocks."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def labels(self, idx: np.ndarray) -> np.ndarray:
        r = self.up[idx]
        while True:
            s = self.up[r]
            if (s == r).all():
                break
            r = s
        self.up[idx] = r
        return r

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def shard_links(fp: np.ndarray, n_own: int, tree: int, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the links among the first ``n_own`` rows and between
    them and the rest, by a tree over the half that ``tree`` names."""
    forest, out, half = Forest(len(fp)), [], _half(fp, tree)
    todo = [(np.arange(n_own), np.arange(len(fp)))]
    while todo:
        own, all_ = todo.pop()
        if not len(own) or not len(all_):
            continue
        cut = _pick(half[own]) if len(own) * len(all_) > block * block and len(own) > 64 else None
        if cut is not None:
            vp, mu = np.uint64(cut[0]), cut[1]
            d, e = np.bitwise_count(half[own] ^ vp), np.bitwise_count(half[all_] ^ vp).astype(np.int64)
            r = radius // 2
            near, far = all_[e - r <= mu], all_[e + r > mu]
            if len(near) + len(far) < 1.8 * len(all_):
                todo += [(own[d <= mu], near), (own[d > mu], far)]
                continue
        for lo in range(0, len(own), block):
            a = own[lo : lo + block]
            for at in range(0, len(all_), 4 * block):
                b = all_[at : at + 4 * block]
                close = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius
                close &= forest.labels(a)[:, None] != forest.labels(b)[None, :]
                while close.any():  # one link a row, then drop what has met meanwhile
                    i = np.flatnonzero(close.any(axis=1))
                    j = close[i].argmax(axis=1)
                    out += [(int(a[x]), int(b[y])) for x, y in zip(i, j) if forest.union(int(a[x]), int(b[y]))]
                    close &= forest.labels(a)[:, None] != forest.labels(b)[None, :]
    return out


def _deal(trees: list[list], radius: int):
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for t, nodes in enumerate(trees):
                rows, leaf, own = route(nodes, _half(fp, t), radius // 2)
                mine = np.zeros(len(fp), np.int64)
                mine[rows[own]] = leaf[own]
                keep = own | (leaf > mine[rows])
                rows, leaf, own = rows[keep], leaf[keep], own[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(own), pa.array(fp[rows].view(np.int64))],
                    names=["tree", "leaf", "own", "fp"])

    return run


def links(reps: DataFrame, n: int, p: Params = Params()) -> DataFrame:
    """Edges (a, b) between the ``n`` distinct fingerprints ``fp`` that span the
    same components as all links do.

    The upper trees divide a sample, so that shards grow with ``n`` only beyond
    ``sample / 8`` of them; each shard goes on dividing its own rows."""
    want = min(p.sample, max(256, p.to_leaf * n // p.shard_rows))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) <= F.lit(int(min(1.0, want / max(n, 1)) * (1 << 30)))
    sample = np.sort(reps.where(part).select("fp").toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    leaf = max(8, int(len(sample) * p.shard_rows / max(n, 1)))
    trees = [build(np.unique(_half(sample, t)), leaf) for t in (0, 1)]
    dealt = reps.select("fp").mapInArrow(_deal(trees, p.radius), "tree int, leaf int, own boolean, fp long")

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "fp"], ascending=[False, True], kind="stable")
        fp = pdf["fp"].to_numpy(np.int64)
        got = shard_links(fp.view(np.uint64), int(pdf["own"].sum()), int(key[0]), p.radius)
        return pd.DataFrame({"a": fp[[i for i, _ in got]], "b": fp[[j for _, j in got]]})

    return dealt.groupBy("tree", "leaf").applyInPandas(search, "a long, b long")


def components(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, digest, fp, component) for each row of ``docs``, written: a
    component is named by its smallest fingerprint, whatever the ids of its rows."""
    spark = docs.sparkSession
    store = Written(spark)
    fps = store.write(fingerprints(docs, p), "fingerprints")
    reps = store.write(fps.groupBy("fp").agg(F.count("*").alias("copies")), "distinct")
    edges = store.write(links(reps, reps.count(), p), "links")
    comp = connected_components(spark, edges, store)
    named = store.write(reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "copies", F.coalesce("component", "fp").alias("component")), "named")
    store.drop(edges)
    return store.write(look_up(fps, named, "fp", ["doc_id", "digest"]), "components")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for each row of ``docs``."""
    found = components(docs, p)
    named = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies"))
    out = look_up(found, named, "component", ["doc_id", "digest"])
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest ``doc_id``
    (null ids last), among those the one whose text has the smallest digest."""
    row, check = unused(docs, "row", "check")
    hashes = lambda digest: [F.xxhash64("doc_id", digest).alias(row), F.xxhash64(F.lit(2), digest, "doc_id").alias(check)]
    first = components(docs.select("doc_id", "text"), p).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("x"))
    keep = first.select("x.doc_id", "x.digest").select(*hashes(F.col("digest")))
    rows = docs.select("*", *hashes(F.xxhash64("text"))).dropDuplicates([row, check])
    return rows.join(keep.hint("merge"), [row, check], "left_semi").select(*docs.columns)
