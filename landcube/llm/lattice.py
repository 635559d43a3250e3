"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors go through ``tables`` random projections to eight dimensions; each
image is decoded to its nearest point of the E8 lattice, which is its cell, and
also probes the ``probes`` neighbouring cells that are nearest to the image.
A vector meets all that own a cell it probes or owns, and the cosine of each
meeting is verified in double precision.

Every vector carries its cells of all tables, so that of a pair that meets more
than once exactly one meeting counts it: the first table's, and there the one
whose finder has the larger id. Hence a cell returns a count for each vector and
its classes as stars, never the pairs: a dense cell costs arithmetic,
not rows. Groups of cells that hold many vectors are split on both sides, by those
that own the cells and by those that find them, into blocks of bounded size.

Equal vectors of a label are one node with a multiplicity, collapsed map side, so
that a group of copies costs one row a task. A node is named by a 64-bit hash of
label and vector, not by an id: two of ten thousand million nodes that share one
would be taken for each other.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do those with a null label: no links, their own component. A
null ``vec_id`` links with nothing and has a null component. Vectors of different
lengths never link. Rows that repeat a ``vec_id`` count as vectors each, with links
and components of their own. Further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, connected_components, look_up


@dataclass(frozen=True)
class Params:
    cosine: float = 0.93
    tables: int = 6
    probes: int = 3
    scale: float = 1.8  #: cells of the lattice to a unit of length
    seed: int = 11
    group_rows: int = 1_500  #: rows that a group of cells is meant to hold
    split_rows: int = 4_000  #: owners of a group that one task holds
    chunk_rows: int = 16_000  #: rows that find cells of the group, held against them at once


@functools.lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[x / 2 for x in s] for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8, the integer points of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        at = np.abs(gap).argmax(axis=1)
        r[odd, at] += np.where(gap[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8 and of D8 moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _codes(points: np.ndarray, salt: int) -> np.ndarray:
    """A 32-bit code of each lattice point; the codes are the cells."""
    h = np.full(points.shape[:-1], (salt * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(8):
        h ^= (2 * points[..., k]).astype(np.int64).astype(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cells(unit: np.ndarray, p: Params = Params()) -> np.ndarray:
    """int32 (vectors, tables, 1 + probes): own cell first, then those probed."""
    n, dim = unit.shape
    out = np.empty((n, p.tables, 1 + p.probes), np.int32)
    for t in range(p.tables):
        rng = np.random.default_rng([p.seed, t, dim])
        y = p.scale / np.sqrt(8) * (unit @ rng.standard_normal((dim, 8))) + rng.random(8)
        z = decode(y)
        out[:, t, 0] = _codes(z, t)
        if p.probes:
            near = np.argpartition(-((y - z) @ roots().T), p.probes - 1, axis=1)[:, : p.probes]
            out[:, t, 1:] = _codes(z[:, None, :] + roots()[near], t)
    return out


def usable(c: str) -> F.Column:
    e = F.col(c)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def _node() -> list[F.Column]:
    """The usable vector with one kind of zero, and its node; null for others."""
    ok = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    e = F.when(ok, F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))))
    return [e.alias("e"), F.when(ok, F.xxhash64("label", e)).alias("node")]


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, label, e, copies, first): equal usable vectors of a label are one row,
    ``rep`` its node and ``first`` the smallest of their ids."""
    return (
        vectors.select("vec_id", "label", *_node()).where("node is not null")
        .groupBy(F.col("node").alias("rep"), "label", "e").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    )


def _deal(p: Params, places_only: bool = False):
    """Vectors to cells: one row as an owner, one for each cell probed; and each
    with its double components and its cells in all tables."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(size)[:-1]]
            for dim in np.unique(size):
                idx = np.flatnonzero(size == dim)
                for lo in range(0, len(idx), 1024):
                    rows = idx[lo : lo + 1024]
                    x = flat[start[rows][:, None] + np.arange(dim)]
                    peak = np.abs(x).max(axis=1, keepdims=True)
                    unit = x / peak
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    codes = cells(unit, p)
                    n, t, k = codes.shape
                    at = np.repeat(np.arange(n), t * k)
                    role = np.tile(np.arange(k) == 0, n * t)
                    table = np.tile(np.repeat(np.arange(t, dtype=np.int32), k), n)
                    code = codes.reshape(-1)
                    keep = role | (code != np.repeat(codes[:, :, 0].reshape(-1), k))
                    at, role, table, code = at[keep], role[keep], table[keep], code[keep]
                    take = pa.array(rows[at])
                    if places_only:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(take), pa.array(np.full(len(at), dim, np.int32)), pa.array(table), pa.array(code), pa.array(role)],
                            names=["label", "dim", "t", "code", "own"])
                        continue
                    unit_b = pa.array([u.tobytes() for u in unit], pa.binary()).take(pa.array(at))
                    codes_b = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(np.full(len(at), dim, np.int32)),
                         pa.array(table), pa.array(code), pa.array(role), unit_b, codes_b],
                        names=["label", "rep", "copies", "dim", "t", "code", "own", "unit", "cells"])

    return run


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a`` and ``b``, pair by pair, in ``up``, which names each
    row's class by its smallest row. Whole blocks at once: of every two classes that a
    pair connects the larger takes the smallest name it meets, until none differ."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            top = up[up]
            if (top == up).all():
                break
            up[:] = top


def _meet(p: Params):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["t"].iloc[0])
        rep, copies = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        unit = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        code = np.frombuffer(b"".join(pdf["cells"]), np.int32).reshape(len(pdf), p.tables, 1 + p.probes)
        mine, found_by = np.flatnonzero(pdf["target"].to_numpy(bool)), np.flatnonzero(pdf["finder"].to_numpy(bool))
        cell = pdf.groupby(["label", "code"], sort=False).ngroup().to_numpy()
        count, up = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for lo in range(0, len(mine), 256):
            own = mine[lo : lo + 256]
            for at in range(0, len(found_by), 2048):
                some = found_by[at : at + 2048]
                a, b = np.nonzero((cell[own][:, None] == cell[None, some]) & (unit[own] @ unit[some].T >= p.cosine))
                a, b = own[a], some[b]
                a, b = a[rep[a] != rep[b]], b[rep[a] != rep[b]]  # a owns the cell that b found
                # both found each other in this table: the finder of larger id counts
                both = (code[b, t, :1] == code[a, t]).any(axis=1)
                fresh = ~both | (rep[b] > rep[a])
                a, b = a[fresh], b[fresh]
                for s in range(t):
                    met = (code[a, s, :1] == code[b, s]).any(axis=1) | (code[b, s, :1] == code[a, s]).any(axis=1)
                    a, b = a[~met], b[~met]
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                unite(up, a, b)
        some, joined = np.flatnonzero(count), np.flatnonzero(up != np.arange(len(up)))
        b = pd.array(np.r_[np.zeros(len(some), np.int64), rep[up[joined]]], "Int64")
        b[: len(some)] = pd.NA
        return pd.DataFrame({"a": np.r_[rep[some], rep[joined]], "b": b, "n": np.r_[count[some], np.zeros(len(joined), np.int64)]})

    return run


def deal(reps: DataFrame, groups: int, p: Params = Params(), places_only: bool = False) -> DataFrame:
    """Each distinct vector, dealt to the cells it owns and probes; the cells
    stand in groups, so that small ones share a task's call."""
    kind = dict(reps.dtypes)["label"]
    rest = "" if places_only else ", unit binary, cells binary"
    ids = "" if places_only else ", rep long, copies long"
    out = reps.select("label", "e", "rep", "copies").mapInArrow(_deal(p, places_only), f"label {kind}{ids}, dim int, t int, code int, own boolean{rest}")
    return out.withColumn("cells_group", F.pmod(F.xxhash64("label", "code"), F.lit(groups)).cast("int"))


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id,
    embedding, label)``."""
    spark = vectors.sparkSession
    store = Written(spark)
    reps = store.write(distinct_vectors(vectors), "distinct")
    groups = max(1, -(-reps.count() * (1 + p.probes) // p.group_rows))
    key = ["dim", "t", "cells_group"]
    # a group's owners are split into blocks and its finders into chunks: each pair of them is one task's call
    size = deal(reps, groups, p, places_only=True).groupBy(*key).agg(F.count_if("own").alias("owners"), F.count("*").alias("finders"))
    size = store.write(size.select(
        *key, F.greatest(F.lit(1), F.ceil(F.col("owners") / p.split_rows)).cast("int").alias("blocks"), F.ceil(F.col("finders") / p.chunk_rows).cast("int").alias("chunks")), "groups")
    dealt = deal(reps, groups, p).join(size, key)
    block, chunk = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int")
    calls = F.array_union(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b * F.col("chunks") + F.col("chunk")),
        F.when(F.col("own"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.col("block") * F.col("chunks") + c)).otherwise(F.array().cast("array<int>")))
    spread = dealt.withColumns({"block": block, "chunk": chunk}).withColumn("call", F.explode(calls))
    spread = spread.withColumns({
        "target": F.col("own") & (F.floor(F.col("call") / F.col("chunks")) == F.col("block")), "finder": F.col("call") % F.col("chunks") == F.col("chunk")})
    met = store.write(
        spread.drop("blocks", "chunks", "block", "chunk", "own").groupBy(*key, "call").applyInPandas(_meet(p), "a long, b long, n long"), "meetings")
    store.drop(size)
    counts = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comp = connected_components(spark, met.where("b is not null").select("a", "b"), store)
    part = reps.select("rep", "first", "copies").join(comp, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    part = store.write(part.select("rep", "first", "copies", "part"), "parts")
    least = part.groupBy("part").agg(F.min("first").alias("component_id"))
    known = part.join(least, "part").join(counts, "rep", "left").select(
        F.col("rep").alias("node"), "copies", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = store.write(known, "known")
    out = look_up(vectors.select("vec_id", _node()[1]), known, "node", ["vec_id"])
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
