"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers and grouped into buckets of like length (a fixed
ratio of lengths; crowded lengths are split by a hash). Every query first meets the
longest vectors, about ``bucket_rows`` of them, which gives it a k-th best score to
beat. With it, a bucket of greatest length L can answer a query q only if the
cosine can reach t = score / (|q| L):

* t > 1: the bucket is pruned for q;
* few coordinates of q carry its length (its focus holds a share of at least
  ``focus_share``): coordinate pruning, by the bound that a unit vector of cosine
  t with q has to keep on q's largest coordinate;
* otherwise length pruning: of the bucket, sorted by length, only the prefix of
  vectors of length score / |q| or more.

Survivors are verified by exact integer products. Bounds are computed in floating
point and widened by a relative 1e-9, so that rounding never prunes a hit.

The score also says which is the shortest bucket that a query needs; queries that
need the same ones stand in a block, so that a block meets no bucket that all its
queries can do without. Block and bucket meet by an equi-join, their vectors packed
together; each pair returns at most k rows a query. Nothing is collected: buckets,
their bounds and what each block needs are tables.

Vectors null or holding null or non-finite components take no part, nor do empty
ones and those with a null ``vec_id``; only vectors of equal length are compared.
All-zero vectors take part with score 0. Rows that repeat a ``vec_id`` are each
a candidate, though never for a query of the same id; a query id is answered once,
for the least of its vectors. Further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written


@dataclass(frozen=True)
class Params:
    k: int = 5
    query_every: int = 50
    scale: int = 256
    bucket_rows: int = 2_048  #: candidates of a bucket
    block_rows: int = 256  #: queries of a block
    steps: int = 16  #: lengths of a bucket within an octave
    hot_keys: int = 100_000  #: bound on the crowded lengths that are broadcast
    spread: int = 16  #: copies of the longest vectors that queries are dealt to
    focus_share: float = 0.5


def quantised(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, dim, x array<long>, norm) of the vectors that take part."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = F.transform(e, lambda v: F.floor(v.cast("double") * p.scale))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select("vec_id", F.size(e).alias("dim"), x.alias("x")).withColumn("norm", norm)


def _packed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each block of vectors, sorted by ``order``: bounded blocks."""
    s = F.array_sort(F.collect_list(F.struct(*order, F.col("vec_id").alias("id"), "x", "norm")))
    return rows.groupBy(*key).agg(s.alias("s")).select(
        *key, F.transform("s", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("s", lambda r: r["x"])).alias("flat"),
        F.transform("s", lambda r: r["norm"]).alias("norms"), F.array_max(F.transform("s", lambda r: r["norm"])).alias("longest"))


def _best(q, qn, qid, x, xn, ids, theta, p: Params):
    """Top k of one bucket for a block of queries; theta: scores to reach, or -inf."""
    out_q, out_id, out_s = [], [], []
    unit = x / np.maximum(xn, 1e-300)[:, None]
    longest = xn.max(initial=0.0)
    exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**52
    qf, xf = (q.astype(float), x.astype(float)) if exact else (q, x)
    loose = 1 + 1e-9
    for i in range(len(q)):
        th = theta[i]
        live = None
        if th > 0:
            reach = qn[i] * longest * loose
            if reach < th:
                continue  # the local cosine threshold is above 1
            t = min(1.0, th / reach)
            f = int(np.abs(q[i]).argmax())
            share = q[i, f] / qn[i]
            if abs(share) >= p.focus_share:
                spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - share * share))
                # the angles to q and from q to its coordinate add up: past a half turn, or past none, nothing is ruled out
                low = share * t - spread if t > -share else -1.0
                high = share * t + spread if t > share else 1.0
                live = np.flatnonzero((unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9))
            else:
                # lengths fall along the bucket
                live = np.arange(np.searchsorted(-xn, -(th / (qn[i] * loose)), "right"))
        score = (xf if live is None else xf[live]) @ qf[i]
        who = ids if live is None else ids[live]
        keep = who != qid[i]
        if th > -np.inf:
            keep &= score >= th
        score, who = score[keep].astype(np.int64), who[keep]
        if len(score) > p.k:
            cut = np.partition(-score, p.k - 1)[p.k - 1]
            some = np.flatnonzero(-score <= cut)
            score, who = score[some], who[some]
        top = np.lexsort((who, -score))[: p.k]
        out_q += [qid[i]] * len(top)
        out_id += who[top].tolist()
        out_s += score[top].tolist()
    return out_q, out_id, out_s


def _products(p: Params):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qid, ids = np.asarray(r.q_ids, np.int64), np.asarray(r.ids, np.int64)
                q, x = np.asarray(r.q_flat, np.int64).reshape(len(qid), -1), np.asarray(r.flat, np.int64).reshape(len(ids), -1)
                theta = np.full(len(qid), -np.inf) if r.theta is None else np.array([-np.inf if t is None or t != t else t for t in r.theta], float)
                a, b, s = _best(q, np.asarray(r.q_norms, float), qid, x, np.asarray(r.norms, float), ids, theta, p)
                yield pd.DataFrame({"query_id": np.array(a, np.int64), "vec_id": np.array(b, np.int64), "score": np.array(s, np.int64)})

    return run


def _length(norm: F.Column, p: Params) -> F.Column:
    """Number of a length's bucket: equal lengths have one, longer ones no smaller."""
    return F.when(norm > 0, F.floor(F.log2(norm) * p.steps).cast("int")).otherwise(F.lit(NONE))


#: Below all lengths: the bucket of zero vectors, and what a query without a score to beat needs.
NONE = -(1 << 30)


def _dealt(rows: DataFrame, key: list[str], id_: str, size: int, piece: str, p: Params) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their number ``piece`` within a crowded ``key``, and the keys
    with their pieces. Keys of at most ``size`` rows, or of one in ``hot_keys`` of all, are one piece."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("m"))
    total = counts.agg(F.sum("m")).first()[0] or 0
    counts = counts.withColumn("pieces", F.when(F.col("m") > F.lit(max(size, total // p.hot_keys)), F.ceil(F.col("m") / size)).otherwise(1).cast("int"))
    crowded = counts.where("pieces > 1").select(*key, "pieces")  # at most hot_keys rows
    out = rows.join(F.broadcast(crowded), key, "left").withColumn(piece, F.pmod(F.xxhash64(id_, F.lit(3)), F.coalesce("pieces", F.lit(1))).cast("int"))
    return out.drop("pieces"), counts


def top_k(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries among ``vectors(vec_id,
    embedding)``: the rows whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    store = Written(spark)
    x = store.write(quantised(vectors, p).withColumn("length", _length(F.col("norm"), p)), "quantised")
    placed, lengths = _dealt(x, ["dim", "length"], "vec_id", p.bucket_rows, "sub", p)
    packed = store.write(_packed(placed.withColumn("down", -F.col("norm")), ["dim", "length", "sub"], ["down"]), "buckets")
    # the longest vectors of each dimension: the first piece of each length until there are enough
    before = F.coalesce(F.sum("m").over(Window.partitionBy("dim").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = store.write(lengths.withColumn("first", before < p.bucket_rows), "lengths")
    longest = placed.where("sub = 0").join(F.broadcast(lengths.where("first").groupBy("dim").agg(F.min("length").alias("from"))), "dim").where("length >= from")
    # (a row for each dimension; the pieces above ``from`` hold less than bucket_rows vectors)
    head = _packed(longest.withColumn("down", -F.col("norm")), ["dim"], ["down"]).drop("longest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.spread - 1))))
    least = F.min(F.struct("dim", "x", "norm")).alias("v")
    query = store.write(x.where(F.pmod("vec_id", F.lit(p.query_every)) == 0).groupBy("vec_id").agg(least).select("vec_id", "v.*"), "queries")
    out, run = "query_id long, vec_id long, score long", _products(p)
    columns = ["q_ids", "q_flat", "q_norms", "ids", "flat", "norms", "theta"]
    asked = _asked(_dealt(query, ["dim"], "vec_id", p.block_rows, "block", p)[0].withColumn("th", F.lit(None).cast("double")), ["dim", "block"])
    asked = asked.withColumn("salt", F.pmod("block", F.lit(p.spread)))
    # vectors take far less room in files than in memory: by the size of its file Spark
    # would broadcast, through the driver, what does not fit there
    one = store.write(asked.hint("merge").join(head, ["dim", "salt"]).select(*columns).mapInPandas(run, out), "first")
    kth = one.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("s")).where(F.size("s") >= p.k)  # at most k rows a query
    kth = kth.select(F.col("query_id").alias("vec_id"), F.element_at("s", -p.k).cast("double").alias("th"))
    # a vector of less than this length can't reach the score
    reach = F.when((F.col("th") > 0) & (F.col("norm") > 0), F.col("th") / F.col("norm") * (1 - 1e-6)).otherwise(0.0)
    known = query.hint("merge").join(kth, "vec_id", "left").withColumn("need", _length(reach, p))
    known = store.write(_dealt(known, ["dim", "need"], "vec_id", p.block_rows, "block", p)[0], "known")
    key = ["dim", "need", "block"]
    left = lengths.where(~F.col("first") | (F.col("pieces") > 1)).groupBy("dim").agg(F.collect_list(F.struct("length", "pieces", "first")).alias("all"))
    todo = known.select(*key).distinct().join(left, "dim").withColumn("to", F.explode(F.filter("all", lambda b: b["length"] >= F.col("need"))))
    todo = todo.select(*key, "to.*").join(_asked(known, key).hint("merge"), key)
    todo = todo.withColumn("sub", F.explode(F.sequence(F.col("first").cast("int"), F.col("pieces") - 1))).drop("first", "pieces", "longest")
    two = todo.join(packed.hint("merge"), ["dim", "length", "sub"]).select(*columns).mapInPandas(run, out)
    return _ranked(one.unionByName(two), p)


def _asked(queries: DataFrame, key: list[str]) -> DataFrame:
    """Blocks of queries, each with the scores that they have to reach."""
    theta = queries.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("vec_id", "th"))).alias("t")).select(*key, F.transform("t", lambda r: r["th"]).alias("theta"))
    packed = _packed(queries, key, ["vec_id"]).select(*key, F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("norms").alias("q_norms"))
    return packed.hint("merge").join(theta, key)


def _ranked(scores: DataFrame, p: Params) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
