"""Shared plumbing: the shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none and runs in one process (tests) is a
    temporary folder made and named in the session.
    """
    found = spark.conf.get(SHARED, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{SHARED} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="landcube-shared-")
        spark.conf.set(SHARED, found)
    return found.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any(n + tail in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


class Written:
    """Tables written to the shared folder: lineage ends there, so that a lost
    executor costs one task and never a whole chain."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/landcube-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int, name: str = "t") -> DataFrame:
        """Write ``df`` in buckets of ``key``: joins on that column then shuffle
        only their other side. The session's catalog holds the table's name alone,
        the rows are in the shared folder."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        known = f"{self.base.rsplit('/', 1)[1]}_{self.n:03d}".replace("-", "_")
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(known)
        out = self.spark.table(known)
        out._written_at, out._known_as = path, known
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a written table that no later plan reads."""
        if getattr(df, "_known_as", None):
            self.spark.sql(f"DROP TABLE IF EXISTS {df._known_as}")
        path = getattr(df, "_written_at", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def look_up(rows: DataFrame, known: DataFrame, key: str, deal: list[str], share: int = 1_000) -> DataFrame:
    """``rows`` with what ``known(key, copies, ...)`` says of their ``key``, by a
    left join that no key's rows can make lopsided.

    ``copies`` is how many rows ask for a key. At most ``share`` keys are asked for
    by more than one row in ``share``: those are broadcast, and the rows that they
    answer are dealt out by a hash of their columns ``deal``. A null key has no answer."""
    total = known.agg(F.sum("copies")).first()[0] or 0
    values = [c for c in known.columns if c not in (key, "copies")]
    known = known.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "copies", F.struct(*values).alias("_known"))
    hot = known.where(F.col("copies") * share > F.lit(total)).select(F.col("_key").alias("_hot_key"), F.col("_known").alias("_hot"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    answered = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("_ask", F.when(answered, F.xxhash64(*deal)).otherwise(F.col(key).cast("long")))
    out = rows.join(known.drop("copies"), F.col("_ask") == F.col("_key"), "left")
    found = F.when(F.col("_hot_key").isNotNull(), F.col("_hot")).when(F.col(key).isNotNull(), F.col("_known"))
    return out.withColumn("_found", found).select(*[c for c in rows.columns if c not in ("_hot_key", "_hot", "_ask")], *[F.col("_found")[v].alias(v) for v in values])


def connected_components(spark: SparkSession, edges: DataFrame, store: Written | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the
    smallest node reachable.

    Alternating large-star and small-star steps: a node's neighbours all move to
    the smallest of them, until nothing changes. Each minimum is pre-aggregated
    before its shuffle, and both inputs of each join are read from written
    tables, so that Spark can split the join of a hub. Self-loops are allowed and
    keep a lone node in the result; null ends are ignored.
    """
    store = store or Written(spark)
    edges = edges.where("a is not null and b is not null").select(
        F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    )
    cur = store.write(edges.distinct(), "edges")
    state = _state(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = store.write(
            both.where("v >= u").join(low, "u").select(F.col("v"), F.col("m")).distinct()
            .select(F.col("m").alias("u"), "v"), "large")
        store.drop(low)
        # small star: each node v gathers its smaller neighbours and itself
        low = store.write(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        new = store.write(
            large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("v"))
            .select(F.least("a", "v").alias("u"), F.greatest("a", "v").alias("v")).distinct(), "small")
        for t in (low, large):
            store.drop(t)
        now = _state(new)
        if now == state:
            store.drop(new)
            break
        store.drop(cur)
        cur, state = new, now
    return cur.select(F.explode(F.array("u", "v")).alias("node"), F.col("u").alias("component")).groupBy("node").agg(
        F.min("component").alias("component")
    )


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38,0)) - u)")).first())
