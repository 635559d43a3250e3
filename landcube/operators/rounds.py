"""Iterative graph helpers whose state is a table between rounds."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only a
    session of one process (tests) may leave it out: it gets a temporary one."""
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{SHARED} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="landcube-shared-")
        spark.conf.set(SHARED, found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and every
    reader sees the same rows, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/landcube-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def independent_in_order(nodes: DataFrame, pairs: DataFrame, block: int = 8, grow: int = 8, most: int = 200_000) -> DataFrame:
    """Nodes that a scan in ascending order keeps, where a kept node excludes the later
    ends of its ``pairs(first, later)``. ``nodes(node, cx, cy)`` lie in cells.

    In a round each block of cells scans its own nodes; a node stays open if an earlier
    neighbour in another block is open. What is decided goes, and the blocks of the
    next round are ``grow`` times as wide, as long as none gets more than ``most`` open
    nodes: so the rounds follow the logarithm of a chain's length."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        own, state = set(pdf["node"].tolist()), {}
        for node, firsts in sorted(zip(pdf["node"].tolist(), pdf["firsts"])):
            firsts = () if firsts is None else firsts
            seen = [state[f] if f in own else None for f in firsts]
            state[node] = False if True in seen else None if None in seen else True
        return pd.DataFrame({"node": list(state), "kept": pd.Series(list(state.values()), dtype="boolean")})

    open_, pairs, kept = written(nodes.select("node", "cx", "cy")), written(pairs.select("first", "later")), []
    while not open_.isEmpty():
        at = [F.floor(F.col(c) / block).alias(f"_{c}") for c in ("cx", "cy")]
        before = pairs.groupBy(F.col("later").alias("node")).agg(F.collect_list("first").alias("firsts"))
        seen = written(open_.select("node", *at).join(before, "node", "left").groupBy("_cx", "_cy").applyInPandas(scan, "node long, kept boolean"))
        keep = seen.where("kept").select("node")
        kept.append(keep)
        # later neighbours of what is kept now go; what is gone excludes nothing
        out = pairs.join(keep.withColumnRenamed("node", "first"), "first", "left_semi").select(F.col("later").alias("node"))
        gone = written(seen.where("kept is not null").select("node").unionByName(out).distinct())
        open_ = written(open_.join(gone, "node", "left_anti"))
        for end in ("later", "first"):
            pairs = pairs.join(gone.withColumnRenamed("node", end), end, "left_anti")
        pairs = written(pairs)
        wider = [F.floor(F.col(c) / (block * grow)).alias(f"_{c}") for c in ("cx", "cy")]
        if (open_.groupBy(*wider).count().agg(F.max("count")).first()[0] or 0) <= most:
            block *= grow
    found = nodes.select("node").limit(0)
    for keep in kept:
        found = found.unionByName(keep)
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges(a, b)``."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        moved = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        # a label's own label is at least as small: jump
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(moved.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        same = new.join(label.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count() == 0
        label = new
        if same:
            return label
