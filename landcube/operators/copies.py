"""Copies: rows of one shape meet as one, and are told apart again at the end.

A join of shapes costs a row for each pair of rows that meet, however many of them
lie at one place. Here each shape takes part once; pairs of shapes are expanded into
pairs of rows in blocks of bounded size, which are dealt out evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import written

#: Rows of a shape that a block holds of each side.
BLOCK = 1024


def classes(df: DataFrame, shape: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct shapes (shape, _n, _cls) of ``df``, with their rows' number, and
    ``df`` with ``_cls`` and ``_n``. Rows whose shape has a NULL are left out."""
    known = df
    for c in shape:
        known = known.where(F.col(c).isNotNull())
    of = written(known.groupBy(*shape).agg(F.count("*").alias("_n")).withColumn("_cls", F.monotonically_increasing_id()))
    return of, df.join(of, shape)


def expanded(pairs: DataFrame, a: DataFrame, b: DataFrame, size: int = BLOCK) -> DataFrame:
    """Pairs of rows: ``pairs(_a, _b, ...)`` of shapes with the columns of both sides'
    rows ``a`` and ``b``, as ``classes`` gives them."""

    def blocks(rows: DataFrame, end: str) -> DataFrame:
        own = [c for c in rows.columns if c not in ("_cls", "_n")]
        deal = F.pmod(F.xxhash64(*own), F.ceil(F.col("_n") / size))
        return rows.groupBy(F.col("_cls").alias(end), deal.alias(f"{end}_deal")).agg(F.collect_list(F.struct(*own)).alias(f"{end}_rows"))

    met = pairs.join(blocks(a, "_a"), "_a").join(blocks(b, "_b"), "_b")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "_a", "_b", "_a_deal", "_b_deal")
    rest = [c for c in pairs.columns if c not in ("_a", "_b")]
    out = met.select(*rest, "_b_rows", F.explode("_a_rows").alias("_x")).select(*rest, "_x", F.explode("_b_rows").alias("_y"))
    return out.select(*rest, "_x.*", "_y.*")
