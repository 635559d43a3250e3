"""Scenes that arrive as files, composited by year as they come: an addition of
ours, as the batch pipelines have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def yearly(obs: DataFrame, pixel: list[str], bands, time: str = "acq") -> DataFrame:
    """Mean, min and max of each band for each pixel and calendar year, in update or
    complete mode. An observation counts for its year however late it comes: what is
    kept is a row for each pixel and year, as many as the composites have."""
    aggs = [f(b).alias(f"{b}_{s}") for b in bands for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return obs.groupBy(F.year(time).alias("year"), *pixel).agg(F.count("*").alias("n"), *aggs)
