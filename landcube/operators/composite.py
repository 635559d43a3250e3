"""Temporal composites: one shuffle on the pixel for thresholds and reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reducers(df: DataFrame, pixel: list[str], bands, stats=("median", "min", "max", "stdDev", "mean", "sum"), percentiles=()) -> DataFrame:
    """Per pixel and band; NULL observations are skipped, the deviation is that
    of the population."""
    of = {"median": F.median, "min": F.min, "max": F.max, "stdDev": F.stddev_pop, "mean": F.avg, "sum": F.sum}
    aggs = [of[s](b).alias(f"{b}_{s}") for b in bands for s in stats]
    aggs += [F.percentile(b, F.lit(p / 100)).alias(f"{b}_p{p}") for b in bands for p in percentiles]
    return df.groupBy(*pixel).agg(*aggs)


def thresholds(df: DataFrame, pixel: list[str], quality: str, low: int = 25, high: int = 75) -> DataFrame:
    """``df`` with the pixel's own percentiles of ``quality``."""
    w = Window.partitionBy(*pixel)
    both = F.percentile(quality, F.array(F.lit(low / 100), F.lit(high / 100))).over(w)
    return df.withColumn("_q", both).withColumns({f"{quality}_p{low}": F.col("_q")[0], f"{quality}_p{high}": F.col("_q")[1]}).drop("_q")


def _when(cond: Column, c: str) -> Column:
    return F.when(cond, F.col(c))


def seasonal(df: DataFrame, pixel: list[str], bands, quality: str, date: str = "acq", start=None, end=None) -> DataFrame:
    """Median within the dates; medians of the driest and wettest quarter of
    observations; min, max, amplitude, deviation over all; the thresholds."""
    lo, hi = f"{quality}_p25", f"{quality}_p75"
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(date) >= F.lit(start))
    if end is not None:
        inside = inside & (F.col(date) < F.lit(end))
    aggs = []
    for b in bands:
        aggs += [
            F.median(_when(inside, b)).alias(f"{b}_median"),
            F.median(_when(inside & (F.col(quality) <= F.col(lo)), b)).alias(f"{b}_median_dry"),
            F.median(_when(inside & (F.col(quality) >= F.col(hi)), b)).alias(f"{b}_median_wet"),
            F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"), (F.max(b) - F.min(b)).alias(f"{b}_amp"), F.stddev_pop(b).alias(f"{b}_stdDev"),
        ]
    return thresholds(df, pixel, quality).groupBy(*pixel).agg(*aggs, F.min(lo).alias(lo), F.min(hi).alias(hi))


def agriculture(df: DataFrame, pixel: list[str], bands, quality: str, tie: list[str]) -> DataFrame:
    """Median, 20th and 75th percentile, min, max, deviation, and all bands of the
    observation of highest quality (``_qmo``; ``tie`` decides equal ones)."""
    aggs = []
    for b in bands:
        aggs += [F.median(b).alias(f"{b}_median"), F.percentile(b, F.lit(0.2)).alias(f"{b}_p20"), F.percentile(b, F.lit(0.75)).alias(f"{b}_p75"),
                 F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"), F.stddev_pop(b).alias(f"{b}_stdDev"),
                 F.max_by(b, F.when(F.col(quality).isNotNull(), F.struct(quality, *tie))).alias(f"{b}_qmo")]
    return df.groupBy(*pixel).agg(*aggs)


def urban(df: DataFrame, pixel: list[str], bands, quality: str) -> DataFrame:
    """Median, 1st and 99th percentile, medians of the lowest and highest quarter
    of quality, min and max."""
    lo, hi = f"{quality}_p25", f"{quality}_p75"
    aggs = []
    for b in bands:
        aggs += [F.median(b).alias(f"{b}_median"), F.percentile(b, F.lit(0.01)).alias(f"{b}_p1"), F.percentile(b, F.lit(0.99)).alias(f"{b}_p99"),
                 F.median(_when(F.col(quality) <= F.col(lo), b)).alias(f"{b}_median_p25"), F.median(_when(F.col(quality) >= F.col(hi), b)).alias(f"{b}_median_p75"),
                 F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max")]
    return thresholds(df, pixel, quality).groupBy(*pixel).agg(*aggs)


def promote_median(df: DataFrame, names=("mbi", "ndbi", "ndmi", "ndsi")) -> DataFrame:
    """``{v}_median`` becomes ``{v}``; the other statistics of those go."""
    drop = [f"{v}_{s}" for v in names for s in ("median_dry", "median_wet", "min", "max", "amp", "stdDev")]
    return df.drop(*drop).withColumnsRenamed({f"{v}_median": v for v in names})


#: Stored types: name to (lowest, highest value, Spark type).
TYPES = {
    "int8": (-128, 127, "tinyint"), "uint8": (0, 255, "smallint"), "int16": (-32768, 32767, "smallint"),
    "uint16": (0, 65535, "int"), "int32": (-2147483648, 2147483647, "int"), "uint32": (0, 4294967295, "bigint"), "float": (None, None, "float"),
}


def typed(c: Column, kind: str) -> Column:
    """Clamped, truncated and cast; NULL stays."""
    lo, hi, to = TYPES[kind]
    if lo is None:
        return c.cast(to)
    v = F.least(F.greatest(c.cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    return F.when(c.isNotNull(), F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))).cast(to)


def project_profile(df: DataFrame, keys: list[str], profile: dict[str, str]) -> DataFrame:
    """The profile's bands in its order and types; all others go."""
    return df.select(*keys, *(typed(F.col(b), k).alias(b) for b, k in profile.items()))


def chile_profile() -> dict[str, str]:
    """184 bands: seven statistics of each of 25 bases, and nine singles."""
    bases = "blue green red nir swir1 swir2 cai evi2 gcvi hallcover hallheigth ndvi ndwi pri savi gv gvs npv soil cloud shade ndfi sefi wefi fns".split()
    small = {"gv", "gvs", "npv", "soil", "cloud", "shade", "ndfi", "sefi", "wefi", "fns", "hallcover", "hallheigth"}
    out = {}
    for b in bases:
        for s in ("max", "median", "median_dry", "median_wet", "min", "amp", "stdDev"):
            kind = "int32" if s == "stdDev" or b == "gcvi" else "uint8" if b in small else "uint16"
            out[f"{b}_{s}"] = "uint32" if (b, s) == ("hallcover", "median") else kind
    singles = dict.fromkeys(("elevation", "slope", "tpi", "mbi", "ndbi", "ndmi", "ndsi", "green_median_texture"), "int16")
    return out | {"aspect": "uint16"} | singles
