"""Neighbourhood, morphology and object operators on grids.

A grid is rows (tile, row, col, value). Square windows are separable: two running
windows, along columns and then rows. Objects (components, sieves, polygons) are in
``objects``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .objects import BLOCK, components, label, polygonize, ring_area, sieve, with_halo  # noqa: F401  objects on the same grids


def dense(df: DataFrame, keys=("tile",)) -> DataFrame:
    """Every pixel of each tile's bounding box; those that were missing are NULL,
    and ``_own`` says which were not."""
    box = df.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    full = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).select(*keys, "row", "col")
    return full.join(df.withColumn("_own", F.lit(True)), [*keys, "row", "col"], "left")


def focal(df: DataFrame, value: str, radius: int, how: str = "mean", keys=("tile",), gaps: bool = False) -> DataFrame:
    """``df`` with ``{value}_{how}`` over the square of ``radius``; NULLs are
    skipped, the border uses what there is. mean, sum, min or max. Tiles have
    every pixel of their box, or ``gaps`` fills it."""
    if gaps:
        return focal(dense(df, keys), value, radius, how, keys).where("_own").drop("_own")
    along = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-radius, radius)
    across = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
    if how in ("mean", "sum"):
        out = df.withColumns({"_s": F.sum(value).over(along), "_n": F.count(value).over(along)})
        out = out.withColumns({"_s": F.sum("_s").over(across), "_n": F.sum("_n").over(across)})
        return out.withColumn(f"{value}_{how}", F.col("_s") if how == "sum" else F.try_divide(F.col("_s"), F.col("_n"))).drop("_s", "_n")
    f = F.min if how == "min" else F.max
    return df.withColumn("_a", f(value).over(along)).withColumn(f"{value}_{how}", f("_a").over(across)).drop("_a")


def tpi(df: DataFrame, elev: str = "elev", radius: int = 6, gaps: bool = False) -> DataFrame:
    """Elevation against the mean of its surroundings, truncated."""
    d = F.col(elev) - F.col(f"{elev}_mean")
    return focal(df, elev, radius, gaps=gaps).withColumn("tpi", F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("int")).drop(f"{elev}_mean")


def disk(df: DataFrame, value: str, radius: int, how: str = "min", keys=("tile",), gaps: bool = False) -> DataFrame:
    """Erosion (min) or dilation (max) with a round kernel: a running window along
    the row for each chord of the disk, then one step across rows for each chord.
    Tiles have every pixel of their box, or ``gaps`` fills it."""
    if gaps:
        return disk(dense(df, keys), value, radius, how, keys).where("_own").drop("_own")
    f = F.min if how == "min" else F.max
    chord = {i: math.isqrt(radius * radius - i * i) for i in range(-radius, radius + 1)}
    row = lambda w: Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-w, w)
    at = lambda i: Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(i, i)
    out = df.withColumns({f"_w{w}": f(value).over(row(w)) for w in set(chord.values())})
    out = out.withColumns({f"_r{i + radius}": f(f"_w{w}").over(at(i)) for i, w in chord.items()})
    steps = [f"_r{i + radius}" for i in chord]
    found = F.col(steps[0]) if len(steps) == 1 else (F.least if how == "min" else F.greatest)(*steps)
    return out.withColumn(f"{value}_{how}", found).drop(*steps, *(f"_w{w}" for w in set(chord.values())))


def translate(df: DataFrame, dx: Column | int, dy: Column | int) -> DataFrame:
    return df.withColumn("row", F.col("row") + dy).withColumn("col", F.col("col") + dx)


def terrain(df: DataFrame, elev: str = "elev", metres: float = 30.0, keys=("tile",)) -> DataFrame:
    """Slope and aspect in hundredths of a degree by 3x3 differences; NULL at the
    border. Aspect is clockwise from north, 0 on flat ground."""
    row = Window.partitionBy(*keys, "row").orderBy("col")
    col = Window.partitionBy(*keys, "col").orderBy("row")
    west, east = F.lag(elev).over(row), F.lead(elev).over(row)
    out = df.withColumns({"_w": west, "_e": east})
    up = lambda c: F.lag(c).over(col)
    down = lambda c: F.lead(c).over(col)
    out = out.withColumns({"_nw": up("_w"), "_n": up(elev), "_ne": up("_e"), "_sw": down("_w"), "_s": down(elev), "_se": down("_e")})
    c = F.col
    dx = (c("_ne") + 2 * c("_e") + c("_se") - c("_nw") - 2 * c("_w") - c("_sw")) / (8 * metres)
    dy = (c("_sw") + 2 * c("_s") + c("_se") - c("_nw") - 2 * c("_n") - c("_ne")) / (8 * metres)
    out = out.withColumns({"_dx": dx, "_dy": dy})
    slope = F.degrees(F.atan(F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy")))) * 100
    turn = F.degrees(F.atan2(-c("_dx"), c("_dy")))
    aspect = F.when((c("_dx") == 0) & (c("_dy") == 0), 0.0).otherwise(F.when(turn < 0, turn + 360).otherwise(turn)) * 100
    return out.withColumns({"slope": F.floor(slope).cast("int"), "aspect": F.floor(aspect).cast("int")}).drop("_w", "_e", "_nw", "_n", "_ne", "_sw", "_s", "_se", "_dx", "_dy")


def entropy(df: DataFrame, value: str, radius: int = 5, keys=("tile",), block: int = BLOCK) -> DataFrame:
    """Shannon entropy (bits, times 100) of the integer values in the square; NULL
    where it holds none. Blocks with a halo of ``radius`` pixels count each value by
    its running sums, so that one copy of the pixels is shuffled, and the halos."""
    keys = list(keys)
    near = with_halo(df.select(*keys, "row", "col", F.col(value).cast("long").alias("_v")), block, radius)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r, c, v = r - r.min(), c - c.min(), pdf["_v"]
        own, known = pdf["_own"].to_numpy(bool), v.notna().to_numpy()
        shape = (int(r.max()) + 2 + 2 * radius, int(c.max()) + 2 + 2 * radius)
        t, s = np.zeros(int(own.sum())), np.zeros(int(own.sum()))
        ro, co = r[own], c[own]  # the square's corners in the running sums
        for k in np.unique(v[known]):
            at = known & (v == k).to_numpy(bool, na_value=False)
            n = np.zeros(shape, np.int64)
            n[r[at] + radius + 1, c[at] + radius + 1] = 1
            n = n.cumsum(axis=0).cumsum(axis=1)
            far, wide = ro + 2 * radius + 1, co + 2 * radius + 1
            n = (n[far, wide] - n[ro, wide] - n[far, co] + n[ro, co]).astype(float)
            t += n
            s += n * np.log2(np.maximum(n, 1))
        some = t > 0
        h = np.where(some, (np.log2(np.maximum(t, 1)) - s / np.maximum(t, 1)) * 100, np.nan)
        return pdf[own][[*keys, "row", "col"]].assign(_h=h, _some=some)

    kinds = dict(df.dtypes)
    found = near.groupBy(*keys, "_br", "_bc").applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "row", "col"]) + ", _h double, _some boolean")
    return df.join(found.select(*keys, "row", "col", F.when(F.col("_some"), F.col("_h")).alias(f"{value}_entropy")), [*keys, "row", "col"])


def resample_nearest(src: DataFrame, target: DataFrame, ratio: float, value: str) -> DataFrame:
    """Target pixels take the source pixel below their centre; outside it is 0."""
    at = target.withColumns({"_r": F.floor((F.col("row") + 0.5) * ratio).cast("int"), "_c": F.floor((F.col("col") + 0.5) * ratio).cast("int")})
    s = src.select("tile", F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return at.join(s, ["tile", "_r", "_c"], "left").withColumn(value, F.coalesce(value, F.lit(0))).drop("_r", "_c")


def rasterize(pixels: DataFrame, rects: DataFrame, cell: float) -> DataFrame:
    """Pixel centres (tile, row, col, x, y) to the largest id of the rectangles
    (id, x0, y0, x1, y1) they lie in, by cells of a coarse grid."""
    box = rects.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    at = pixels.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    met = at.join(box, ["_cx", "_cy"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return met.groupBy("tile", "row", "col").agg(F.max("id").alias("label"))


def first_valid(clips: DataFrame, nodata: int = 0) -> DataFrame:
    """Mosaic of clips: at each pixel the first, by ``clip``, that holds a value."""
    return clips.where(F.col("value").isNotNull() & (F.col("value") != nodata)).groupBy("tile", "row", "col").agg(F.min_by("value", "clip").alias("value"))


def is_single_class(df: DataFrame, by: str, value: str, nodata: int = 0) -> DataFrame:
    v = F.when(F.col(value) != nodata, F.col(value))
    return df.groupBy(by).agg(F.count_distinct(v).alias("n_classes"), F.min(v).alias("class_id")).withColumn("single", F.col("n_classes") <= 1)


def pixel_area(lat: Column, degrees: float) -> Column:
    """Square metres of a pixel of so many degrees at a latitude, on a sphere."""
    k = math.pi / 180 * 6371007.181
    return (degrees * k) * (degrees * k) * F.cos(F.radians(lat))
