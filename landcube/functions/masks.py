"""Cloud and shadow masks. A mask is 1 where it holds; a masked pixel is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indices import nd


def rescale(c: Column, low: float, high: float) -> Column:
    """Linear, without clamping."""
    return (c - low) / (high - low)


def cloud_score(df: DataFrame, threshold: int = 10) -> DataFrame:
    """``cloud_score`` (0 to 100, truncated) and ``cloud_score_mask``. A NULL in
    any test masks the score."""
    c = F.col
    ratio = nd(c("green"), c("swir1"))
    tests = [
        rescale(c("blue"), 1000, 3000), rescale(c("red") + c("green") + c("blue"), 2000, 8000),
        rescale(c("nir") + c("swir1") + c("swir2"), 3000, 8000), rescale(ratio, 0.8, 0.6),
    ]
    known = F.lit(True)
    for t in tests:
        known = known & t.isNotNull()
    score = F.when(known, F.floor(F.least(F.greatest(F.least(F.lit(1.0), *tests) * 100, F.lit(0.0)), F.lit(255.0)))).cast("int")
    return df.withColumn("cloud_score", score).withColumn("cloud_score_mask", (F.col("cloud_score") >= threshold).cast("int"))


def bit(qa: Column, k: int) -> Column:
    return F.shiftright(qa, k).bitwiseAND(1)


def cloud_flag(qa: Column, reflectance: str = "SR", satellite: str = "landsat", cloud_bit: int | None = None) -> Column:
    """By sensor: bit 3 (Landsat; raw value for TOA), bits 10 or 11 (Sentinel-2)."""
    if satellite.lower().startswith("sentinel-2"):
        return ((bit(qa, 10) != 0) | (bit(qa, 11) != 0)).cast("int")
    k = 3 if cloud_bit is None else cloud_bit
    return bit(qa, k) * (1 << k) if reflectance == "TOA" else bit(qa, k)


def shadow_flag(qa: Column, satellite: str = "landsat", shadow_bit: int = 4) -> Column:
    """Bit 4; Sentinel-2 has none: 0 where its first bit is set, else masked."""
    if satellite.lower().startswith("sentinel-2"):
        return F.when(bit(qa, 0) != 0, F.lit(0))
    return bit(qa, shadow_bit)


def apply_mask(df: DataFrame, bands, masks) -> DataFrame:
    """NULL for every band where any mask is not 0."""
    keep = F.lit(True)
    for m in masks:
        keep = keep & (m == 0)
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def tile_mask(df: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose place the mask has with a value other than 0 or NULL; ``mask``
    is (keys) or (keys, mask)."""
    on = mask.where("mask != 0") if "mask" in mask.columns else mask
    return df.join(on.select(*keys), keys, "left_semi")


def tdom(df: DataFrame, pixel: list[str], z: float = -1.0, dark_sum: float = 4000.0, erode: int = 0, scene=("tile", "scene")) -> DataFrame:
    """Temporal dark outliers: z-scores of nir and swir1 below ``z`` within the
    pixel's own series, and dark. One window over the pixel. ``erode`` shrinks them
    in each scene by a disk of so many pixels, by ``row`` and ``col``."""
    w = Window.partitionBy(*pixel)
    score = lambda b: F.try_divide(F.col(b) - F.avg(b).over(w), F.stddev_pop(b).over(w))
    hit = (score("nir") < z) & (score("swir1") < z) & (F.col("nir") + F.col("swir1") < dark_sum)
    out = df.withColumn("tdom", F.coalesce(hit, F.lit(False)).cast("int"))
    if not erode:
        return out
    from ..operators.raster import disk

    return disk(out, "tdom", erode, "min", scene, gaps=True).withColumn("tdom", F.col("tdom_min")).drop("tdom_min")


def shadow_offsets(azimuth: Column, elevation: Column, height: Column, scale: float) -> tuple[Column, Column]:
    """Pixels by which a cloud's shadow lies away from it."""
    import math

    az = azimuth * (math.pi / 180) + math.pi / 2
    away = F.tan(F.lit(math.pi / 2) - elevation * (math.pi / 180)) * height
    return F.round(F.cos(az) * away / scale).cast("int"), F.round(F.sin(az) * away / scale).cast("int")


#: Cloud heights in metres (fixed values).
HEIGHTS = tuple(range(200, 5000, 500))


def project_shadow(pixels: DataFrame, dark: float = 3500.0, scale: float = 30.0, heights=HEIGHTS, reach: int = 1) -> DataFrame:
    """Shadows of clouds: ``pixels(tile, scene, row, col, cloud, nir, swir1, swir2,
    azimuth, elevation[, tdom])`` with ``shadow``.

    Only cloudy pixels are multiplied by heights; the projected places, grown by
    a disk of ``reach`` pixels, meet dark pixels in one equi-join.
    """
    cloud = pixels.where("cloud = 1").withColumn("h", F.explode(F.array(*map(F.lit, heights))))
    dx, dy = shadow_offsets(F.col("azimuth"), F.col("elevation"), F.col("h"), scale)
    cells = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells)))
    cast = cloud.select("tile", "scene", (F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col")).distinct()
    cast = cast.withColumn("n", near).select("tile", "scene", (F.col("row") + F.col("n.i")).alias("row"), (F.col("col") + F.col("n.j")).alias("col"), F.lit(1).alias("hit")).distinct()
    out = pixels.join(cast, ["tile", "scene", "row", "col"], "left")
    free = F.col("tdom") == 0 if "tdom" in pixels.columns else F.lit(True)
    low = F.col("nir") + F.col("swir1") + F.col("swir2") < dark
    return out.withColumn("shadow", F.coalesce((F.col("hit") == 1) & low & free & (F.col("cloud") == 0), F.lit(False)).cast("int")).drop("hit")


def get_masks(df: DataFrame, pixel: list[str], cloud_flag_: bool = True, cloud_score_: bool = True, shadow_flag_: bool = True, tdom_: bool = False, qa: str = "qa", cloud_bit: int = 3, shadow_bit: int = 4, erode: int = 0, cloud: str = "cloud_flag_mask", **projection) -> DataFrame:
    """The masks that the flags ask for: without the flag mask the score is always
    computed, without the shadow flag the dark outliers. With ``tdom_`` the shadows
    of the clouds in band ``cloud`` are projected too, where row, col, azimuth and
    elevation are known (``projection``: arguments of ``project_shadow``)."""
    out = df
    if cloud_flag_:
        out = out.withColumn("cloud_flag_mask", cloud_flag(F.col(qa), cloud_bit=cloud_bit))
    if cloud_score_ or not cloud_flag_:
        out = cloud_score(out)
    if shadow_flag_:
        out = out.withColumn("shadow_flag_mask", shadow_flag(F.col(qa), shadow_bit=shadow_bit))
    if tdom_ or not shadow_flag_:
        out = tdom(out, pixel, erode=erode)
    if tdom_ and {"row", "col", "azimuth", "elevation"} <= set(df.columns):
        out = project_shadow(out.withColumn("cloud", (F.col(cloud) != 0).cast("int")), **projection).withColumnRenamed("shadow", "cloud_shadow_tdom_mask").drop("cloud")
    return out
