"""Scenes, tiles and sensor consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan(scenes: DataFrame, start: str = "1970-01-01", end: str | None = None, cloud: float = 100, trash: DataFrame | None = None, box: tuple | None = None) -> DataFrame:
    """Scenes from ``start`` on and before ``end`` (today), within the box, not in
    ``trash(scene_id)``, below the cloud limit; unknown cloud is left out."""
    out = scenes.where((F.col("acq") >= F.lit(start).cast("date")) & (F.col("acq") < (F.current_date() if end is None else F.lit(end).cast("date"))))
    if box is not None:
        x0, y0, x1, y1 = box
        out = out.where((F.col("x1") > x0) & (F.col("x0") < x1) & (F.col("y1") > y0) & (F.col("y0") < y1))
    if trash is not None:
        out = out.join(trash, "scene_id", "left_anti")
    return out.where(F.col("cloud_cover") < cloud)


def search(scenes: DataFrame, start: str, end: str, cloud: float, platform: str | None = None, max_scenes: int = 5) -> DataFrame:
    """A catalogue search: at most max(100, 15 * max_scenes) items, clearest first;
    nothing found is an error."""
    out = scan(scenes, start, end, cloud)
    if platform is not None:
        out = out.where(F.col("platform") == platform)
    out = out.orderBy("cloud_cover", "scene_id").limit(max(100, 15 * max_scenes))
    if out.isEmpty():
        raise ValueError("no scene matches")
    return out


def choose(scenes: DataFrame, n: int, diverse: bool = True) -> DataFrame:
    """The clearest scene of each path and row, then the ``n`` clearest."""
    cloud = F.coalesce("cloud_cover", F.lit(999.0))
    out = clearest_each(scenes) if diverse and n > 1 else scenes
    return out.orderBy(cloud, "scene_id").limit(n)


def scene_properties(raw: DataFrame) -> DataFrame:
    """Typed scene columns from property maps: the first that is neither NULL nor
    empty nor zero; solar elevation from the zenith angle where only that is known."""
    def first(*names):
        return F.coalesce(*(F.when(~F.try_element_at("props", F.lit(n)).isin("", "0"), F.try_element_at("props", F.lit(n))) for n in names))

    zenith = first("MEAN_SOLAR_ZENITH_ANGLE").cast("double")
    return raw.select(
        "scene_id", first("SPACECRAFT_ID", "SATELLITE", "SPACECRAFT_NAME").alias("satellite_name"),
        F.when(first("SPACECRAFT_NAME").isNotNull(), first("CLOUDY_PIXEL_PERCENTAGE")).otherwise(first("CLOUD_COVER")).cast("double").alias("cloud_cover"),
        first("SUN_AZIMUTH", "SOLAR_AZIMUTH_ANGLE", "MEAN_SOLAR_AZIMUTH_ANGLE").cast("double").alias("sun_azimuth_angle"),
        F.coalesce(first("SUN_ELEVATION").cast("double"), 90 - first("SOLAR_ZENITH_ANGLE").cast("double"), 90 - zenith).alias("sun_elevation_angle"))


def scale_sr(df: DataFrame, optical, thermal=()) -> DataFrame:
    out = {b: (F.col(b) * 2.75e-5 - 0.2) * 10000 for b in optical} | {b: (F.col(b) * 0.00341802 + 149) * 10 for b in thermal}
    return df.withColumns(out)


def reflectance(df: DataFrame, bands, nodata=(65535,)) -> DataFrame:
    """Digital numbers to reflectance in 0..1; nodata is NULL."""
    return df.withColumns({b: F.when(~F.col(b).isin(*nodata), F.least(F.greatest(F.col(b) * 2.75e-5 - 0.2, F.lit(0.0)), F.lit(1.0))) for b in bands})


def rescale_bands(df: DataFrame, bands, factor: float) -> DataFrame:
    return df.withColumns({b: F.col(b) * factor for b in bands})


def tile_mosaic(pixels: DataFrame, scenes: DataFrame, bands, n: int, how: str = "median") -> DataFrame:
    """End to end: choose scenes, take their pixels, composite each pixel."""
    f = F.median if how == "median" else F.avg
    chosen = choose(scenes, n).select("scene_id")
    return reflectance(pixels.join(chosen, "scene_id", "left_semi"), bands).groupBy("tile", "row", "col").agg(*(f(b).alias(b) for b in bands))


def path_rows(scenes: DataFrame) -> DataFrame:
    """The distinct (wrs_path, wrs_row) of scenes that have both."""
    return scenes.where("wrs_path is not null and wrs_row is not null").select("wrs_path", "wrs_row").distinct()


def clearest_each(scenes: DataFrame) -> DataFrame:
    """The clearest scene of each path and row, the first by id of equals; an unknown
    cloud cover comes last."""
    w = Window.partitionBy("wrs_path", "wrs_row").orderBy(F.coalesce("cloud_cover", F.lit(999.0)), "scene_id")
    return scenes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Collections behind each other, by name, repeats included; what one lacks is NULL."""
    out = first
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def class_areas(pixels: DataFrame, nodata: int = 0) -> DataFrame:
    """(tile, class_id, ha) of ``pixels(tile, class_id, m2)``; nodata has no class."""
    return pixels.where(F.col("class_id").isNotNull() & (F.col("class_id") != nodata)).groupBy("tile", "class_id").agg((F.sum("m2") / 10_000).alias("ha"))


def land_overlap(pixels: DataFrame, minimum: float = 0.0) -> DataFrame:
    """(tile, total, valid, overlap_pct): share of pixels with a class."""
    out = pixels.groupBy("tile").agg(F.count("*").alias("total"), F.count("class_id").alias("valid"))
    return out.withColumn("overlap_pct", F.col("valid") / F.greatest("total", F.lit(1)) * 100).where(F.col("overlap_pct") >= minimum)


def class_profile(areas: DataFrame, evaluable) -> DataFrame:
    """``areas(tile, class_id, ha)`` to one row a tile: classes, the dominant one
    and its share, how much of the evaluable legend, hectares and shares by class,
    a text that lists the classes by area."""
    per = areas.groupBy("tile", "class_id").agg(F.sum("ha").alias("ha"))
    cols = [F.sum(F.when(F.col("class_id") == k, F.col("ha")).otherwise(0.0)).alias(f"ha_{k}") for k in evaluable]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ha")).alias("a"), "class_id", "ha"))), lambda r: F.format_string("ID %d: %.2f", r["class_id"], r["ha"])), "; ")
    out = per.groupBy("tile").agg(
        F.count("*").alias("n_classes"), F.max_by("class_id", F.struct(F.col("ha"), -F.col("class_id"))).alias("dominant"), F.sum("ha").alias("valid_ha"), F.max("ha").alias("_top"),
        F.count_if(F.col("class_id").isin(*evaluable)).alias("n_evaluable"), *cols, text.alias("summary"))
    return out.withColumn("dominance", F.col("_top") / F.col("valid_ha")).withColumn("evaluable_pct", F.col("n_evaluable") / len(evaluable) * 100).drop("_top")


def rank_tiles(df: DataFrame, n: int) -> DataFrame:
    """Most classes, then most overlap, then least dominance."""
    return df.orderBy(F.desc("n_classes"), F.desc("overlap_pct"), "dominance", "tile").limit(n)


def by_latitude(df: DataFrame, bands: int, rest: int, south: float = -56.0, north: float = -17.5) -> DataFrame:
    """The best tile of each band of latitude, then the best ``rest`` others."""
    band = F.width_bucket("lat", F.lit(south), F.lit(north), F.lit(bands))
    order = [F.desc("n_classes"), F.desc("overlap_pct"), F.col("dominance"), F.col("tile")]
    one = df.withColumn("band", band).where(F.col("band").between(1, bands))
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy("band").orderBy(*order))).where("_n = 1").drop("_n")
    more = df.join(one.select("tile"), "tile", "left_anti").orderBy(*order).limit(rest).withColumn("band", F.lit(0).cast("bigint"))
    return one.withColumn("band", F.col("band").cast("bigint")).unionByName(more.select(*one.columns))


def sensor_shift(obs: DataFrame, sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Per sample: means up to 2012 and from 2013 on, their change in percent, and
    means by sensor; NULL change where the first mean is 0."""
    v, y, s = F.col(value), F.col("year"), F.col("sensor")
    out = obs.where(v.isNotNull()).groupBy(sample).agg(
        F.count("*").alias("n_obs"), F.avg(F.when(y <= 2012, v)).alias("pre2013_mean"), F.avg(F.when(y >= 2013, v)).alias("post2012_mean"),
        F.avg(F.when(s.isin("l5", "l7"), v)).alias("l57_mean"), F.avg(F.when(s == "l8", v)).alias("l8_mean"), F.avg(F.when(s == "l9", v)).alias("l9_mean"))
    return out.withColumn("delta_pct", F.try_divide(F.col("post2012_mean") - F.col("pre2013_mean"), F.col("pre2013_mean")) * 100)


def shift_verdict(shift: DataFrame) -> DataFrame:
    out = shift.where("delta_pct is not null").agg(F.count("*").alias("n"), F.median("delta_pct").alias("median_delta"), F.avg((F.col("delta_pct") < 0).cast("int")).alias("share_negative"))
    return out.withColumn("widespread", F.col("share_negative") >= 0.7)


def before_after(series: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    aggs = []
    for name, cond in (("pre", F.col("year") <= 2012), ("post", F.col("year") >= 2013)):
        v = F.when(cond, F.col(value))
        aggs += [F.avg(v).alias(f"{name}_mean"), F.median(v).alias(f"{name}_median"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    return series.groupBy(*by).agg(*aggs)


def region_series(pixels: DataFrame, region: DataFrame, bands) -> DataFrame:
    """Means of bands over a region's pixels, for each year and image."""
    return pixels.join(region, ["tile", "row", "col"], "left_semi").groupBy("year", "image").agg(*(F.avg(b).alias(b) for b in bands))


def reference_series(pixels: DataFrame, value: str) -> DataFrame:
    """Mean over the images of a year at each pixel, then over the region."""
    return pixels.groupBy("year", "tile", "row", "col").agg(F.avg(value).alias("v")).groupBy("year").agg(F.avg("v").alias(value))


def timing_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, upper median and greatest: of counted values, so that equal ones are a row."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value))
    all_ = F.sum("_n").over(Window.partitionBy(*by))
    out = n.withColumns({"_u": upto, "_a": all_})
    middle = F.min(F.when(F.col("_u") > F.floor(F.col("_a") / 2), F.col(value)))
    return out.groupBy(*by).agg(F.min(value).alias("least"), middle.alias("upper_median"), F.max(value).alias("greatest"))


def audit_band_names(products: dict[str, list[str]], expected: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(product, fault) where order, length or the quality band is wrong."""
    out = []
    for k, want in expected.items():
        got = products.get(k, [])
        if len(got) != len(want):
            out.append((k, "length"))
        elif got != want:
            out.append((k, "order"))
        if "pixel_qa" not in got:
            out.append((k, "pixel_qa"))
    return out
