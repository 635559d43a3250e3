"""Labels from class maps: clips, patches, polygons with attributes, mosaics.

Pixels are rows (grid_id, rev_year, row, col, class_id); a rectangle-year is the
unit that object operators take at a time, and its pixels are the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from . import labels as B
from . import raster as R

UNIT = ("grid_id", "rev_year")
#: Attributes of the plan that labels don't carry, and names that they carry
#: under another (fixed values; stores of at most ten characters).
PLAN_SKIP = ("review_years", "label_group", "grid_id", "review_year")
FIELD_NAMES = {
    "review_year": "rev_year", "review_rule": "rev_rule", "review_priority": "rev_prior", "review_tier": "rev_tier", "review_status": "rev_status",
    "review_notes": "rev_notes", "review_desc": "rev_desc", "n_review_years": "n_rev_yrs", "sample_type": "samp_type", "dim_temporal": "dim_temp",
    "dim_espacial": "dim_esp", "class_name": "class_nm", "es_transversal": "es_transv", "es_critica_n3": "es_crit_n3", "target_rare_class": "rare_class",
    "lulc_mode_id": "lulc_md_id", "lulc_mode_name": "lulc_name", "eco_dom_name": "eco_dom_nm", "source_raster": "src_raster", "rect_area_m2": "rect_a_m2",
    "transition_pct": "trans_pct", "stable_years": "stab_years", "max_stab_run": "max_stab", "fuente_plan": "fuente", "rectangle_qa": "rect_qa",
    "rectangle_note": "rect_note", "polygon_qa": "poly_qa", "polygon_note": "poly_note", "error_type": "err_type", "corrected_class_id": "corr_id",
    "label_id": "lbl_id", "qa_version": "qa_ver",
}


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in FIELD_NAMES.items() if a in df.columns})


def plan_attributes(plan: DataFrame) -> DataFrame:
    """Key and attributes of planned rectangle-years, under the labels' names."""
    rest = [c for c in plan.columns if c not in PLAN_SKIP]
    return renamed(plan.select("grid_id", F.col("review_year").alias("rev_year"), *rest))


def clip(pixels: DataFrame, rects: DataFrame, cell: float) -> DataFrame:
    """Pixels (x, y, ...) whose centre lies in a rectangle (grid_id, x0, y0, x1,
    y1), once for each that holds them; by cells of a coarse grid."""
    box = rects.select("grid_id", "x0", "y0", "x1", "y1").withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    met = pixels.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}).join(box, ["_cx", "_cy"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return met.where(inside).drop("_cx", "_cy", "x0", "y0", "x1", "y1")


def polygons(pixels: DataFrame, plan: DataFrame, pixel_m2: float = 900.0, min_patch_ha: float = 0.0, connectivity: int = 4, nodata: int = 0) -> DataFrame:
    """One row for each patch of ``min_patch_ha`` or more of the planned
    rectangle-years: class and its names, areas, share of the rectangle, rings,
    the plan's attributes, empty QA. Patches of a class are numbered from 1."""
    kept = pixels.join(plan.select("grid_id", F.col("review_year").alias("rev_year")).distinct(), list(UNIT), "left_semi")
    whole = kept.groupBy(*UNIT).agg((F.count("*") * pixel_m2).alias("rect_a_m2"))
    found = R.polygonize(kept, "class_id", connectivity, nodata, UNIT)
    out = found.withColumn("area_m2", F.col("n_pixels") * pixel_m2).withColumn("area_ha", F.col("area_m2") / 10000)
    out = B.patch_ids(out.where(F.col("area_m2") >= F.lit(round(min_patch_ha * 10_000))).withColumnRenamed("patch_id", "_was"), "_was").drop("_was")
    out = out.join(whole, list(UNIT)).withColumn("pct_rect", F.col("area_m2") / F.col("rect_a_m2") * 100)
    out = renamed(T.annotate(out, "class_id", extra_glacier=True)).withColumn("class_nm", F.col("n3_nm"))
    return B.init_qa(out.join(plan_attributes(plan), list(UNIT)))


def transversal(labels: DataFrame) -> DataFrame:
    return labels.where("es_transv")


def rasters(pixels: DataFrame, connectivity: int = 4, min_pixels: int = 1, nodata: int = 0) -> DataFrame:
    """Class and patch of each pixel of a rectangle-year; small patches are 0."""
    out = R.components(pixels, "class_id", connectivity, nodata, UNIT)
    return out.withColumn("patch", F.when(F.col("size") >= min_pixels, F.col("component")).otherwise(0).cast("bigint")).drop("component", "size")


def write_rasters(rasters_: DataFrame, path: str) -> None:
    """Two bands a pixel, a folder for each rectangle and year."""
    rasters_.write.mode("overwrite").partitionBy(*UNIT).parquet(path)


def sieved_mosaics(pixels: DataFrame, zones: DataFrame, size: int = 6, nodata: int = 0) -> DataFrame:
    """(utm_zone, rev_year, row, col, value): the sieved clips of each zone's
    rectangles, the first by id where they meet. Rows and columns are the zone's."""
    clean = R.sieve(pixels, "class_id", "merge", size, nodata, UNIT).join(zones.select("grid_id", "utm_zone"), "grid_id")
    return clean.where(F.col("sieved") != nodata).groupBy("utm_zone", "rev_year", "row", "col").agg(F.min_by("sieved", "grid_id").alias("value"))


def patch_sizes(pixels: DataFrame, value: str = "class_id", keys=UNIT, nodata: int = 0) -> DataFrame:
    """(keys, class_id, conn, px) of each patch, by four and by eight neighbours."""
    out = None
    for conn in (4, 8):
        lab = R.components(pixels, value, conn, nodata, keys).where("component > 0")
        one = lab.groupBy(*keys, "component", F.col(value).alias("class_id")).agg(F.count("*").alias("px")).select(*keys, "class_id", F.lit(conn).alias("conn"), "px")
        out = one if out is None else out.unionByName(one)
    return out


def patch_diagnostics(pixels: DataFrame, value: str = "class_id", keys=UNIT, nodata: int = 0) -> DataFrame:
    """Sizes of patches by class and connectivity, from the pixels."""
    return B.patch_table(patch_sizes(pixels, value, keys, nodata))
