"""Label polygons, patch statistics and their quality-assurance workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import taxonomy as T
from .objects import dissolve_rings

POLY_QA = ("", "aprobado", "rechazado")
RECT_QA = ("pendiente", "aprobado", "rechazado", "parcial")
PIXEL_HA = 0.09


def poly_uid() -> Column:
    return S.key(F.col("grid_id"), F.col("rev_year").cast("int"), F.col("class_id").cast("int"), F.col("patch_id").cast("int"))


def patch_ids(df: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("grid_id", "rev_year", "class_id").orderBy(order)
    return df.withColumn("patch_id", F.row_number().over(w))


def large_patches(df: DataFrame, min_ha: float, n: str = "n_pixels", pixel_m2: int = 900) -> DataFrame:
    """Patches of at least ``min_ha``, in whole square metres, so that one of exactly
    that area stays."""
    return df.where(F.col(n) * pixel_m2 >= F.lit(round(min_ha * 10_000)))


def reviewed_area(df: DataFrame) -> DataFrame:
    """``cov_rect``: approved share of each rectangle-year's area, on every row."""
    w = Window.partitionBy("grid_id", "rev_year")
    area = F.coalesce("area_ha", F.lit(0.0))
    done = F.sum(F.when(F.col("poly_qa") == "aprobado", area).otherwise(0.0)).over(w)
    total = F.sum(area).over(w)
    return df.withColumn("cov_rect", F.round(F.when(total == 0, 0.0).otherwise(F.try_divide(done, total) * 100), 2))


def init_qa(df: DataFrame, version: int = 1) -> DataFrame:
    """Empty QA columns where they are missing, then label and reviewed area."""
    fill = {"poly_qa": "", "qa_scope": "auto", "corr_id": -9999, "err_type": "ninguno", "poly_note": "", "qa_user": "", "qa_date": "", "rect_qa": "pendiente", "rect_note": "", "qa_ver": version}
    out = df if "poly_uid" in df.columns else df.withColumn("poly_uid", poly_uid())
    out = out.withColumns({c: F.lit(v) for c, v in fill.items() if c not in out.columns})
    return reviewed_area(out.withColumn("lbl_id", S.label_id(F.col("corr_id"), F.col("class_id"))))


EDITS = ("poly_qa", "qa_scope", "corr_id", "err_type", "poly_note", "qa_user", "qa_date")


def merge_edits(df: DataFrame, edits: DataFrame, rect_edits: DataFrame) -> DataFrame:
    """Polygon edits by ``poly_uid``, then rectangle edits by ``rect_key``; a
    rejected rectangle rejects its polygons; label and reviewed area follow."""
    have = [c for c in EDITS if c in edits.columns]
    e = edits.select("poly_uid", *(F.col(c).alias(f"_{c}") for c in have))
    out = df.join(e, "poly_uid", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in have}).drop(*(f"_{c}" for c in have))
    keys = [c for c in ("rect_qa", "rect_note", "qa_user", "qa_date") if c in rect_edits.columns]
    r = rect_edits.select("rect_key", *(F.col(c).alias(f"_{c}") for c in keys))
    out = out.withColumn("rect_key", S.key(F.col("grid_id"), F.col("rev_year"))).join(r, "rect_key", "left")
    gone = F.coalesce(F.col("_rect_qa") == "rechazado", F.lit(False))
    out = out.withColumns({"poly_qa": F.when(gone, "rechazado").otherwise(F.col("poly_qa")), "qa_scope": F.when(gone, "auto").otherwise(F.col("qa_scope")), "err_type": F.when(gone, "clase").otherwise(F.col("err_type"))})
    out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in keys}).drop("rect_key", *(f"_{c}" for c in keys))
    return reviewed_area(out.withColumn("lbl_id", S.label_id(F.col("corr_id"), F.col("class_id"))))


def overwritten(df: DataFrame, edits: DataFrame, key: str = "poly_uid") -> DataFrame:
    """``df`` with every property that a row's edit gives put in place of its own, as a
    map of properties overwrites another; a property that an edit leaves NULL stays."""
    have = [c for c in edits.columns if c != key and c in df.columns]
    e = edits.select(key, *(F.col(c).alias(f"_{c}") for c in have))
    return df.join(e, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in have else F.col(c) for c in df.columns))


def violations(df: DataFrame) -> DataFrame:
    """(check, key): one row for each error; ``cobertura`` rows are warnings."""
    row = lambda c, k: df.where(c).select(F.lit(k).alias("check"), F.col("poly_uid").alias("key"))
    ids = [*T.CODES, 35]
    approved = F.col("poly_qa") == "aprobado"
    rect = S.key(F.col("grid_id"), F.col("rev_year"))
    dup = df.groupBy("poly_uid").count().where("count > 1").select(F.lit("uid_duplicado").alias("check"), F.col("poly_uid").alias("key"))
    by = df.groupBy(rect.alias("key")).agg(F.count_distinct("split").alias("n"), F.first("rect_qa").alias("rect_qa"), F.max("cov_rect").alias("cov"), F.min("rev_tier").alias("tier"))
    parts = [
        dup, row(~F.col("poly_qa").isin(*POLY_QA), "poly_qa_invalido"), row(~F.col("rect_qa").isin(*RECT_QA), "rect_qa_invalido"),
        row(approved & ~F.col("lbl_id").isin(*ids), "lbl_id_invalido"), row(approved & (F.coalesce("corr_id", F.lit(-9999)) > 0) & (F.col("lbl_id") != F.col("corr_id")), "lbl_no_es_corr"),
        by.where("n > 1").select(F.lit("split_inconsistente").alias("check"), "key"),
        by.where(F.col("rect_qa").isin("aprobado", "parcial") & (F.col("cov") < S.extent_target(F.col("tier")))).select(F.lit("cobertura").alias("check"), "key"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_rules(df: DataFrame, approve_from: float = 5.0, reject_below: float = 1.0) -> DataFrame:
    """Large polygons of a rectangle-year are approved, slivers rejected."""
    total = F.sum(F.coalesce("area_ha", F.lit(0.0))).over(Window.partitionBy("grid_id", "rev_year"))
    pct = S.safe_pct(F.coalesce("area_ha", F.lit(0.0)), total)
    out = df.withColumn("pct", pct)
    big, tiny = F.col("pct") >= approve_from, F.col("pct") < reject_below
    return out.withColumns({
        "poly_qa": F.when(big, "aprobado").when(tiny, "rechazado").otherwise(F.col("poly_qa")), "err_type": F.when(big, "ninguno").when(tiny, "borde").otherwise(F.col("err_type")),
        "qa_scope": F.when(big, "clase").when(tiny, "auto").otherwise(F.col("qa_scope"))})


def class_shares(df: DataFrame) -> DataFrame:
    """Area of each class in its rectangle-year and its share."""
    n = df.groupBy("grid_id", "rev_year", "class_id").agg(F.sum("area_ha").alias("ha"))
    return n.withColumn("pct", F.round(F.col("ha") / F.sum("ha").over(Window.partitionBy("grid_id", "rev_year")) * 100, 1))


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_poligonos"), F.count_distinct("grid_id").alias("n_rectangulos"), F.round(F.sum("area_ha"), 2).alias("area_ha"))


def dissolve(df: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons of equal keys as one row: areas add up, and where there are rings they
    are those of the union, whose inner borders are gone."""
    out = df.groupBy(*keys).agg(F.sum("area_ha").alias("area_ha"), F.count("*").alias("n_parts"))
    return out.join(dissolve_rings(df, keys), keys) if "rings" in df.columns else out


def expand_groups(plan: DataFrame) -> DataFrame:
    """A row under its own group, and again under those of rare and transversal
    classes where they hold."""
    rare = F.when(S.clean_text(F.col("target_rare_class")) != "", "clases_raras")
    tran = F.when(F.coalesce("es_transversal", F.lit(False)), "clases_transversales")
    return plan.withColumn("grupo", F.explode(F.array_compact(F.array(F.col("sample_type"), rare, tran))))


def pilot(pool: DataFrame, forced: list[str], n_ecos: int | None = None) -> DataFrame:
    """The forced ids, then the first of each ecoregion that they do not cover."""
    first = pool.where(F.col("grid_id").isin(*forced)) if forced else pool.limit(0)
    rest = pool.join(first.select("eco_dom_id").distinct(), "eco_dom_id", "left_anti")
    one = rest.withColumn("_n", F.row_number().over(Window.partitionBy("eco_dom_id").orderBy("grid_id"))).where("_n = 1").drop("_n")
    return first.withColumn("role", F.lit("forced")).unionByName(one.withColumn("role", F.lit("first")).select(*pool.columns, "role"))


# --- patches and the sieve ------------------------------------------------------


def patch_table(patches: DataFrame, speckle: int = 5, reliable: int = 200) -> DataFrame:
    """Sizes by class and connectivity: ``patches(class_id, conn, px)``."""
    small = F.col("px") <= speckle
    out = patches.groupBy("class_id", "conn").agg(
        F.count("*").alias("n_parches"), F.round(F.sum("px") * PIXEL_HA, 2).alias("ha_total"), F.round(F.percentile("px", F.lit(0.5)), 1).alias("px_p50"), F.round(F.percentile("px", F.lit(0.9)), 1).alias("px_p90"),
        F.max("px").alias("px_max"), F.round(F.percentile("px", F.lit(0.5)) * PIXEL_HA, 3).alias("ha_p50"), F.round(F.avg(small.cast("int")) * 100, 1).alias("pct_parches_speckle"),
        F.round(F.sum(F.when(small, F.col("px")).otherwise(0)) / F.sum("px") * 100, 1).alias("pct_area_speckle"))
    n4 = F.max(F.when(F.col("conn") == 4, F.col("n_parches"))).over(Window.partitionBy("class_id"))
    return out.withColumn("confiable", F.coalesce(n4 >= reliable, F.lit(False)))


def missing_classes(found: DataFrame) -> DataFrame:
    legend = T.table(found.sparkSession).select(F.col("class_id").alias("clase"), F.col("n3_nm").alias("nombre"))
    return legend.join(found.select(F.col("class_id").alias("clase")).distinct(), "clase", "left_anti")


def extent_by(df: DataFrame, key: str, few: int = 3, mean_classes: bool = False) -> DataFrame:
    aggs = [F.count_distinct("grid_id").alias("n_rectangulos"), F.sum("n_parches").alias("n_parches")]
    if mean_classes:
        aggs.append(F.round(F.avg("n_clases"), 1).alias("n_clases_promedio"))
    return df.groupBy(key).agg(*aggs).withColumn("poca_representacion", F.col("n_rectangulos") < few)


def change_stats(df: DataFrame, file: str = "tile", before: str = "value", after: str = "sieved", nodata: int = 0) -> DataFrame:
    """Pixels of each class that the sieve moved, with rows per file and in all."""
    d = df.where(F.col(before) != nodata)
    out = d.rollup(file, before).agg(F.count("*").alias("pixeles_clase"), F.count_if(F.col(before) != F.col(after)).alias("pixeles_reasignados"), F.grouping_id().alias("_g"))
    return out.select(
        F.when(F.col("_g") == 3, "__TOTAL__").otherwise(F.col(file).cast("string")).alias("archivo"), F.when(F.col("_g") >= 1, "__TOTAL__").otherwise(F.col(before).cast("string")).alias("clase"),
        "pixeles_clase", "pixeles_reasignados", F.round(F.col("pixeles_reasignados") / F.col("pixeles_clase") * 100, 3).alias("pct_area_cambiada"))


def rectangles_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct("grid_id").alias("n"))
