"""Queries over observations: masks, indices, unmixing, composites, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as X
from ..functions import masks as M
from ..functions import unmix as U
from ..operators import composite as C
from ..operators import diagnostics as D
from ..operators import raster as R
from ..operators import spatial as G
from .registry import query
from .roles import GRID, LULC, OBS, SCENES

KEYS = ["tile", "px", "scene", "qa"]
ND = lambda a, b: f"({a} - {b}) / nullif({a} + {b}, 0)"
#: Every index in SQL, over 0..1 bands named n (nir), r, g, b, s1, s2, t.
INDEX_SQL = {
    "cai": "s2 / nullif(s1, 0) + 1", "evi2": "2.5 * (n - r) / nullif(n + 2.4 * r + 1, 0) + 1", "gcvi": "n / nullif(g, 0)",
    "hallcover": "exp(-0.017 * r - 0.007 * n - 0.079 * s2 + 5.22)", "hallheigth": "exp(-0.039 * r - 0.011 * n - 0.026 * s1 + 4.13)", "ndvi": f"{ND('n', 'r')} + 1",
    "ndwi": f"{ND('n', 's1')} + 1", "pri": f"{ND('b', 'g')} + 1", "savi": "1.5 * (n - r) / nullif(0.5 + n + r, 0) + 1", "ndbi": f"{ND('s1', 'n')} + 1", "ndmi": f"{ND('n', 's1')} + 1",
    "ndsi": f"{ND('g', 's1')} + 1", "mbi": "(s1 - s2 - n) / nullif(s1 + s2 + n + 1e-6, 0) + 0.5", "ui": f"{ND('s2', 'n')} + 1", "bu": f"({ND('s1', 'n')}) - ({ND('n', 'r')})",
    "ebbi": "(s1 - n) / nullif(10 * sqrt(s1 + t), 0)", "ndwi_green": f"{ND('g', 'n')} + 1", "mndwi": f"{ND('g', 's1')} + 1", "evi": "2.5 * (n - r) / nullif(n + 6 * r - 7.5 * b + 1, 0) + 1",
}
UNIT = "select *, nir / 10000 n, red / 10000 r_, green / 10000 g, blue / 10000 b, swir1 / 10000 s1, swir2 / 10000 s2, tir / 10000 t from r"
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2", "tir")


def unit(df):
    return df.withColumns({b: F.col(b) / 10000 for b in BANDS})


def _index(name: str, number: int) -> None:
    import re

    fn, bands = X.INDICES[name]
    sql = re.sub(r"\br\b", "r_", INDEX_SQL[name])

    soft = name.startswith("hall")  # exp() may differ in its last bit

    @query(f"idx_{number:02d}_{name}", OBS, f"select tile, px, scene, qa, {f'round({sql}, 8)' if soft else sql} as v from u", f"u as ({UNIT})")
    def _(df):
        v = fn(*map(F.col, bands))
        return unit(df).select(*KEYS, (F.round(v, 8) if soft else v).alias("v"))


for _k, _n in enumerate(("ndvi", "ndbi", "ndmi", "ndsi", "mbi", "ui", "bu", "ebbi", "ndwi", "mndwi", "savi", "pri", "cai", "evi", "evi2", "hallcover", "hallheigth", "gcvi"), 1):
    _index(_n, _k)
_index("ndwi_green", 20)


@query("idx_19_ndvi_median_clear", OBS, "select px, round(median((nir - red) / nullif(nir + red, 0)), 8) as v from r where qa < 4 group by px")
def _(df):
    return df.where("qa < 4").groupBy("px").agg(F.round(F.median(X.nd(F.col("nir"), F.col("red"))), 8).alias("v"))


@query("prj_06_full_index_stack", OBS, "select tile, px, scene, qa, " + ", ".join(f"round(({INDEX_SQL[n].replace('(n - r)', '(n - r_)').replace('* r ', '* r_ ').replace('+ r,', '+ r_,').replace('* r,', '* r_,')}) * 10000, 3) as {n}" for n in ("cai", "gcvi", "pri", "ndbi", "ndsi", "mbi")) + " from u", f"u as ({UNIT})")
def _(df):
    out = X.with_indices(unit(df))
    return out.select(*KEYS, *(F.round(F.col(n) * 10000, 3).alias(n) for n in ("cai", "gcvi", "pri", "ndbi", "ndsi", "mbi")))


# --- scaling, masks --------------------------------------------------------------


@query("prj_03_scale_sr", OBS, "select tile, px, scene, qa, round((red * 2.75e-5 - 0.2) * 10000, 6) as red, round((tir * 0.00341802 + 149) * 10, 6) as tir from r")
def _(df):
    return D.scale_sr(df, ["red"], ["tir"]).select(*KEYS, F.round("red", 6).alias("red"), F.round("tir", 6).alias("tir"))


@query("prj_04_scale_toa", OBS, "select tile, px, scene, qa, red * 10000 as red from r")
def _(df):
    return D.rescale_bands(df, ["red"], 10000).select(*KEYS, "red")


@query("prj_05_reflectance", OBS, "select tile, px, scene, qa, case when nir <> 65535 then least(greatest(nir * 2.75e-5 - 0.2, 0.0), 1.0) end as nir from r")
def _(df):
    return D.reflectance(df, ["nir"]).select(*KEYS, "nir")


@query("prj_01_rename_bands", OBS, "select tile, px, scene, qa, blue as B2, green as B3, nir as B5 from r")
def _(df):
    return df.select(*KEYS, F.col("blue").alias("B2"), F.col("green").alias("B3"), F.col("nir").alias("B5"))


@query("prj_07_apply_mask", OBS, "select tile, px, scene, qa, case when (qa >> 1) & 1 = 0 and (qa >> 2) & 1 = 0 then nir end as nir, case when (qa >> 1) & 1 = 0 and (qa >> 2) & 1 = 0 then red end as red from r")
def _(df):
    return M.apply_mask(df, ["nir", "red"], [M.cloud_flag(F.col("qa"), cloud_bit=1), M.shadow_flag(F.col("qa"), shadow_bit=2)]).select(*KEYS, "nir", "red")


@query("prj_08_tile_mask", OBS, "select tile, px, scene, qa, nir from r where px in (select px from r where qa = 7)")
def _(df):
    return M.tile_mask(df, df.groupBy("px").agg(F.max((F.col("qa") == 7).cast("int")).alias("mask")), ["px"]).select(*KEYS, "nir")


@query("prj_09_typed_bands", OBS, "select tile, px, scene, qa, cast(least(greatest(trunc(nir), 0), 255) as smallint) as u8, cast(least(greatest(trunc(nir - 8000), -32768), 32767) as smallint) as i16, cast(least(greatest(trunc(red - 1000), 0), 65535) as int) as u16 from r")
def _(df):
    out = df.withColumns({"u8": F.col("nir"), "i16": F.col("nir") - 8000, "u16": F.col("red") - 1000})
    return C.project_profile(out, KEYS, {"u8": "uint8", "i16": "int16", "u16": "uint16"})


RS = "({x} - {a}) / ({b} - {a})"
SCORE = "least(1.0, (blue - 1000) / (3000 - 1000), (red + green + blue - 2000) / (8000 - 2000), (nir + swir1 + swir2 - 3000) / (8000 - 3000), ((green - swir1) / nullif(green + swir1, 0) - 0.8) / (0.6 - 0.8))"


@query("msk_01_rescale", OBS, "select tile, px, scene, qa, round((blue - 1000) / (3000 - 1000), 10) as v from r")
def _(df):
    return df.select(*KEYS, F.round(M.rescale(F.col("blue"), 1000, 3000), 10).alias("v"))


@query("msk_02_cloud_score", OBS, f"select tile, px, scene, qa, cast(floor(least(greatest({SCORE} * 100, 0.0), 255.0)) as int) as cloud_score from r")
def _(df):
    return M.cloud_score(df).select(*KEYS, "cloud_score")


@query("msk_03_cloud_flag", OBS, "select tile, px, scene, qa, cast((qa >> 1) & 1 as int) as sr, cast(((qa >> 1) & 1) * 2 as int) as toa, cast(0 as int) as s2 from r")
def _(df):
    q = F.col("qa")
    return df.select(*KEYS, M.cloud_flag(q, cloud_bit=1).cast("int").alias("sr"), M.cloud_flag(q, "TOA", cloud_bit=1).cast("int").alias("toa"), M.cloud_flag(q, satellite="Sentinel-2 (SR)").alias("s2"))


@query("msk_04_shadow_flag", OBS, "select tile, px, scene, qa, cast((qa >> 2) & 1 as int) as sr, case when qa & 1 <> 0 then 0 end as s2 from r")
def _(df):
    return df.select(*KEYS, M.shadow_flag(F.col("qa"), shadow_bit=2).cast("int").alias("sr"), M.shadow_flag(F.col("qa"), "Sentinel-2 (SR)").alias("s2"))


@query("msk_05_tdom", OBS, """select tile, px, scene, qa, cast(coalesce((nir - mn) / nullif(sn, 0) < -1 and (swir1 - ms) / nullif(ss, 0) < -1 and nir + swir1 < 4000, false) as int) as tdom
 from (select *, avg(nir) over (partition by px) mn, stddev_pop(nir) over (partition by px) sn, avg(swir1) over (partition by px) ms, stddev_pop(swir1) over (partition by px) ss from r)""")
def _(df):
    return M.tdom(df, ["px"]).select(*KEYS, "tdom")


@query("msk_07_get_masks", OBS, f"select tile, px, scene, qa, cast((qa >> 1) & 1 as int) as cloud_flag_mask, cast((qa >> 2) & 1 as int) as shadow_flag_mask, cast(floor(least(greatest({SCORE} * 100, 0.0), 255.0)) >= 10 as int) as cloud_score_mask from r")
def _(df):
    out = M.get_masks(df, ["px"], cloud_bit=1, shadow_bit=2)
    return out.select(*KEYS, F.col("cloud_flag_mask").cast("int").alias("cloud_flag_mask"), F.col("shadow_flag_mask").cast("int").alias("shadow_flag_mask"), "cloud_score_mask")


# --- unmixing -------------------------------------------------------------------


def _frac(model: dict) -> str:
    parts = []
    for name, w in U.weights(model).items():
        total = " + ".join(f"{b} * ({x!r}::double)" for b, x in zip(U.BANDS, w))
        parts.append(f"cast(floor(least(greatest(greatest({total}, 0.0) * 100, 0.0), 255.0)) as int) as {name}")
    return ", ".join(parts)


FRAC = f"f0 as (select tile, px, scene, qa, {_frac(U.ENDMEMBERS)} from r), f as (select *, cast(abs(gv + npv + soil - 100) as int) as shade0, least(abs(gv + npv + soil - 100), 255) as shade from f0)"
BYTE = "cast(floor(least(greatest({x}, 0.0), 255.0)) as int)"
ND100 = lambda a, b: f"case when ({a}) + ({b}) <> 0 then " + BYTE.format(x=f"(({a}) - ({b}))::double / nullif(({a}) + ({b}), 0) * 100 + 100") + " end"


@query("sma_01_fractions", OBS, "select tile, px, scene, qa, gv, npv, soil, cloud, cast(shade as int) as shade from f", FRAC)
def _(df):
    return U.fractions(df).select(*KEYS, "gv", "npv", "soil", "cloud", "shade")


@query("sma_02_fractions_small", OBS, f"select tile, px, scene, qa, {_frac(U.SMALL)} from r")
def _(df):
    return U.fractions(df, U.SMALL).select(*KEYS, *U.SMALL)


@query("sma_03_to_06_fraction_indices", OBS, f"""select tile, px, scene, qa, gvs, {ND100('gvs', 'npv + soil')} as ndfi, {ND100('100.0::double * (gv + npv) / nullif(gv + npv + soil, 0)', 'soil')} as sefi,
 {ND100('gv + npv', 'soil + shade')} as wefi, {ND100('gv + shade', 'soil')} as fns from (select *, {BYTE.format(x='100.0::double * gv / nullif(gv + npv + soil, 0)')} as gvs0, case when gv + npv + soil <> 0 then {BYTE.format(x='100.0::double * gv / nullif(gv + npv + soil, 0)')} end as gvs from f)""", FRAC)
def _(df):
    return U.fraction_indices(U.fractions(df)).select(*KEYS, "gvs", "ndfi", "sefi", "wefi", "fns")


# --- composites -----------------------------------------------------------------

CLEAR = "c as (select *, case when (qa >> 2) & 1 = 0 then nir end nir_, case when (qa >> 2) & 1 = 0 then red end red_, case when (qa >> 2) & 1 = 0 then (nir - red * 10) / nullif(nir + red * 10, 0) + 1 end q from r)"
TH = CLEAR + ", th as (select px as p, quantile_cont(q, 0.25) q25, quantile_cont(q, 0.75) q75 from c group by px), j as (select * from c join th on c.px = th.p)"


def clear(df):
    out = M.apply_mask(df, ["nir", "red"], [M.cloud_flag(F.col("qa"), cloud_bit=2)])
    return out.withColumn("ndvi", X.ndvi(F.col("nir"), F.col("red") * 10))


def rounded(df, keys, digits=4):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in df.columns if c not in keys))


@query("agg_01_temporal_reducers", OBS, "select px, round(median(nir_), 4) nir_median, round(min(nir_), 4) nir_min, round(max(nir_), 4) nir_max, round(stddev_pop(nir_), 4) \"nir_stdDev\", round(avg(nir_), 4) nir_mean, round(sum(nir_), 4) nir_sum, round(quantile_cont(nir_, 0.1), 4) nir_p10 from c group by px", CLEAR)
def _(df):
    return rounded(C.reducers(clear(df), ["px"], ["nir"], percentiles=(10,)), ["px"])


@query("agg_02_seasonal_composite", OBS, """select px, round(median(nir_) filter (where acq >= date '1996-01-01' and acq < date '2001-01-01'), 4) nir_median,
 round(median(nir_) filter (where acq >= date '1996-01-01' and acq < date '2001-01-01' and q <= q25), 4) nir_median_dry, round(median(nir_) filter (where acq >= date '1996-01-01' and acq < date '2001-01-01' and q >= q75), 4) nir_median_wet,
 round(min(nir_), 4) nir_min, round(max(nir_), 4) nir_max, round(max(nir_) - min(nir_), 4) nir_amp, round(stddev_pop(nir_), 4) "nir_stdDev", round(min(q25), 4) ndvi_p25, round(min(q75), 4) ndvi_p75 from j group by px""", TH)
def _(df):
    out = C.seasonal(clear(df), ["px"], ["nir"], "ndvi", start=__import__("datetime").date(1996, 1, 1), end=__import__("datetime").date(2001, 1, 1))
    return rounded(out, ["px"])


@query("agg_03_agriculture_composite", OBS, """select px, round(median(nir_), 4) nir_median, round(quantile_cont(nir_, 0.2), 4) nir_p20, round(quantile_cont(nir_, 0.75), 4) nir_p75, round(min(nir_), 4) nir_min, round(max(nir_), 4) nir_max, round(stddev_pop(nir_), 4) "nir_stdDev",
 round(arg_max(nir_, row(q, nir_)) filter (where q is not null), 4) nir_qmo from c group by px""", CLEAR)
def _(df):
    return rounded(C.agriculture(clear(df), ["px"], ["nir"], "ndvi", ["nir"]), ["px"])


@query("agg_04_urban_composite", OBS, """select px, round(median(nir_), 4) nir_median, round(quantile_cont(nir_, 0.01), 4) nir_p1, round(quantile_cont(nir_, 0.99), 4) nir_p99, round(median(nir_) filter (where q <= q25), 4) nir_median_p25, round(median(nir_) filter (where q >= q75), 4) nir_median_p75,
 round(min(nir_), 4) nir_min, round(max(nir_), 4) nir_max from j group by px""", TH)
def _(df):
    return rounded(C.urban(clear(df), ["px"], ["nir"], "ndvi"), ["px"])


@query("agg_05_plain_composite", OBS, "select px, round(median(nir_), 4) nir_median, round(avg(nir_), 4) nir_mean from c group by px", CLEAR)
def _(df):
    return rounded(C.reducers(clear(df), ["px"], ["nir"], ("median", "mean")), ["px"])


@query("agg_06_collection_stats", OBS, "select px, round(avg(nir), 4) nir_mean, round(stddev_pop(nir), 4) \"nir_stdDev\", round(avg(tir / 7), 4) tir_mean, round(stddev_pop(tir / 7), 4) \"tir_stdDev\" from r group by px")
def _(df):
    return rounded(C.reducers(df.withColumn("tir", F.col("tir") / 7), ["px"], ["nir", "tir"], ("mean", "stdDev")), ["px"])


@query("agg_08_region_mean", OBS, "select yr as year, scene as image, round(avg(nir), 4) nir, round(avg(red), 4) red from r where px % 3 = 0 group by yr, scene")
def _(df):
    px = df.select(F.col("yr").alias("year"), F.col("scene").alias("image"), F.col("tile"), F.lit(0).alias("row"), F.col("px").alias("col"), "nir", "red")
    region = df.where("px % 3 = 0").select("tile", F.lit(0).alias("row"), F.col("px").alias("col")).distinct()
    return rounded(D.region_series(px, region, ["nir", "red"]), ["year", "image"])


@query("agg_40_valid_share", OBS, "select tile, round(avg(case when red > 1000 then 1.0 else 0.0 end) * 100, 6) pct from r group by tile")
def _(df):
    return df.groupBy("tile").agg(F.round(F.avg((F.col("red") > 1000).cast("int")) * 100, 6).alias("pct"))


@query("agg_41_timing_stats", OBS, "select tile, min(red) least, list_sort(list(red))[count(red) // 2 + 1] upper_median, max(red) greatest from r group by tile")
def _(df):
    return D.timing_stats(df, ["tile"], "red")


@query("agg_45_reference_series", OBS, "select yr as year, round(avg(v), 4) nir from (select yr, tile, px, avg(nir) v from r group by yr, tile, px) group by yr")
def _(df):
    px = df.select(F.col("yr").alias("year"), "tile", F.lit(0).alias("row"), F.col("px").alias("col"), "nir")
    return rounded(D.reference_series(px, "nir"), ["year"])


@query("agg_34_before_after", OBS, """select tile, round(avg(nir) filter (where yr + 14 <= 2012), 4) pre_mean, round(median(nir) filter (where yr + 14 <= 2012), 4) pre_median, round(min(nir) filter (where yr + 14 <= 2012), 4) pre_min, round(max(nir) filter (where yr + 14 <= 2012), 4) pre_max,
 round(avg(nir) filter (where yr + 14 >= 2013), 4) post_mean, round(median(nir) filter (where yr + 14 >= 2013), 4) post_median, round(min(nir) filter (where yr + 14 >= 2013), 4) post_min, round(max(nir) filter (where yr + 14 >= 2013), 4) post_max from r group by tile""")
def _(df):
    return rounded(D.before_after(df.withColumn("year", F.col("yr") + 14), ["tile"], "nir"), ["tile"])


SHIFT = """select px as sample_id, count(*) n_obs, avg(nir) filter (where yr + 14 <= 2012) a, avg(nir) filter (where yr + 14 >= 2013) b, avg(nir) filter (where qa in (1, 2)) l57, avg(nir) filter (where qa = 3) l8, avg(nir) filter (where qa > 3) l9 from r where nir is not null group by px"""


def _shift(df):
    s = F.when(F.col("qa").isin(1, 2), "l7").when(F.col("qa") == 3, "l8").otherwise("l9")
    return D.sensor_shift(df.select(F.col("px").alias("sample_id"), (F.col("yr") + 14).alias("year"), s.alias("sensor"), F.col("nir").alias("value")))


@query("agg_35_sensor_shift", OBS, "select sample_id, n_obs, round(a, 4) pre2013_mean, round(b, 4) post2012_mean, round((b - a) / nullif(a, 0) * 100, 4) delta_pct, round(l57, 4) l57_mean, round(l8, 4) l8_mean, round(l9, 4) l9_mean from s", f"s as ({SHIFT})")
def _(df):
    return rounded(_shift(df), ["sample_id", "n_obs"])


@query("dom_34_shift_verdict", OBS, "select count(*) n, round(median(d), 6) median_delta, round(avg((d < 0)::int), 6) share_negative, avg((d < 0)::int) >= 0.7 widespread from (select (b - a) / nullif(a, 0) * 100 d from s) where d is not null", f"s as ({SHIFT})")
def _(df):
    return D.shift_verdict(_shift(df)).select("n", F.round("median_delta", 6).alias("median_delta"), F.round("share_negative", 6).alias("share_negative"), "widespread")


# --- scenes and tiles -----------------------------------------------------------


@query("src_01_scene_scan", SCENES, "select scene_id, acq, cloud_cover from r where acq >= date '1995-01-01' and acq < date '1999-01-01' and x1 > 10 and x0 < 60 and y1 > 20 and y0 < 80 and cloud_cover < 200 and scene_id not in (select scene_id from r where platform = 'l7' and wrs_row = 1)")
def _(df):
    trash = df.where("platform = 'l7' and wrs_row = 1").select("scene_id")
    return D.scan(df, "1995-01-01", "1999-01-01", 200, trash, (10, 20, 60, 80)).select("scene_id", "acq", "cloud_cover")


@query("src_03_catalogue_search", SCENES, "select scene_id, cloud_cover from r where acq >= date '1995-01-01' and acq < date '2001-01-01' and cloud_cover < 300 and platform = 'l8' order by cloud_cover, scene_id limit 100")
def _(df):
    return D.search(df, "1995-01-01", "2001-01-01", 300, "l8").select("scene_id", "cloud_cover")


@query("dom_30_choose_scenes", SCENES, "select scene_id from (select *, row_number() over (partition by wrs_path, wrs_row order by coalesce(cloud_cover, 999), scene_id) k from r) where k = 1 order by coalesce(cloud_cover, 999), scene_id limit 12")
def _(df):
    return D.choose(df, 12).select("scene_id")


@query("srt_04_lowest_cloud", SCENES, "select scene_id from r order by coalesce(cloud_cover, 999), scene_id limit 7")
def _(df):
    return D.choose(df, 7, diverse=False).select("scene_id")


@query("agg_12_distinct_path_row", SCENES, "select distinct wrs_path, wrs_row from r")
def _(df):
    return D.path_rows(df)


@query("win_10_clearest_each", SCENES, "select scene_id, wrs_path, wrs_row from (select *, row_number() over (partition by wrs_path, wrs_row order by coalesce(cloud_cover, 999), scene_id) k from r) where k = 1")
def _(df):
    return D.clearest_each(df).select("scene_id", "wrs_path", "wrs_row")


@query("agg_09_class_areas", GRID, "select tile, value class_id, round(sum(900.0 + elev) / 10000, 6) ha from r where value <> 0 group by tile, value")
def _(df):
    return D.class_areas(df.select("tile", F.col("value").alias("class_id"), (F.lit(900.0) + F.col("elev")).alias("m2"))).withColumn("ha", F.round("ha", 6))


@query("set_01_union_collections", SCENES, "select scene_id from r where platform = 'l7' union all select scene_id from r where wrs_row < 3")
def _(df):
    return D.merged(df.where("platform = 'l7'"), df.where("wrs_row < 3")).select("scene_id")


@query("jon_02_geo_09_box_overlap", SCENES, "select a.scene_id a_id, b.scene_id b_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) area from p a join p b on a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1", "p as (select * from r where wrs_row = 2 and wrs_path = 11)")
def _(df):
    p = df.where("wrs_row = 2 and wrs_path = 11")
    box = lambda i: p.select(F.col("scene_id").alias(i), "x0", "y0", "x1", "y1")
    return G.overlaps(box("a_id"), box("b_id"), 10.0, 6).select("a_id", "b_id", F.col("inter_area").alias("area"))


@query("agg_10_land_overlap", GRID, "select tile, count(*) total, count(nullif(value, 0)) valid, round(count(nullif(value, 0))::double / greatest(count(*), 1) * 100, 6) overlap_pct from r group by tile")
def _(df):
    out = D.land_overlap(df.withColumn("class_id", F.expr("nullif(value, 0)")))
    return out.withColumn("overlap_pct", F.round("overlap_pct", 6))


@query("agg_11_class_profile", GRID, """select tile, n_classes, dominant, round(valid_ha, 4) valid_ha, n_evaluable, round(ha_59, 4) ha_59, round(ha_66, 4) ha_66, round(dominance, 6) dominance, round(evaluable_pct, 6) evaluable_pct from (select tile, count(*) n_classes, arg_max(value, row(ha, -value)) dominant, sum(ha) valid_ha, count(*) filter (where value in (59, 66)) n_evaluable,
 sum(case when value = 59 then ha else 0.0 end) ha_59, sum(case when value = 66 then ha else 0.0 end) ha_66, max(ha) / sum(ha) dominance, count(*) filter (where value in (59, 66)) / 2.0::double * 100 evaluable_pct from (select tile, value, count(*) * 0.25::double ha from r where value <> 0 group by tile, value) group by tile)""")
def _(df):
    areas = df.where("value != 0").select("tile", F.col("value").alias("class_id"), F.lit(0.25).alias("ha"))
    out = D.class_profile(areas, [59, 66]).drop("summary")
    return rounded(out, ["tile", "n_classes", "dominant", "n_evaluable"], 6).select("tile", "n_classes", "dominant", F.round("valid_ha", 4).alias("valid_ha"), "n_evaluable", F.round("ha_59", 4).alias("ha_59"), F.round("ha_66", 4).alias("ha_66"), "dominance", "evaluable_pct")


PROFILE = "t as (select tile, count(distinct value) n_classes, count(nullif(value, 0))::double overlap_pct, sum(elev)::double / 1000 dominance, -56 + 38.5::double * (avg(elev) - 20) / 12 lat from r group by tile)"


def _tiles(df):
    return df.groupBy("tile").agg(F.count_distinct("value").alias("n_classes"), F.expr("cast(count(nullif(value, 0)) as double)").alias("overlap_pct"), (F.sum("elev").cast("double") / 1000).alias("dominance"), (F.lit(-56) + 38.5 * (F.avg("elev") - 20) / 12).alias("lat"))


@query("srt_03_rank_tiles", GRID, "select tile from t order by n_classes desc, overlap_pct desc, dominance, tile limit 9", PROFILE)
def _(df):
    return D.rank_tiles(_tiles(df), 9).select("tile")


@query("dom_29_tiles_by_latitude", GRID, """select tile, band from (select tile, band, row_number() over (partition by band order by n_classes desc, overlap_pct desc, dominance, tile) k from b where band between 1 and 6) where k = 1 union all
 select tile, 0 from (select * from b where tile not in (select tile from (select tile, row_number() over (partition by band order by n_classes desc, overlap_pct desc, dominance, tile) k from b where band between 1 and 6) where k = 1) order by n_classes desc, overlap_pct desc, dominance, tile limit 3)""",
       PROFILE + ", b as (select *, case when lat < -56 then 0 when lat >= -17.5 then 7 else floor((lat + 56) / (38.5 / 6)) + 1 end::bigint band from t)")
def _(df):
    return D.by_latitude(_tiles(df), 6, 3).select("tile", "band")


# --- grids ----------------------------------------------------------------------


@query("ras_01_focal_mean_tpi", GRID, "select tile, row, col, cast(trunc(elev - (select avg(b.elev) from r b where b.tile = a.tile and b.row between a.row - 6 and a.row + 6 and b.col between a.col - 6 and a.col + 6)) as int) tpi from r a")
def _(df):
    return R.tpi(df, gaps=True).select("tile", "row", "col", "tpi")


@query("ras_02_erosion", GRID, "select a.tile, a.row, a.col, min(b.value) v from r a join r b on a.tile = b.tile and (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 4 group by a.tile, a.row, a.col")
def _(df):
    return R.disk(df, "value", 2, gaps=True).select("tile", "row", "col", F.col("value_min").alias("v"))


@query("ras_03_dilation", GRID, "select a.tile, a.row, a.col, max(b.value) v from r a join r b on a.tile = b.tile and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by a.tile, a.row, a.col")
def _(df):
    return R.focal(df, "value", 1, "max", gaps=True).select("tile", "row", "col", F.col("value_max").alias("v"))


@query("ras_04_entropy", GRID, """select tile, row, col, round(abs(sum(n / t * log2(n / t)) * 100), 6) h from (select *, sum(n) over (partition by tile, row, col) t from (select a.tile, a.row, a.col, b.value, count(*)::double n
 from r a join r b on a.tile = b.tile and abs(a.row - b.row) <= 2 and abs(a.col - b.col) <= 2 group by all)) group by tile, row, col""")
def _(df):
    return R.entropy(df, "value", 2).select("tile", "row", "col", F.round(F.abs("value_entropy"), 6).alias("h"))


@query("ras_05_slope", GRID, """select a.tile, a.row, a.col, cast(floor(degrees(atan(sqrt(dx * dx + dy * dy))) * 100) as int) slope from (select m.tile, m.row, m.col, (ne.elev + 2 * e.elev + se.elev - nw.elev - 2 * w.elev - sw.elev) / 240.0::double dx, (sw.elev + 2 * s.elev + se.elev - nw.elev - 2 * n.elev - ne.elev) / 240.0::double dy from r m
 left join r n on n.tile = m.tile and n.row = m.row - 1 and n.col = m.col left join r s on s.tile = m.tile and s.row = m.row + 1 and s.col = m.col left join r w on w.tile = m.tile and w.row = m.row and w.col = m.col - 1 left join r e on e.tile = m.tile and e.row = m.row and e.col = m.col + 1
 left join r nw on nw.tile = m.tile and nw.row = m.row - 1 and nw.col = m.col - 1 left join r ne on ne.tile = m.tile and ne.row = m.row - 1 and ne.col = m.col + 1 left join r sw on sw.tile = m.tile and sw.row = m.row + 1 and sw.col = m.col - 1 left join r se on se.tile = m.tile and se.row = m.row + 1 and se.col = m.col + 1) a""")
def _(df):
    return R.terrain(df).select("tile", "row", "col", "slope")


@query("ras_06_translate", GRID, "select tile, row + 2 as row, col - 1 as col, value from r")
def _(df):
    return R.translate(df, F.lit(-1), F.lit(2)).select("tile", "row", "col", "value")


@query("ras_07_resample_nearest", GRID, "select t.tile, t.row, t.col, coalesce(s.value, 0) as value from r t left join r s on s.tile = t.tile and s.row = floor((t.row + 0.5) * 0.5) and s.col = floor((t.col + 0.5) * 0.5)")
def _(df):
    return R.resample_nearest(df, df.select("tile", "row", "col"), 0.5, "value")


@query("ras_13_first_valid", GRID, "select tile, row, col, arg_min(value, clip) as value from (select tile, cast(row // 2 as int) as row, cast(col // 2 as int) as col, value, row * 100 + col as clip from r where value <> 0) group by tile, row, col")
def _(df):
    return R.first_valid(df.select("tile", F.expr("cast(floor(row / 2) as int)").alias("row"), F.expr("cast(floor(col / 2) as int)").alias("col"), "value", (F.col("row") * 100 + F.col("col")).alias("clip")))


@query("ras_14_single_class", GRID, "select tile, count(distinct nullif(value, 0)) n_classes, min(nullif(value, 0)) class_id, count(distinct nullif(value, 0)) <= 1 single from r group by tile")
def _(df):
    return R.is_single_class(df, "tile", "value")


@query("ras_12_rasterize", GRID, "select tile, row, col, max(id) as label from (select tile, row, col, col * 10.0::double + 5 x, row * 10.0::double + 5 y from r) p join (values (1, 0.0, 0.0, 75.0, 45.0), (2, 40.0, 20.0, 150.0, 60.0), (3, 5.0, 5.0, 5.0, 9.0)) b(id, x0, y0, x1, y1) on x >= x0 and x < x1 and y >= y0 and y < y1 group by tile, row, col")
def _(df):
    px = df.select("tile", "row", "col", (F.col("col") * 10.0 + 5).alias("x"), (F.col("row") * 10.0 + 5).alias("y"))
    return R.rasterize(px, df.sparkSession.createDataFrame([(1, 0.0, 0.0, 75.0, 45.0), (2, 40.0, 20.0, 150.0, 60.0), (3, 5.0, 5.0, 5.0, 9.0)], "id int, x0 double, y0 double, x1 double, y1 double"), 50.0)


@query("ras_15_pixel_area", LULC, "select rect, px, year, round(pow(0.00027 * pi() / 180 * 6371007.181, 2) * cos(radians(lat)), 6) as m2 from r")
def _(df):
    return df.select("rect", "px", "year", F.round(R.pixel_area(F.col("lat"), 0.00027), 6).alias("m2"))
