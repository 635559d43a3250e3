"""Queries over objects on grids, labels from class maps, projected shadows, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks as M
from ..operators import composite as C
from ..operators import generate as G
from ..operators import labels as B
from ..operators import raster as R
from ..operators import spatial as S
from ..operators import views as W
from .registry import query
from .roles import GRID, OBS, RECTS


def patches(conn: int, rows: str = "r") -> str:
    """Common tables: ``lab`` has each pixel's component ``c``, named by its first pixel."""
    touch = "abs(a.row - b.row) + abs(a.col - b.col) = 1" if conn == 4 else "abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and a.i <> b.i"
    return f"""px as materialized (select tile, row, col, value, row * 1000 + col i from {rows} where value <> 0), ed as materialized (select a.tile, a.i a, b.i b from px a join px b on a.tile = b.tile and a.value = b.value and {touch}),
 reach as (select tile, i, i c from px union select ed.tile, ed.b, reach.c from reach join ed on ed.tile = reach.tile and ed.a = reach.i where ed.b > reach.c), lab as materialized (select px.*, m.c from px join (select tile, i, min(c) c from reach group by tile, i) m using (tile, i))"""


@query("ras_08_components", GRID, """select r.tile, r.row, r.col, r.value, coalesce(k, 0)::bigint component, coalesce(n, 0)::bigint size from r left join (select tile, row, col, dense_rank() over (partition by tile order by c) k, count(*) over (partition by tile, c) n from lab) using (tile, row, col)""", patches(8))
def _(df):
    return R.components(df.select("tile", "row", "col", "value"), connectivity=8)


@query("ras_09_sieve_merge", GRID)
def _(df):
    return R.sieve(df.select("tile", "row", "col", "value"), how="merge", size=4)


@query("ras_10_sieve_majority", GRID)
def _(df):
    return R.sieve(df.select("tile", "row", "col", "value"))


EDGES = "(select count(*) from (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(i, j) where not exists (select 1 from lab b where b.tile = lab.tile and b.c = lab.c and b.row = lab.row + o.i and b.col = lab.col + o.j))"


@query("ras_11_polygonize", GRID, f"select tile, dense_rank() over (partition by tile order by c)::bigint patch_id, class_id, n_pixels, edge from (select tile, c, min(value)::int class_id, count(*)::bigint n_pixels, sum({EDGES})::bigint edge from lab group by tile, c)", patches(8))
def _(df):
    out = R.polygonize(df.select("tile", "row", "col", "value"))
    # rings have unit steps: their corners are as many as the patch's outer edges
    return out.select("tile", "patch_id", "class_id", "n_pixels", F.aggregate("rings", F.lit(0).cast("bigint"), lambda s, r: s + F.size(r)).alias("edge"))


# --- labels ----------------------------------------------------------------------

PLAN = "pl as (select distinct tile, 2020 y, length(tile) tier from r where tile <> 'Brand#11')"


def _pixels(df):
    return df.select(F.col("tile").alias("grid_id"), F.lit(2020).alias("rev_year"), "row", "col", F.col("value").alias("class_id"))


def _plan(df):
    return df.where("tile <> 'Brand#11'").select(F.col("tile").alias("grid_id"), F.lit(2020).alias("review_year"), F.length("tile").alias("review_tier"), F.lit("x").alias("review_years")).distinct()


@query("dom_23_labels", GRID, """select tile grid_id, y rev_year, class_id, row_number() over (partition by tile, class_id order by c)::int patch_id, n::bigint n_pixels, n * 900.0 / 10000 area_ha, round(n * 100.0::double / t, 8) pct_rect, tile || '|2020|' || class_id || '|' || row_number() over (partition by tile, class_id order by c) poly_uid, class_id lbl_id, tier rev_tier
 from (select tile, c, min(value)::int class_id, count(*) n from lab group by tile, c) join pl using (tile) join (select tile, count(*) t from r group by tile) using (tile) where n * 900.0 / 10000 >= 0.18""", f"{patches(4)}, {PLAN}")
def _(df):
    out = G.polygons(_pixels(df), _plan(df), min_patch_ha=0.18)
    return out.select("grid_id", "rev_year", "class_id", "patch_id", "n_pixels", "area_ha", F.round("pct_rect", 8).alias("pct_rect"), "poly_uid", "lbl_id", "rev_tier")


@query("snk_11_label_rasters", GRID, "select r.tile grid_id, 2020 rev_year, r.row, r.col, r.value class_id, (case when n >= 3 then k else 0 end)::bigint patch from r left join (select tile, row, col, dense_rank() over (partition by tile order by c) k, count(*) over (partition by tile, c) n from lab) using (tile, row, col)".replace("(case when n >= 3 then k else 0 end)", "coalesce(case when n >= 3 then k else 0 end, 0)"), patches(4))
def _(df):
    return G.rasters(_pixels(df), min_pixels=3)


@query("dom_33_patch_diagnostics", GRID, """select class_id, conn, count(*) n_parches, round(sum(px) * 0.09::double, 2) ha_total, round(quantile_cont(px, 0.5), 1) px_p50, max(px) px_max, round(avg((px <= 5)::int) * 100, 1) pct_parches_speckle
 from (select value class_id, 8 conn, count(*) px from lab group by tile, c, value) group by class_id, conn""", patches(8))
def _(df):
    out = G.patch_diagnostics(_pixels(df)).where("conn = 8")
    return out.select("class_id", "conn", "n_parches", "ha_total", "px_p50", "px_max", "pct_parches_speckle")


@query("flt_13_min_patch", GRID, "select tile, count(*) n from (select tile, c, count(*) k from lab group by tile, c) where k * 900 >= 4500 group by tile", patches(8))
def _(df):
    found = R.components(df.select("tile", "row", "col", "value")).where("component > 0").groupBy("tile", "component").agg(F.count("*").alias("n_pixels"))
    return B.large_patches(found, 0.45).groupBy("tile").agg(F.count("*").alias("n"))


@query("dom_24_sieved_mosaics", GRID)
def _(df):
    zones = df.select(F.col("tile").alias("grid_id"), F.when(F.substring("tile", 7, 1) < "3", 18).otherwise(19).alias("utm_zone")).distinct()
    return G.sieved_mosaics(_pixels(df), zones, size=3)


@query("src_08_clip", GRID, "select grid_id, tile, row, col from (select *, col * 30.0 + 15 x, row * 30.0 + 15 y from r) join (values ('A', 0.0, 0.0, 200.0, 75.0), ('B', 150.0, 30.0, 420.0, 120.0)) b(grid_id, x0, y0, x1, y1) on x >= x0 and x < x1 and y >= y0 and y < y1")
def _(df):
    px = df.select("tile", "row", "col", (F.col("col") * 30.0 + 15).alias("x"), (F.col("row") * 30.0 + 15).alias("y"))
    rects = df.sparkSession.createDataFrame([("A", 0.0, 0.0, 200.0, 75.0), ("B", 150.0, 30.0, 420.0, 120.0)], "grid_id string, x0 double, y0 double, x1 double, y1 double")
    return G.clip(px, rects, 100.0).select("grid_id", "tile", "row", "col")


# --- masks -----------------------------------------------------------------------

#: A scene on each tile of the grid, with a sun and clouds.
SCENE = "sc as (select *, (value = 66 and elev % 3 = 0)::int cloud, elev * 40.5 nir, elev * 20.25 swir1, elev * 10.125 swir2 from r)"
HEIGHTS = ", ".join(f"({h})" for h in M.HEIGHTS)
SHIFT = f"""sh as (select distinct tile, row + round(sin(35.0 * pi() / 180 + pi() / 2) * tan(pi() / 2 - 50.0 * pi() / 180) * h / 300)::int row, col + round(cos(35.0 * pi() / 180 + pi() / 2) * tan(pi() / 2 - 50.0 * pi() / 180) * h / 300)::int col from sc, (values {HEIGHTS}) v(h) where cloud = 1),
 gr as (select distinct tile, row + i row, col + j col from sh, (values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(i, j))"""


def _scene(df):
    c = F.col
    return df.withColumns({
        "scene": F.lit("s"), "cloud": ((c("value") == 66) & (c("elev") % 3 == 0)).cast("int"), "nir": c("elev") * 40.5, "swir1": c("elev") * 20.25, "swir2": c("elev") * 10.125,
        "azimuth": F.lit(35.0), "elevation": F.lit(50.0)})


@query("msk_06_agg_07_project_shadow", GRID, "select sc.tile, sc.row, sc.col, (gr.tile is not null and nir + swir1 + swir2 < 2200 and cloud = 0)::int shadow from sc left join gr on gr.tile = sc.tile and gr.row = sc.row and gr.col = sc.col", f"{SCENE}, {SHIFT}")
def _(df):
    return M.project_shadow(_scene(df), dark=2200.0, scale=300.0).select("tile", "row", "col", "shadow")


@query("msk_05_tdom_eroded", GRID, """select a.tile, a.row, a.col, min(b.t)::int tdom from td a join td b on a.tile = b.tile and (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 16 group by a.tile, a.row, a.col""",
       f"""{SCENE}, td as (select *, coalesce((nir - avg(nir) over w) / nullif(stddev_pop(nir) over w, 0) < 0.9 and (swir1 - avg(swir1) over w) / nullif(stddev_pop(swir1) over w, 0) < 0.9 and nir + swir1 < 4000, false)::int t from sc window w as (partition by tile))""")
def _(df):
    return M.tdom(_scene(df), ["tile"], z=0.9, erode=4).select("tile", "row", "col", "tdom")


@query("msk_07_projection", GRID, "select sc.tile, sc.row, sc.col, (elev % 3 = 0)::int cloud_flag_mask, (g2.tile is not null and nir + swir1 + swir2 < 2200 and elev % 3 <> 0 and not dark)::int cloud_shadow_tdom_mask from (select *, coalesce((nir - avg(nir) over w) / nullif(stddev_pop(nir) over w, 0) < -1 and (swir1 - avg(swir1) over w) / nullif(stddev_pop(swir1) over w, 0) < -1 and nir + swir1 < 4000, false) dark from sc window w as (partition by tile)) sc left join gr g2 on g2.tile = sc.tile and g2.row = sc.row and g2.col = sc.col",
       f"{SCENE.replace('(value = 66 and elev % 3 = 0)', '(elev % 3 = 0)')}, {SHIFT}")
def _(df):
    px = _scene(df).drop("cloud").withColumns({"qa": F.when(F.col("elev") % 3 == 0, 8).otherwise(0), "blue": F.lit(500.0), "green": F.lit(400.0), "red": F.lit(300.0)})
    out = M.get_masks(px, ["tile"], cloud_score_=False, tdom_=True, shadow_flag_=True, dark=2200.0, scale=300.0)
    return out.select("tile", "row", "col", F.col("cloud_flag_mask").cast("int").alias("cloud_flag_mask"), "cloud_shadow_tdom_mask")


@query("prj_10_promote_median", OBS, "select tile, px, max(nir) ndvi_max, median(red) mbi from r group by tile, px")
def _(df):
    stats = df.groupBy("tile", "px").agg(F.median("red").alias("mbi_median"), F.min("red").alias("mbi_min"), F.max("red").alias("mbi_max"), F.max("nir").alias("ndvi_max"))
    return C.promote_median(stats, ["mbi"])


#: The statistics of a band as SQL, by its suffix.
STATS = {
    "median": "median({b})", "median_dry": "median({b}) filter (where ndvi <= q25)", "median_wet": "median({b}) filter (where ndvi >= q75)", "min": "min({b})", "max": "max({b})",
    "amp": "max({b}) - min({b})", "stdDev": "stddev_pop({b})",
}
ALL_BANDS = ", ".join(f'round({STATS[k].format(b=b)}, 6) + 0.0 "{b}_{k}"' for b in W.REDUCED_BASES for k in W.REDUCED_STATS)


@query("prj_11_reduced_bands", OBS, f"select px, {ALL_BANDS}, round(min(q25), 6) + 0.0 ndvi_p25, round(min(q75), 6) + 0.0 ndvi_p75 from t group by px",
       """e as (select *, (nir - red) / nullif(nir + red, 0) ndvi, (nir - swir1) / nullif(nir + swir1, 0) ndwi from r),
 t as (select e.*, q25, q75 from e join (select px, quantile_cont(ndvi, 0.25) q25, quantile_cont(ndvi, 0.75) q75 from e group by px) using (px))""")
def _(df):
    """All 58 bands of the reduced product, in its order."""
    ratio = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    out = C.seasonal(df.withColumns({"ndvi": ratio("nir", "red"), "ndwi": ratio("nir", "swir1")}), ["px"], W.REDUCED_BASES, "ndvi")
    return out.select("px", *((F.round(b, 6) + 0.0).alias(b) for b in W.reduced_bands()))  # no negative zero


@query("agg_46_band_series", OBS, "select yr as year, acq::varchar image, round(avg(red), 6) red_median, round(avg(nir), 6) nir_median from r where tile % 2 = 0 group by yr, acq")
def _(df):
    from ..operators import diagnostics as D

    px = df.select("tile", F.col("px").alias("row"), F.lit(0).alias("col"), F.col("yr").alias("year"), F.col("acq").cast("string").alias("image"), F.col("red").alias("red_median"), F.col("nir").alias("nir_median"), "tir")
    region = px.where("tile % 2 = 0").select("tile", "row", "col").distinct()
    bands = [c for c in px.columns if c.endswith("_median")]
    out = D.region_series(px, region, bands)
    return out.select("year", "image", *(F.round(b, 6).alias(b) for b in bands))


# --- tiles and points ------------------------------------------------------------


#: Easting and northing of a tile's lower left corner from its letters, in zone 19 and band H.
CORNER = """t as (select grid_id, '19H' || substr('ABCDEFGH', (1 + k % 8)::int, 1) || substr('ABCDEFGHJKLMNPQRSTUV', (1 + k % 20)::int, 1) tile, k % 8 c, k % 20 w from r),
 q as (select *, (c + 1) * 100000 x, w * 100000 + ceil(greatest(5500000 - w * 100000, 0) / 2000000.0) * 2000000 y from t)"""


@query("geo_03_tile_box", RECTS, "select grid_id, tile, x::bigint x0, y::bigint y0, (x + 100000)::bigint x1, (y + 100000)::bigint y1 from q", CORNER)
def _(df):
    """The corners in degrees, projected again, are those that the letters name."""
    letter = F.substring(F.lit("ABCDEFGH"), (1 + F.col("k") % 8).cast("int"), F.lit(1))
    row = F.substring(F.lit("ABCDEFGHJKLMNPQRSTUV"), (1 + F.col("k") % 20).cast("int"), F.lit(1))
    box = S.tile_box(df.select("grid_id", F.concat(F.lit("19H"), letter, row).alias("tile")))
    (x0, y0), (x1, y1) = (S.to_utm(F.col(a), F.col(b), F.lit(19), True) for a, b in (("west", "south"), ("east", "north")))
    return box.select("grid_id", "tile", *(F.round(c).cast("long").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


@query("geo_07_random_points", RECTS, "select grid_id as key, count(*) n, true inside from r, range(5) group by grid_id")
def _(df):
    boxes = df.select(F.col("grid_id").alias("key"), "x0", "y0", "x1", "y1")
    # half of each box: above its diagonal
    wide = S.random_points(boxes, 400, 7, keep=("x0", "y0", "x1", "y1")).where((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")) < (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    some = wide.groupBy("key").agg(F.least(F.count("*"), F.lit(5)).alias("n"), F.min((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))).alias("inside"))
    return some


@query("geo_08_buffer", RECTS, "select a.grid_id, b.grid_id as key from r a join r b on (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 14400")
def _(df):
    px = df.select("grid_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return S.near_points(px, df.select(F.col("grid_id").alias("key"), F.col("x0").alias("px"), F.col("y0").alias("py"))).select("grid_id", "key")


@query("geo_17_tile_named", RECTS, "select grid_id, k from r where grid_id = 'R7'")
def _(df):
    return S.tile_named(df.select("grid_id", "k"), "R7", "grid_id")
