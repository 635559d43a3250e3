"""Queries over SQL functions, raster and vector files, polygons with holes, edits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sql as Q
from ..operators import labels as B
from ..operators import objects as O
from ..operators import params as P
from ..operators import polygons as G
from ..operators.rounds import shared_dir
from ..sources import raster_files as R
from ..sources import vector_files as V
from .images import INDEX_SQL, KEYS, UNIT, unit
from .maps import patches
from .registry import query
from .roles import GRID, OBS, POLYS, RECTS


def _fresh(df, kind: str) -> str:
    """A new folder in the shared one, for files that the query writes and reads."""
    return f"{shared_dir(df.sparkSession)}/landcube-{kind}-{uuid.uuid4().hex}"


# --- SQL -------------------------------------------------------------------------

NAMES = ("cai", "gcvi", "pri", "ndbi", "ndsi", "mbi")


@query("sql_01_index_stack", OBS, "select tile, px, scene, qa, " + ", ".join(f"round(({INDEX_SQL[n]}) * 10000, 3) as {n}" for n in NAMES) + " from u", f"u as ({UNIT})")
def _(df):
    Q.register(df.sparkSession)
    stack = ", ".join(f"round(lc_{n}({Q.INDICES[n][0].replace(' ', ', ')}) * 10000, 3) as {n}" for n in NAMES)
    return df.sparkSession.sql(f"select {', '.join(KEYS)}, {stack} from {{obs}}", obs=unit(df))


@query("sql_02_rectangles", RECTS, """select grid_id tile, c::int as col, w::int as row, x0 + c * 9.0 rx0, y1 - w * 9.0 - 9 ry0 from r, generate_series(0, 3) a(c), generate_series(0, 2) b(w)
 where (least(x0 + c * 9.0 + 9, x1) - (x0 + c * 9.0)) * (y1 - w * 9.0 - greatest(y1 - w * 9.0 - 9, y0)) >= 0.7 * 81""")
def _(df):
    Q.register(df.sparkSession)
    return df.sparkSession.sql("select grid_id tile, s.col, s.row, s.rx0, s.ry0 from {tiles}, lateral lc_rectangles(x0, y0, x1, y1, 9.0D, 0.7D) s", tiles=df)


# --- raster files ----------------------------------------------------------------


def _files(df, path: str, name) -> None:
    """The class grid as one file a tile: 30 m pixels, bands value and elev."""
    px = df.select(name.alias("name"), "row", "col", "value", "elev")
    grids = px.groupBy("name").agg(F.lit(32719).alias("epsg"), F.lit(300000.0).alias("x0"), F.lit(6300000.0).alias("y0"), F.lit(30.0).alias("dx"), F.lit(-30.0).alias("dy"), F.lit(20).alias("width"), (F.max("row") + 1).alias("height"))
    R.write(px, path, grids, ["value", "elev"], "i2", 0, block=16, predictor=2)


@query("src_04_raster_window", GRID, "select replace(tile, '#', '-') as name, row, col, nullif(value, 0)::smallint as value, elev::smallint as elev, 300015.0::double + col * 30 x, 6299985.0::double - row * 30 y from r where row >= 1 and row < 4 and col >= 3 and col < 18")
def _(df):
    """What the sink has written comes back from a window; pixels that the grid lacks are NULL there."""
    path = _fresh(df, "rasters")
    _files(df, path, F.replace("tile", F.lit("#"), F.lit("-")))
    return R.read(df.sparkSession, path, window=(1, 4, 3, 18)).where("elev is not null").select("name", "row", "col", "value", "elev", "x", "y")


@query("src_07_nearest_grid", GRID, """select name, b.i::int as row, c.j::int as col, nullif(value, 0)::smallint as value, elev::smallint as elev from (select distinct replace(tile, '#', '-') as name, tile from r) t, generate_series(0, 2) b(i), generate_series(0, 9) c(j)
 join r on true where r.tile = t.tile and r.row = floor((b.i + 0.5) * 2.5) and r.col = floor((c.j + 0.5) * 2.5 - 0.5)""")
def _(df):
    """On a grid of 75 m pixels that begins half a pixel to the west."""
    path = _fresh(df, "rasters")
    _files(df, path, F.replace("tile", F.lit("#"), F.lit("-")))
    grid = R.Grid(32719, 300000.0 - 15.0, 6300000.0, 75.0, -75.0, 10, 3)
    return R.read(df.sparkSession, path, target=grid).where("elev is not null").select("name", "row", "col", "value", "elev")


# --- polygons --------------------------------------------------------------------

#: Each box, made larger, without a smaller one in it.
HOLE = "h as (select grid_id, k, bal, x0, y0, x0 + 135 x1, y0 + 125 y1, x0 + 40 hx0, y0 + 30 hy0, x0 + 90 hx1, y0 + 80 hy1 from r)"


def _common(a: str, b: str) -> str:
    side = lambda d, p, q: f"greatest(0, least(a.{p}{d}1, b.{q}{d}1) - greatest(a.{p}{d}0, b.{q}{d}0))"
    return f"{side('x', a, b)} * {side('y', a, b)}"


COMMON = f"({_common('', '')} - {_common('h', '')} - {_common('', 'h')} + {_common('h', 'h')})"


def _holed(df):
    c = F.col
    outer, hole = G.rectangle(c("x0"), c("y0"), c("x0") + 135, c("y0") + 125), G.rectangle(c("x0") + 40, c("y0") + 30, c("x0") + 90, c("y0") + 80)
    return df.withColumn("parts", F.array(F.array(outer[0][0], hole[0][0])))


@query("geo_02_polygon_overlaps", RECTS, f"select a.grid_id a_id, b.grid_id b_id, round({COMMON}, 6) inter_area from h a join h b on a.grid_id < b.grid_id where {COMMON} > 1", HOLE)
def _(df):
    return G.self_overlaps(_holed(df), "grid_id", 40.0).withColumn("inter_area", F.round("inter_area", 6))


@query("geo_10_polygon_previous", RECTS, f"select grid_id, round(o, 6)::double ovlp_m2, round(o / 14375 * 100, 6)::double ovlp_pct from (select a.grid_id, coalesce(sum(case when b.k % 3 = 0 then {COMMON} end), 0) o from h a join h b on true where a.k % 3 <> 0 group by a.grid_id) where o <= 1 or o / 14375 * 100 <= 20", HOLE)
def _(df):
    from ..operators import spatial as S

    px = _holed(df)
    out = S.previous_overlap(px.where("k % 3 <> 0"), px.where("k % 3 = 0"), 40.0, max_pct=20.0)
    return out.select("grid_id", F.round("ovlp_m2", 6).alias("ovlp_m2"), F.round("ovlp_pct", 6).alias("ovlp_pct"))


@query("geo_13_single_parts", RECTS, "select grid_id, p::int part, case p when 0 then 875.0::double else 100.0::double end area from r, generate_series(0, 1) g(p)")
def _(df):
    c = F.col
    two = F.concat(G.rectangle(c("x0"), c("y0"), c("x1"), c("y1")), G.rectangle(c("x0") + 500, c("y0"), c("x0") + 510, c("y0") + 10))
    return V.single_parts(df.select("grid_id", two.alias("parts"))).select("grid_id", "part", F.round(G.area(c("parts")), 6).alias("area"))


@query("geo_14_union_rings", GRID, "select tile, g::int g, count(*) n_pixels, sum((select count(*) from (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(i, j) where not exists (select 1 from w b where b.tile = w.tile and b.g = w.g and b.row = w.row + o.i and b.col = w.col + o.j)))::bigint edge from w group by tile, g",
       "w as (select tile, row, col, case when value = 33 then 2 else 1 end g from r where value <> 0)")
def _(df):
    found = O.polygonize(df.select("tile", "row", "col", "value"), connectivity=4).withColumn("g", F.when(F.col("class_id") == 33, 2).otherwise(1))
    sizes = found.groupBy("tile", "g").agg(F.sum("n_pixels").alias("n_pixels"))
    edge = F.aggregate("rings", F.lit(0).cast("bigint"), lambda s, r: s + F.size(r)).alias("edge")
    return sizes.join(O.dissolve_rings(found, ["tile", "g"]), ["tile", "g"]).select("tile", "g", "n_pixels", edge)


@query("src_15_gpkg_box", RECTS, "select grid_id, k, bal, x0, y0, 14375.0::double area from h where x1 >= 200 and x0 <= 600 and y1 >= 300 and y0 <= 700", HOLE)
def _(df):
    path = _fresh(df, "vectors")
    V.write_gpkg(_holed(df).select("grid_id", "k", "bal", "parts"), path, "rects", 32719, max_rows=40)
    found = V.read_gpkg(df.sparkSession, path, box=(200.0, 300.0, 600.0, 700.0))
    return found.select("grid_id", F.col("k").cast("int").alias("k"), "bal", "x0", "y0", F.round(G.area(F.col("parts")), 6).alias("area"))


# --- sieves: one sweep and one round, which SQL can say ----------------------------

NEAR8 = "(values (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(i, j)"


@query("ras_10_sieve_one_sweep", GRID, f"""select r.tile, r.row, r.col, r.value, coalesce(v.v, f.v, r.value)::int sieved from r left join vote v using (tile, row, col) left join far f using (tile, row, col)""",
       patches(8) + f""", st as materialized (select r.tile, r.row, r.col, r.value, coalesce(n < case when r.value in (11, 33, 34, 23, 67, 61, 24) then 2 else 6 end, false) pend from r left join (select tile, row, col, count(*) over (partition by tile, c) n from lab) using (tile, row, col)),
 vote as materialized (select tile, row, col, v from (select p.tile, p.row, p.col, b.value v, row_number() over (partition by p.tile, p.row, p.col order by count(*) desc, b.value) k from st p, {NEAR8} join st b on b.tile = p.tile and b.row = p.row + o.i and b.col = p.col + o.j where p.pend and not b.pend and b.value <> 0 group by p.tile, p.row, p.col, b.value) where k = 1),
 after as materialized (select st.tile, st.row, st.col, coalesce(v, value) v, pend and v is null pend from st left join vote using (tile, row, col)),
 far as materialized (select tile, row, col, v from (select p.tile, p.row, p.col, b.v, row_number() over (partition by p.tile, p.row, p.col order by (p.row - b.row) ^ 2 + (p.col - b.col) ^ 2, b.row, b.col) k from after p join after b on b.tile = p.tile and not b.pend and b.v <> 0 where p.pend) where k = 1)""")
def _(df):
    return O.sieve_majority(df.select("tile", "row", "col", "value"), sweeps=1)


# --- edits, black lists ------------------------------------------------------------


@query("jon_13_overwritten", POLYS, "select grid_id, patch_id, case when patch_id % 9 = 0 then 'aprobado' else poly_qa end poly_qa, case when patch_id % 9 = 0 and patch_id % 2 = 0 then 66 else corr_id end corr_id from r")
def _(df):
    px = df.withColumn("poly_uid", F.concat_ws("|", "grid_id", "patch_id"))
    edits = px.where("patch_id % 9 = 0").select("poly_uid", F.lit("aprobado").alias("poly_qa"), F.when(F.col("patch_id") % 2 == 0, 66).alias("corr_id"))
    return B.overwritten(px, edits).select("grid_id", "patch_id", "poly_qa", "corr_id")


@query("set_05_united_black_lists", POLYS, "select grid_id, rev_year, array_to_string(list_sort(list_distinct(list('S' || patch_id % 7) || list('S' || patch_id % 4))), ',') scenes from r group by grid_id, rev_year")
def _(df):
    lists = df.select("grid_id", "rev_year", F.array(*(F.concat(F.lit("S"), (F.col("patch_id") % m).cast("string")) for m in (7, 4))).alias("black_list"))
    return P.united_black_lists(lists, ["grid_id", "rev_year"]).select("grid_id", "rev_year", F.array_join("black_list", ",").alias("scenes"))
