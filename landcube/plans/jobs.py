"""Queries over job parameters, crosswalks, names and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import taxonomy as T
from ..operators import params as P
from ..operators import spatial as G
from .registry import query
from .roles import OBS, RECTS

#: Spreadsheet rows from orders.
PARAMS = """select cast(1999 + o_orderkey % 26 as varchar(20)) as "YEAR", concat(' C', cast(o_custkey % 40 as varchar(20)), ' ') as "GRID_NAME", case o_orderkey % 6 when 0 then 'L5' when 1 then '7' when 2 then 'l8' when 3 then '9' when 4 then 'X1' else ' l7 ' end as "SATELLITE",
 case when o_orderkey % 4 = 0 then null else concat('S', cast(o_orderkey % 5 as varchar(20)), ',', ' S', cast(o_orderkey % 3 as varchar(20)), ' ;') end as "BLACK LIST", case o_orderkey % 4 when 0 then 'True' when 1 then 'no' when 2 then '' else 'maybe' end as "USETILEMASK", o_orderkey as pos from orders"""
SPARK_PARAMS = PARAMS.replace('"', "`")

#: The same normalised, in SQL.
NORM = """n as (select 'CHILE' country, trim("GRID_NAME") grid_name, cast("YEAR" as int) as year, case when lower(trim("SATELLITE")) in ('5', '7', '9') then 'l' || lower(trim("SATELLITE")) else lower(trim("SATELLITE")) end satellite,
 "YEAR" || '-01-01' t0_s, "YEAR" || '-12-31' t1_s, 80 cloud_cover, list_filter(list_transform(string_split(replace(coalesce("BLACK LIST", ''), ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') black_list,
 case lower("USETILEMASK") when 'no' then false else true end use_tile_mask, pos from r where lower(trim("SATELLITE")) <> 'x1')"""


def job(name: str, oracle: str | None, extra: str = ""):
    """A query over PARAMS, whose names need other quotes in Spark."""
    from .registry import Q, SQL, roles

    def add(f):
        Q[name] = lambda spark, sf_dir: f(roles.frame(spark, sf_dir, SPARK_PARAMS))
        if oracle is not None:
            SQL[name] = f"with r as ({PARAMS}), {NORM}{', ' + extra if extra else ''} {oracle}"
        return f

    return add


XW = "x(cim_name, mgrs_tile, frac) as (select 'C' || k, 'T' || (k % 13 + d), case d when 0 then 0.8 when 1 then 0.2 else 0.001 end from generate_series(0, 35) g(k), (values (0), (1), (2)) v(d))"
LIST = "array_to_string(black_list, ',')"


@job("dom_01_normalize_jobs", f"select country, grid_name, year, satellite, t0_s, t1_s, cloud_cover, {LIST} black_list, use_tile_mask from n")
def _(df):
    return P.normalize(df).withColumn("black_list", F.array_join("black_list", ","))


@job("scl_03_skipped_satellites", 'select "YEAR" as year, trim("GRID_NAME") grid_name from r where "SATELLITE" = \'X1\'')
def _(df):
    return P.skipped(df).select(F.col("YEAR").alias("year"), F.trim("GRID_NAME").alias("grid_name"))


@job("agg_39_params_summary", 'select count(*) as rows, count(distinct "GRID_NAME") grids, min(cast("YEAR" as int)) years_min, max(cast("YEAR" as int)) years_max, count("BLACK LIST") black_list_rows from r')
def _(df):
    return P.summary(df)


@job("src_13_last_wins", "select grid_name, year, satellite, pos from (select *, row_number() over (partition by grid_name, year, satellite order by pos desc) k from n) where k = 1")
def _(df):
    norm = P.normalize(df.where("SATELLITE != 'X1'"))
    both = df.where("SATELLITE != 'X1'").select(F.trim("GRID_NAME").alias("grid_name"), F.col("YEAR").cast("int").alias("year"), S.satellite(F.col("SATELLITE")).alias("satellite"), "pos")
    return P.last_wins(both.select(*[c for c in ("grid_name", "year", "satellite") if c in norm.columns], "pos"), ["grid_name", "year", "satellite"], "pos")


@job("agg_37_satellite_for_year", "select year, satellite from (select year, satellite, row_number() over (partition by year order by count(*) desc, satellite) k from n group by year, satellite) where k = 1")
def _(df):
    return P.satellite_for_year(P.normalize(df))


@job("flt_02_year_filter", "select grid_name, year, satellite, pos from n where year in (2001, 2013, 2020)")
def _(df):
    return df.where("SATELLITE != 'X1'").select(F.trim("GRID_NAME").alias("grid_name"), F.col("YEAR").cast("int").alias("year"), S.satellite(F.col("SATELLITE")).alias("satellite"), "pos").where(F.col("year").isin(2001, 2013, 2020))


ALLOWED = "case when year <= 1998 then satellite in ('l4', 'l5') when year <= 2012 then satellite = 'l5' when year <= 2020 then satellite = 'l8' else satellite in ('l8', 'l9') end or (year >= 1984 and year < 2017 and satellite = 'l7')"


@job("flt_03_sensor_guard", f"select grid_name, year, satellite, count(*) n from n where {ALLOWED} group by all")
def _(df):
    return P.guard(P.normalize(df)).groupBy("grid_name", "year", "satellite").agg(F.count("*").alias("n"))


def _xwalk(spark):
    rows = [(f"C{k}", f"T{k % 13 + d}", str({0: 0.8, 1: 0.2, 2: 0.001}[d])) for k in range(36) for d in range(3)]
    return spark.createDataFrame(rows, "cim_name string, mgrs_tile string, overlap_frac_of_cim string")


@job("dom_02_expand_jobs", """select mgrs_tile grid_name, year, satellite, coalesce(string_agg(distinct s, ',' order by s), '') black_list, (select string_agg(distinct b.cim_name, ',' order by b.cim_name) from e b where b.mgrs_tile = e.mgrs_tile and b.year = e.year and b.satellite = e.satellite) cim_name
 from e left join (select * from (select mgrs_tile m, year y, satellite z, unnest(black_list) s from e)) u on u.m = mgrs_tile and u.y = year and u.z = satellite group by mgrs_tile, year, satellite""", XW + ", e as (select n.*, x.cim_name, x.mgrs_tile from n join x on x.cim_name = grid_name and frac >= 0.01)")
def _(df):
    return P.expand(P.normalize(df), _xwalk(df.sparkSession), 0.01).select("grid_name", "year", "satellite", F.array_join("black_list", ",").alias("black_list"), "cim_name")


@job("jon_01_unmatched_grids", "select distinct grid_name from n where grid_name not in (select cim_name from x where frac >= 0.01)", XW)
def _(df):
    return P.unmatched(P.normalize(df), _xwalk(df.sparkSession), 0.01)


@job("agg_38_ordered_blacklist", "select t.mgrs_tile grid_name, ys.year, ys.satellite, coalesce(ls.black_list, '') black_list, false use_tile_mask, 'EPSG:32719' crs from (select distinct mgrs_tile from x) t cross join ys left join ls on ls.mgrs_tile = t.mgrs_tile and ls.year = ys.year and ls.satellite = ys.satellite", XW + """,
 ys as (select year, satellite from (select year, satellite, row_number() over (partition by year order by count(*) desc, satellite) k from n group by year, satellite) where k = 1),
 sc as (select x.mgrs_tile, b.year, b.satellite, b.s, min(row(x.cim_name, b.i)) as place from (select grid_name, year, satellite, unnest(black_list) s, unnest(range(len(black_list))) i from n) b join x on x.cim_name = b.grid_name and frac >= 0.01 group by all),
 ls as (select mgrs_tile, year, satellite, string_agg(s, ',' order by place, s) black_list from sc group by all)""")
def _(df):
    jobs = P.normalize(df)
    tiles = _xwalk(df.sparkSession).select("mgrs_tile").distinct().withColumn("crs", F.lit("EPSG:32719"))
    pairs = _xwalk(df.sparkSession).where("cast(overlap_frac_of_cim as double) >= 0.01").select("mgrs_tile", "cim_name")
    return P.tile_jobs(jobs, tiles, pairs).select("grid_name", "year", "satellite", F.array_join("black_list", ",").alias("black_list"), "use_tile_mask", "crs")


@job("dom_03_tile_plan", "select 'T' || t grid_name, year, satellite, year || '-01-01' t0_s, 'MGRS' grid_type from generate_series(0, 14) g(t), (select year, satellite from (select year, satellite, row_number() over (partition by year order by count(*) desc, satellite) k from n group by year, satellite) where k = 1)")
def _(df):
    tiles = _xwalk(df.sparkSession).select("mgrs_tile").distinct().withColumn("crs", F.lit("EPSG:32719"))
    pairs = _xwalk(df.sparkSession).select("mgrs_tile", "cim_name")
    return P.tile_jobs(P.normalize(df), tiles, pairs).select("grid_name", "year", "satellite", "t0_s", "grid_type")


@job("src_23_exclusions", "select distinct unnest(string_split(array_to_string(black_list, ','), ',')) scene_id from n where len(black_list) > 0")
def _(df):
    return P.exclusions(P.normalize(df).select(F.array_join("black_list", ",").alias("black_list")))


@job("scl_01_parse_bool", """select pos, case lower("USETILEMASK") when 'true' then true when 'no' then false else false end strict, case lower("USETILEMASK") when 'no' then false when '' then false else true end lax from r""")
def _(df):
    c = F.col("USETILEMASK")
    return df.select("pos", S.parse_bool(c, False).alias("strict"), S.parse_bool(c, False, unknown=True).alias("lax"))


DATES = "select o_orderkey as k, cast(o_orderdate as date) as d, o_orderpriority as t, o_orderstatus as s, o_totalprice as p, o_custkey as c from orders"


@query("scl_04_parse_dates", DATES, "select k, case when k % 3 = 2 then date '2000-01-01' else d end as d from r")
def _(df):
    text = F.when(F.col("k") % 3 == 0, F.date_format("d", "dd/MM/yyyy")).when(F.col("k") % 3 == 1, F.date_format("d", "yyyy-MM-dd")).otherwise("x")
    return df.select("k", S.iso_date(text, "2000-01-01").alias("d"))


@query("scl_05_first_alias", DATES, "select k, coalesce(nullif(case when k % 2 = 0 then '' else s end, ''), t) v from r")
def _(df):
    return df.select("k", S.first_of(F.when(F.col("k") % 2 == 0, "").otherwise(F.col("s")), F.col("t")).alias("v"))


@query("scl_06_year_lists", DATES, "select k, array_to_string(list_sort(list_distinct(list_filter([1999 + k % 30, 2013, 1999 + k % 7], lambda y: y between 1999 and 2024))), ',') v from r")
def _(df):
    text = F.concat_ws(",", (F.lit(1999) + F.col("k") % 30).cast("string"), F.lit(" 2013"), F.lit("x"), (F.lit(1999) + F.col("k") % 7).cast("string"))
    return df.select("k", F.array_join(S.year_list(text), ",").alias("v"))


@query("scl_07_clean_values", DATES, "select k, case when k % 4 = 0 then 'none' else t end v, case when k % 3 = 0 then -9999 else cast(trunc(p) as int) end i from r")
def _(df):
    text = F.when(F.col("k") % 4 == 0, " NaN ").otherwise(F.col("t"))
    return df.select("k", S.clean_text(text, "none").alias("v"), S.safe_int(F.when(F.col("k") % 3 == 0, "n/a").otherwise(F.col("p").cast("string"))).alias("i"))


@query("scl_08_mgrs_ids", DATES, "select k, case when k % 5 <> 0 then (10 + k % 50) || 'HCD' end v from r")
def _(df):
    text = F.when(F.col("k") % 5 == 0, "abc").otherwise(F.concat(F.lit(" "), (F.lit(10) + F.col("k") % 50).cast("string"), F.lit("h cd")))
    return df.select("k", S.mgrs_id(text).alias("v"))


@query("scl_09_utm_epsg", DATES, "select k, case when k % 2 = 0 then 32600 else 32700 end + c % 60 v from r")
def _(df):
    return df.select("k", S.utm_epsg(F.col("c") % 60, F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0)).alias("v"))


NAME = "concat('19HCD_mixto_3x3_C00', cast(k % 9 as varchar(20)), '_R01', cast(k % 7 as varchar(20)), '_', cast(1999 + k % 26 as varchar(20)))"


@query("scl_10_raster_names", DATES, "select k, '19HCD' tile, 'mixto' as mode, cast(k % 9 as int) as col, cast(10 + k % 7 as int) as row, cast(1999 + k % 26 as int) as year, cast(1999 + k % 26 as int) as cls from r")
def _(df):
    n = F.expr(NAME)
    return df.select("k", S.raster_name(n).alias("n"), S.class_of_name(n).alias("cls")).select("k", "n.tile", "n.mode", "n.col", "n.row", "n.year", "cls")


@query("scl_12_13_14_names_keys", DATES, "select k, case k % 3 when 0 then 18 when 1 then 19 end zone, 'R' || k || '|' || (1999 + k % 3) as key, '19HCD_mixto_3x3_C' || lpad((k % 9)::varchar, 3, '0') || '_R' || lpad((k % 7)::varchar, 3, '0') rid, '20200101_20201231' slug from r")
def _(df):
    path = F.when(F.col("k") % 3 == 0, "a/utm18/x").when(F.col("k") % 3 == 1, "b/UTM19").otherwise("c")
    return df.select("k", S.utm_of_path(path).alias("zone"), S.key(F.concat(F.lit("R"), F.col("k").cast("string")), F.lit(1999) + F.col("k") % 3).alias("key"),
                     S.rect_id(F.lit("19HCD"), F.lit("mixto"), F.lit("3x3"), F.col("k") % 9, F.col("k") % 7).alias("rid"), S.datetime_slug(F.lit("2020-01-01/2020-12-31")).alias("slug"))


@query("scl_17_18_24_25_year_tables", DATES, """select k, case when y <= 2005 then 'P1' when y <= 2012 then 'P2' when y <= 2018 then 'P3' else 'P4' end period, case k % 5 when 0 then 100.0 when 1 then 85.0 when 2 then 90.0 when 3 then 95.0 else 90.0 end::double target,
 case k % 3 when 0 then 14 when 1 then 32 else 22 end cap, case when k % 2 = 0 then 2 else 6 end mmu, case when y <= 1999 then 'l5' when y <= 2002 then 'l7' when y = 2003 then 'l5' when y <= 2012 then 'l7' when y <= 2022 then 'l8' else 'l9' end sat from (select *, 1999 + k % 26 y from r)""")
def _(df):
    y = F.lit(1999) + F.col("k") % 26
    return df.select("k", S.period_of(y).alias("period"), S.extent_target(F.col("k") % 5).alias("target"), S.modal_cap(F.when(F.col("k") % 3 == 0, 18).when(F.col("k") % 3 == 1, 19)).alias("cap"),
                     T.mmu_pixels(F.when(F.col("k") % 2 == 0, 33).otherwise(59)).alias("mmu"), S.satellite_of_year(y).alias("sat"))


@query("scl_15_16_ecoregions", DATES, "select k, case when k % 4 = 0 then 'E9_own' else n end label, 'ID ' || (k % 70) || ' - ' || t cls, cast(case when k % 4 = 0 then 9 else 1 + k % 3 end as int) as ord from (select *, case k % 3 when 0 then 'E1_Puna_seca_andina' when 1 then 'E2_Desierto_Atacama' else 'E3_Matorral_norte_1' end n from r)")
def _(df):
    label = T.ecoregion_label((F.lit(1) + F.col("k") % 3).cast("int"), F.when(F.col("k") % 4 == 0, "E9_own").otherwise("Bosque"))
    return df.select("k", label.alias("label"), T.class_label(F.col("k") % 70, F.col("t")).alias("cls"), T.ecoregion_order(label).alias("ord"))


@query("scl_19_20_22_labels_scales", DATES, "select k, case when k % 3 = 0 then 33 else 59 end lbl, round(p / 10000 - 1, 8) phys, case when c % 2 > 0 then round(p / (c % 2) * 100, 4) else 0.0 end pct from r")
def _(df):
    return df.select("k", S.label_id(F.when(F.col("k") % 3 == 0, 33).otherwise(-9999), F.lit(59)).alias("lbl"), F.round(S.stored_to_physical(F.col("p")), 8).alias("phys"), F.round(S.safe_pct(F.col("p"), F.col("c") % 2), 4).alias("pct"))


@query("srt_11_12_compact_years", DATES, "select k, array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: 1999 + i * 4 + case when i = 0 then 0 else 0 end), ',') v, 2013 - abs(k % 2) as near from r")
def _(df):
    ys = F.sequence(F.lit(1999), F.lit(2015))
    return df.select("k", F.array_join(S.compact_years(ys, 5), ",").alias("v"), S.nearest_year(2013, F.array((F.lit(2013) - F.col("k") % 2), (F.lit(2013) + F.col("k") % 2 + 1))).alias("near"))


@query("dom_08_char_sum", DATES, "select k, list_sum(list_transform(string_split('R' || k, ''), lambda x: ascii(x)))::int v from r")
def _(df):
    return df.select("k", S.char_sum(F.concat(F.lit("R"), F.col("k").cast("string"))).alias("v"))


# --- boxes ----------------------------------------------------------------------

TILES = "t as (select * from (values ('T0', 0.0, 0.0, 400.0, 500.0), ('T1', 400.0, 0.0, 800.0, 500.0), ('T2', 0.0, 500.0, 1100.0, 1100.0)) v(mgrs_tile, x0, y0, x1, y1))"
CROSS = """c as (select r.grid_id cim_name, t.mgrs_tile, (least(r.x1, t.x1) - greatest(r.x0, t.x0)) * (least(r.y1, t.y1) - greatest(r.y0, t.y0)) o, 875.0 a, (t.x1 - t.x0) * (t.y1 - t.y0) b from r join t on r.x0 < t.x1 and t.x0 < r.x1 and r.y0 < t.y1 and t.y0 < r.y1)"""


def _mgrs(spark):
    return spark.createDataFrame([("T0", 0.0, 0.0, 400.0, 500.0), ("T1", 400.0, 0.0, 800.0, 500.0), ("T2", 0.0, 500.0, 1100.0, 1100.0)], "mgrs_tile string, x0 double, y0 double, x1 double, y1 double")


def _cross(df):
    return G.crosswalk(df.select(F.col("grid_id").alias("cim_name"), "x0", "y0", "x1", "y1"), _mgrs(df.sparkSession), 200.0)


@query("win_01_02_geo_02_crosswalk", RECTS, """select cim_name, mgrs_tile, round(o, 2)::double overlap_m2, round(o / a, 6)::double frac, rk::int mgrs_rank_by_cim_overlap, case when rk > 1 then '' when n = 1 and top >= 0.95 then '1:1' when n = 1 then '1:1_partial' when top >= 0.95 then '1:N' else 'N:N' end cim_mgrs_relation
 from (select *, row_number() over (partition by cim_name order by round(o / a, 6) desc, mgrs_tile) rk, count(*) over (partition by cim_name) n, max(round(o / a, 6)) over (partition by cim_name) top from c)""", TILES + ", " + CROSS)
def _(df):
    return _cross(df).select("cim_name", "mgrs_tile", "overlap_m2", F.col("overlap_frac_of_cim").alias("frac"), "mgrs_rank_by_cim_overlap", "cim_mgrs_relation")


@query("jon_03_tile_grids", RECTS, "select mgrs_tile, string_agg(cim_name, ',' order by cim_name) cims from c group by mgrs_tile", TILES + ", " + CROSS)
def _(df):
    return G.tile_grids(_cross(df)).withColumn("cims", F.array_join("cims", ","))


@query("agg_21_dominant_tile", RECTS, "select cim_name a_id, arg_max(mgrs_tile, o) mgrs_dom, round(max(o) / 875 * 100, 6)::double mgrs_pct, count(*) n_mgrs from c group by cim_name having max(o) / 875 * 100 >= 60", TILES + ", " + CROSS)
def _(df):
    pairs = G.overlaps(df.select(F.col("grid_id").alias("a_id"), "x0", "y0", "x1", "y1"), _mgrs(df.sparkSession).withColumn("b_id", F.substring("mgrs_tile", 2, 1).cast("int")).drop("mgrs_tile"), 200.0)
    return G.dominant_tile(pairs).select("a_id", F.concat(F.lit("T"), F.col("mgrs_dom").cast("string")).alias("mgrs_dom"), F.round("mgrs_pct", 6).alias("mgrs_pct"), "n_mgrs")


PAIR = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
MEET = "a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"


@query("jon_14_self_overlaps", RECTS, f"select count(*) n, round(coalesce(sum({PAIR}), 0), 4)::double area from r a join r b on a.k < b.k and {MEET}")
def _(df):
    box = lambda i: df.select(F.col("k").alias(i), "x0", "y0", "x1", "y1")
    return G.overlaps(box("a_id"), box("b_id"), 100.0).where("a_id < b_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("inter_area"), F.lit(0.0)), 4).alias("area"))


@query("jon_15_cross_zone_overlaps", RECTS, f"select a.grid_id a, b.grid_id b from r a join r b on a.nk % 2 < b.nk % 2 and {MEET}")
def _(df):
    box = lambda i: df.select(F.struct("grid_id", (F.col("nk") % 2).alias("z")).alias(i), "x0", "y0", "x1", "y1")
    return G.overlaps(box("a_id"), box("b_id"), 100.0).where("a_id.z < b_id.z").select(F.col("a_id.grid_id").alias("a"), F.col("b_id.grid_id").alias("b"))


@query("geo_10_previous_overlap", RECTS, f"select grid_id, round(o, 4)::double ovlp_m2 from (select a.grid_id, coalesce((select sum({PAIR}) from r b where b.nk % 3 = 0 and {MEET}), 0) o from r a where a.nk % 3 <> 0) where o <= 1 or o / 875 * 100 <= 30")
def _(df):
    prev = df.where("nk % 3 = 0").select("grid_id", "x0", "y0", "x1", "y1")
    return G.previous_overlap(df.where("nk % 3 != 0"), prev, 100.0, 1.0, 30.0).select("grid_id", F.round("ovlp_m2", 4).alias("ovlp_m2"))


@query("geo_11_greedy_non_overlap", RECTS, "select grid_id from o join (select unnest(kept) i from g where n = (select max(n) from g)) using (i)",
       """o as materialized (select *, row_number() over (order by bal desc, grid_id) i from r), nb as materialized (select a.i, list(b.i) before from o a join o b on b.i < a.i and (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1 and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0) group by a.i),
 g as (select 0::bigint n, []::bigint[] kept union all select g.n + 1, case when list_has_any(g.kept, coalesce(nb.before, []::bigint[])) then g.kept else list_append(g.kept, g.n + 1) end from g left join nb on nb.i = g.n + 1 where g.n < (select count(*) from o))""")
def _(df):
    return G.greedy_non_overlap(df, 100.0, [F.desc("bal"), F.col("grid_id")]).select("grid_id")


@query("geo_01_rectangles", RECTS, """select tile, c::int as col, w::int as row, x0 + c * 15840.0 rx0, y1 - w * 15840.0 - 15840 ry0 from (select grid_id tile, x0 * 100 x0, y0 * 100 y0, x0 * 100 + 100000 x1, y0 * 100 + 100000 y1 from r), generate_series(0, 6) a(c), generate_series(0, 6) b(w)
 where (least(x0 + c * 15840.0 + 15840, x1) - (x0 + c * 15840.0)) * (y1 - w * 15840.0 - greatest(y1 - w * 15840.0 - 15840, y0)) >= 0.99 * 15840.0 * 15840.0""")
def _(df):
    t = df.select(F.col("grid_id").alias("tile"), (F.col("x0") * 100).alias("x0"), (F.col("y0") * 100).alias("y0"), (F.col("x0") * 100 + 100000).alias("x1"), (F.col("y0") * 100 + 100000).alias("y1"))
    return G.rectangles(t, side=2).select("tile", "col", "row", "rx0", "ry0")


@query("geo_04_06_15_box_math", RECTS, "select grid_id, floor(x0 / 30) * 30 as sx, x0 - 100 as bx0, x1 + 100 as bx1, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from r")
def _(df):
    return df.select("grid_id", G.snap(F.col("x0"), 30).cast("double").alias("sx"), (F.col("x0") - 100).alias("bx0"), (F.col("x1") + 100).alias("bx1"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


#: Transverse Mercator on WGS84 for zone 19, southern half (fixed values of the ellipsoid).
_E2, _EP = "0.0066943799901413165::double", "(0.0066943799901413165::double / (1 - 0.0066943799901413165::double))"
PROJECTION = f"""q as (select grid_id, x0 / 1000 - 70 lon, y0 / 100 - 40 lat, radians(y0 / 100 - 40) phi, radians(x0 / 1000 - 70 + 69) dl from r),
 t as (select *, 6378137.0::double / sqrt(1 - {_E2} * sin(phi) * sin(phi)) n, tan(phi) * tan(phi) t, {_EP} * cos(phi) * cos(phi) c, dl * cos(phi) a,
 6378137.0::double * ((1 - {_E2} / 4 - 3 * {_E2} ^ 2 / 64 - 5 * {_E2} ^ 3 / 256) * phi - (3 * {_E2} / 8 + 3 * {_E2} ^ 2 / 32 + 45 * {_E2} ^ 3 / 1024) * sin(2 * phi) + (15 * {_E2} ^ 2 / 256 + 45 * {_E2} ^ 3 / 1024) * sin(4 * phi) - (35 * {_E2} ^ 3 / 3072) * sin(6 * phi)) m from q)"""
_E, _K = "sqrt(0.0066943799901413165::double)", "(cos(radians(30)) / sqrt(1 - 0.0066943799901413165::double * sin(radians(30)) ^ 2))"


@query("geo_05_projections", RECTS, f"""select grid_id, round(0.9996::double * n * (a + (1 - t + c) * a ^ 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_EP}) * a ^ 5 / 120) + 500000, 3) x,
 round(0.9996::double * (m + n * tan(phi) * (a ^ 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ^ 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_EP}) * a ^ 6 / 720)) + case when lat < 0 then 10000000 else 0 end, 3) y, true back,
 round(6378137.0::double * {_K} * radians(lon), 3) ex, round(6378137.0::double * (1 - {_E2}) * (sin(phi) / (1 - {_E2} * sin(phi) ^ 2) - ln((1 - {_E} * sin(phi)) / (1 + {_E} * sin(phi))) / (2 * {_E})) / (2 * {_K}), 3) ey from t""", PROJECTION)
def _(df):
    lon, lat = F.col("x0") / 1000 - 70, F.col("y0") / 100 - 40
    df = df.withColumns(dict(zip(("x", "y"), G.to_utm(lon, lat, F.lit(19)))))
    x, y = F.col("x"), F.col("y")
    lon2, lat2 = G.from_utm(x, y, F.lit(19))
    ex, ey = G.equal_area(lon, lat)
    return df.select("grid_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), ((F.abs(lon2 - lon) < 1e-6) & (F.abs(lat2 - lat) < 1e-6)).alias("back"), F.round(ex, 3).alias("ex"), F.round(ey, 3).alias("ey"))


@query("jon_08_taxonomy", OBS, "select scene, qa, px, case qa when 1 then 'Formacion_boscosa' when 3 then 'Bosque' else 'sin_nombre' end n3_nm, qa in (1, 3) known from r")
def _(df):
    out = T.annotate(df.withColumn("id", F.when(F.col("qa").isin(1, 3), F.col("qa")).otherwise(-5)), "id")
    return out.select("scene", "qa", "px", "n3_nm", (F.col("n1_cd") != "").alias("known"))
