"""Queries over balanced selections and the joins and views of plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as A
from ..operators import select as L
from ..operators import views as W
from .registry import query
from .roles import CANDS
from .samples import EXEMPT, POOLS, PRES, SCORES, STR

#: Candidates whose pure grids have the name that the balancing rules know.
PURE = "b as (select * replace (case when grid_mode = 'puro' then 'homogeneo' else grid_mode end as grid_mode) from sc)"
YEARS_OF = lambda n: f"case when n_stb_P4 >= {n} then n_stb_P4 when n_stb_P3 >= {n} then n_stb_P3 when n_stb_P2 >= {n} then n_stb_P2 when n_stb_P1 >= {n} then n_stb_P1 end"
RARE_TYPE = f"""case when transition_pct >= 5 then case when n_mode_classes >= 2 and lulc_mode_pct < 80 then 'transicion_simple_media' else 'transicion_homogenea' end
 when grid_mode = 'homogeneo' and {YEARS_OF(1)} >= 3 then 'anual_homogenea' when {YEARS_OF(1)} >= 2 then 'anual_simple_media'
 when grid_mode = 'homogeneo' and max_stab_run >= 5 and lulc_mode_pct >= 85 and shannon_idx <= 0.3 then 'estable_homogenea' else 'estable_simple_media' end"""
BUCKET = f"case when transition_pct >= 8 then 'transicion' when {YEARS_OF(2)} is not null then 'anual' else 'estable' end"
OPEN = f"eco_dom_id between 1 and 15 and (lulc_mode_id <> 33 or trim(target_rare_class) <> '') and (not (eco_dom_id in (1, 2, 3) and lulc_mode_id = 25) or {EXEMPT})"


def _pure(df):
    return df.withColumn("grid_mode", F.when(F.col("grid_mode") == "puro", "homogeneo").otherwise(F.col("grid_mode")))


@query("dom_07_rare_metadata", CANDS, f"""select grid_id, t sample_type, split_part(t, '_', 1) dim_temporal, substr(t, instr(t, '_') + 1) dim_espacial, 'Salar' target_rare_class, 61 target_rare_class_id, p rare_presence_pct, 1 review_tier
 from (select *, {RARE_TYPE} t, {STR(61)}) p from b)""", f"{SCORES}, {PURE}")
def _(df):
    return A.rare_metadata(_pure(df), 61, "Salar").select("grid_id", "sample_type", "dim_temporal", "dim_espacial", "target_rare_class", "target_rare_class_id", "rare_presence_pct", "review_tier")


@query("srt_05_rare_pick", CANDS, f"""select grid_id, t sample_type from (select *, {RARE_TYPE} t from (select *, row_number() over (order by late, sc_e_s desc, bonus desc, grid_id) k2 from (select *, row_number() over (partition by eco_dom_id order by sc_e_s desc, bonus desc, grid_id) > 2 late
 from (select *, eco_dom_id in (2, 4) bonus from b where {PRES(61)}))) where k2 <= 50)""", f"{SCORES}, {PURE}")
def _(df):
    return A.pick_rare(L.scores(_pure(df)), 61, "Salar", "sc_e_s", 2, 50).select("grid_id", "sample_type")


RARE = [(61, "Salar", "sc_e_s", 2, 20), (23, "Arena_playa_duna", "sc_e_s", 2, 20), (67, "Bosque_achaparrado", "sc_t_s", 2, 25), (3, "Bosque_norte", "sc_e_h", 2, 15), (33, "Agua", "sc_e_h", 1, 10)]
TYPES = [("estable_homogenea", "p1", "sc_e_h", 4, 250), ("estable_simple_media", "p2", "sc_e_s", 4, 200), ("anual_homogenea", "p3", "sc_a_h", 4, 250),
         ("anual_simple_media", "p4", "sc_a_h", 3, 140), ("transicion_homogenea", "p5", "sc_t_h", 2, 80), ("transicion_simple_media", "p5 and n_mode_classes between 2 and 6 and lulc_mode_pct >= 30 and lulc_mode_pct < 80", "sc_t_s", 3, 120)]


def _exclusive_sql() -> tuple[str, str]:
    """One common table for each turn; a turn sees what those before it left."""
    parts, names = [SCORES, POOLS.replace("from r)", "from sc)")], []
    for k, (cid, name, score, per, most) in enumerate(RARE):
        used = " and ".join(f"grid_id not in (select grid_id from {n})" for n in names) or "true"
        have = f"({PRES(67)} or achaparrado_pct >= 5)" if cid == 67 else "north_forest_pct >= 5" if cid == 3 else PRES(cid)
        order = f"{score} desc, eco_dom_id in (2, 4) desc, grid_id" if cid in (23, 61) else f"north_forest_pct desc, {score} desc, grid_id" if cid == 3 else f"{score} desc, grid_id"
        parts.append(f"x{k} as materialized (select grid_id, '{name}' picked_type from (select *, row_number() over (partition by eco_dom_id order by {order}) > {per} late from p where {have} and {used}) order by late, {order} limit {most})")
        names.append(f"x{k}")
    for k, (name, pool, score, per, most) in enumerate(TYPES, len(RARE)):
        used = " and ".join(f"grid_id not in (select grid_id from {n})" for n in names)
        parts.append(f"x{k} as materialized (select grid_id, '{name}' picked_type from (select *, row_number() over (partition by mgrs_dom order by {score} desc, grid_id) rr from (select *, row_number() over (partition by eco_dom_id order by {score} desc, grid_id) ee from p where ({pool}) and {used}) where ee <= {per}) order by rr, {score} desc, grid_id limit {most})")
        names.append(f"x{k}")
    return " union all ".join(f"select * from {n}" for n in names), ", ".join(parts)


_PICKED, _TURNS = _exclusive_sql()


@query("dom_06_pick_exclusive", CANDS, _PICKED, _TURNS)
def _(df):
    types = [(name, f"p_{name}", score, per, most) for name, _, score, per, most in TYPES]
    return A.pick_exclusive(L.scores(L.pools(df)), RARE, types).select("grid_id", "picked_type")


@query("dom_11_fill_quotas", CANDS,
       """select grid_id, kind || '_simple_media' sample_type from (select q.grid_id, q.kind, q.k3, coalesce(s.before, 0) before from q join s using (eco_dom_id) where q.k3 <= 6 - q.have) where k3 + before <= 45""",
       f"""{SCORES}, {PURE}, sel as (select * from b where k % 40 = 0), h as (select eco_dom_id, count(*) have, list(distinct dim_temporal) kinds, list(distinct lulc_mode_id) modes, list(distinct trim(mgrs_dom)) tiles from sel group by eco_dom_id),
 q as (select *, row_number() over (partition by eco_dom_id order by prio desc, fresh desc, (grid_mode = 'mixto') desc, sc_e_h desc, grid_id) k3 from (select b.grid_id, b.eco_dom_id, b.grid_mode, b.sc_e_h, coalesce(have, 0) have, {BUCKET} kind, 2 * (not coalesce(list_contains(kinds, {BUCKET}), false))::int + (not coalesce(list_contains(modes, lulc_mode_id), false))::int - (lulc_mode_id = 25)::int prio, (not coalesce(list_contains(tiles, trim(mgrs_dom)), false))::int fresh from b left join h using (eco_dom_id) where k % 40 <> 0 and {OPEN})),
 s as (select eco_dom_id, sum(n) over (order by late, have, eco_dom_id rows between unbounded preceding and 1 preceding) before from (select eco_dom_id, count(*) n, min(have) have, (eco_dom_id not in (3, 6))::int late from q where k3 <= 6 - have group by eco_dom_id))""")
def _(df):
    sc = L.scores(_pure(df))
    return A.fill_quotas(sc.where("k % 40 = 0"), sc, 6, (3, 6), 45).select("grid_id", "sample_type")


@query("dom_11_fill_to_target", CANDS, f"""select grid_id, case when kind = 'transicion' then 'transicion_simple_media' when kind = 'anual' then case when grid_mode = 'mixto' then 'anual_simple_media' else 'anual_homogenea' end when grid_mode = 'homogeneo' then 'estable_homogenea' else 'estable_simple_media' end sample_type
 from (select *, row_number() over (order by rr, sc_e_s desc, grid_id) k3 from (select *, {BUCKET} kind, row_number() over (partition by mgrs_dom order by sc_e_s desc, grid_id) rr from b where k % 40 <> 0 and {OPEN})) where k3 <= 120 - (select count(*) from b where k % 40 = 0)""", f"{SCORES}, {PURE}")
def _(df):
    sc = L.scores(_pure(df))
    return A.fill_to_target(sc.where("k % 40 = 0"), sc, 120).select("grid_id", "sample_type")


SURE = "sample_type = 'anual_homogenea' and max_stab_run >= 5 and lulc_mode_pct >= 85 and transition_pct <= 10 and stable_yr_pct >= 60"
PROMOTED = "case when grid_mode = 'homogeneo' and max_stab_run >= 5 and lulc_mode_pct >= 85 and transition_pct <= 10 and shannon_idx <= 0.3 then 'estable_homogenea' when max_stab_run >= 3 and lulc_mode_pct >= 45 and lulc_mode_pct < 85 and n_mode_classes between 2 and 6 and transition_pct <= 15 then 'estable_simple_media' end"
REF = f"""{SCORES}, {PURE}, f as (select * replace (case when {SURE} then 'estable_homogenea' else sample_type end as sample_type), case when k % 7 = 0 then []::int[] else list_sort(list_distinct([(1999 + k % 26)::int, (1999 + k % 5)::int])) end ys from b),
 a as materialized (select utm, grid_id, ys, list_sum(list_transform(string_split(grid_id, ''), lambda c: ascii(c)))::bigint sm, row_number() over (partition by utm order by grid_id) i from f where sample_type like 'anual%'),
 g as (select distinct utm, 0::bigint i, []::int[] used, ''::varchar grid_id, 0::int y from a union all
  select utm, i, case when y > 0 then list_append(used, y) else used end, grid_id, y from (select a.utm, a.i, g.used, a.grid_id, (case when len(a.ys) = 0 then -9999 when len(g.used) = 0 then list_max(a.ys) else
   list_sort(list_filter(a.ys, lambda y: len(list_filter(g.used, lambda u: u = y)) = list_min(list_transform(a.ys, lambda z: len(list_filter(g.used, lambda u: u = z))))))[1 + (a.sm % len(list_filter(a.ys, lambda y: len(list_filter(g.used, lambda u: u = y)) = list_min(list_transform(a.ys, lambda z: len(list_filter(g.used, lambda u: u = z)))))))] end)::int y from g join a on a.utm = g.utm and a.i = g.i + 1)),
 o as (select f.* exclude (ref_year), coalesce(g.y, -9999)::int ref_year, case when sample_type like 'anual%' and coalesce(g.y, -9999) <= 0 then {PROMOTED} end pr from f left join (select * from g where i > 0) g on g.utm = f.utm and g.grid_id = f.grid_id)"""
PERIOD = "case when ref_year between 1999 and 2005 then 'P1' when ref_year between 2006 and 2012 then 'P2' when ref_year between 2013 and 2018 then 'P3' when ref_year between 2019 and 2024 then 'P4' else '' end"


@query("dom_12_final_labels", CANDS, f"""select grid_id, coalesce(pr, sample_type) sample_type, split_part(coalesce(pr, sample_type), '_', 1) dim_temporal, ref_year, {PERIOD} ref_period, case {PERIOD} when 'P1' then 'Landsat_5_7' when 'P2' then 'Landsat_5_7' when 'P3' then 'Landsat_8' when 'P4' then 'Landsat_8_9' else '' end ref_sensor
 from o where not (sample_type like 'anual%' and ref_year <= 0 and pr is null)""", REF)
def _(df):
    some = _pure(df).drop("ref_year")
    years = F.when(F.col("k") % 7 == 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.array((1999 + F.col("k") % 26).cast("int"), (1999 + F.col("k") % 5).cast("int")))))
    return A.final_labels(some.withColumn("years", years)).select("grid_id", "sample_type", "dim_temporal", "ref_year", "ref_period", "ref_sensor")


@query("dom_08_reference_years", CANDS, "select grid_id, ref_year from o", REF)
def _(df):
    some = _pure(df).drop("ref_year")
    years = F.when(F.col("k") % 7 == 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.array((1999 + F.col("k") % 26).cast("int"), (1999 + F.col("k") % 5).cast("int")))))
    sure = (F.col("sample_type") == "anual_homogenea") & F.expr("max_stab_run >= 5 and lulc_mode_pct >= 85 and transition_pct <= 10 and stable_yr_pct >= 60")
    some = some.withColumn("dim_temporal", F.when(sure, "estable").otherwise(F.substring_index("sample_type", "_", 1)))
    return A.reference_years(some.withColumn("years", years)).select("grid_id", "ref_year")


# --- joins, filters, projections -------------------------------------------------


@query("jon_04_plan_with_selection", CANDS, "select a.grid_id, a.eco_dom_id eco_dom_id_plan, b.eco_dom_id + 1 eco_dom_id_sel, a.k from (select * from r where k % 2 = 0) a join (select * from r where k % 3 = 0) b using (grid_id)")
def _(df):
    return A.plan_with_selection(df.where("k % 2 = 0").select("grid_id", "eco_dom_id", "k"), df.where("k % 3 = 0").select("grid_id", (F.col("eco_dom_id") + 1).alias("eco_dom_id")))


@query("jon_09_with_zone", CANDS, "select grid_id, utm utm_zone from r where k % 2 = 0")
def _(df):
    zones = df.select("grid_id", F.col("utm").alias("utm_zone"))
    return A.with_zone(df.where("k % 2 = 0").select("grid_id"), zones)


@query("jon_10_with_geometry", CANDS, "select grid_id, eco_dom_id from r where k % 4 = 1")
def _(df):
    return A.with_geometry(df.select("grid_id", "eco_dom_id"), df.where("k % 4 = 1"))


@query("srt_06_review_queue", CANDS, "select grid_id, row_number() over (order by review_priority, review_tier, dim_espacial <> 'homogenea', grid_id)::int place from (select *, k % 3 review_priority from r)")
def _(df):
    return A.review_queue(df.withColumn("review_priority", F.col("k") % 3)).select("grid_id", "place")


@query("flt_01_metadata", CANDS, "select grid_id from r where utm = 'UTM18' and target_rare_class is not null and eco_dom_id in (3, 5, 7) and contains(eco_dom_name, '_x')")
def _(df):
    return W.matching(df, {"utm": "UTM18"}, ["target_rare_class"], {"eco_dom_id": [3, 5, 7]}, {"eco_dom_name": "_x"}).select("grid_id")


@query("flt_15_17_subset", CANDS, "select grid_id from r where sample_type in ('anual_homogenea', 'estable_homogenea') and grid_id in (select grid_id from r where sample_type in ('anual_homogenea', 'estable_homogenea') order by grid_id limit 100) order by grid_id limit 80")
def _(df):
    some = W.subset(df, {"sample_type": ["anual_homogenea", "estable_homogenea"]}, most_ids=100)
    return W.limited(some, W.switches({"MAX_ROWS": "80"})["max_rows"], "grid_id").select("grid_id")


@query("flt_16_zone_view", CANDS, "select grid_id, 'column' how from r where utm = 'UTM19' union all select grid_id, 'file' from r")
def _(df):
    own = W.zone_view(df.withColumn("utm_zone", F.substring("utm", 4, 2)), "UTM19").select("grid_id", F.lit("column").alias("how"))
    return own.unionByName(W.zone_view(df, "UTM18", "out/plan_utm18.csv").select("grid_id", F.lit("file").alias("how"))).unionByName(W.zone_view(df, "UTM18", "plan.csv").select("grid_id", F.lit("none").alias("how")))


@query("prj_18_map_columns", CANDS, "select grid_id, sample_type, grid_mode, split, '' clases_criticas, '' parent_grid_id, 'UTM' || substr(utm, 4, 2) utm_name from r")
def _(df):
    out = W.map_columns(df.withColumn("utm_zone", F.substring(F.col("utm"), 4, 2)).drop("utm"))
    return out.select("grid_id", "sample_type", "grid_mode", "split", "clases_criticas", "parent_grid_id", F.col("utm").alias("utm_name"))


@query("set_02_stacked", CANDS, "select grid_id, eco_dom_id, null::int review_tier from r where k % 2 = 0 union all select grid_id, null, review_tier from r where k % 2 = 1")
def _(df):
    return W.stacked(df.where("k % 2 = 0").select("grid_id", "eco_dom_id"), df.where("k % 2 = 1").select("grid_id", "review_tier"))


@query("set_04_allowed_tiles", CANDS, "select distinct mgrs_dom mgrs_tile from r where mgrs_dom in ('T1', 'T4', 'T6')")
def _(df):
    masks = df.sparkSession.createDataFrame([("T1",), ("T4",), ("T6",), ("T99",)], "mgrs_tile string")
    return W.allowed_tiles(df.select(F.col("mgrs_dom").alias("mgrs_tile")).distinct(), masks)


@query("scl_28_period_columns", CANDS, "select grid_id, md_id_P1 p1, md_id_P4 p4 from r")
def _(df):
    modes = W.period_columns(df, "md_id")
    return df.select("grid_id", modes["P1"].alias("p1"), modes["P4"].alias("p4"))


SUMMARY = "s as (select coalesce(utm, 'TOTAL') utm, count(*) n_muestras, count(distinct eco_dom_id) n_ecorregiones, nullif(count(*) filter (where target_rare_class = 'none'), 0) n_clases_criticas, count(*) filter (where achaparrado_pct >= 5) n_achaparrado from r group by rollup (utm))"


@query("agg_50_kpi_row", CANDS, "select 'UTM19' asked, utm, n_muestras, n_ecorregiones, coalesce(n_clases_criticas, n_achaparrado) n_criticas from s where utm = 'UTM19' union all select 'UTM17', utm, n_muestras, n_ecorregiones, coalesce(n_clases_criticas, n_achaparrado) from s where utm = 'TOTAL'", SUMMARY)
def _(df):
    s = df.rollup("utm").agg(F.count("*").alias("n_muestras"), F.count_distinct("eco_dom_id").alias("n_ecorregiones"), F.expr("nullif(count_if(target_rare_class = 'none'), 0)").alias("n_clases_criticas"), F.count_if(F.col("achaparrado_pct") >= 5).alias("n_achaparrado"))
    s = s.withColumn("utm", F.coalesce("utm", F.lit("TOTAL")))
    rows = [W.kpi_row(s, utm).select(F.lit(utm).alias("asked"), "utm", "n_muestras", "n_ecorregiones", "n_criticas") for utm in ("UTM19", "UTM17")]
    return rows[0].unionByName(rows[1])


@query("dom_32_eco_pivot", CANDS, """select case when eco_dom_id = 0 then 'E0_x' else eco_dom_name end eco_dom_name, count(*) filter (where dim_temporal = 'anual') anual, count(*) filter (where dim_temporal = 'estable') estable, count(*) filter (where dim_temporal = 'transicion') transicion, count(*) "TOTAL" from r group by 1""")
def _(df):
    return W.eco_pivot(df, "dim_temporal", ["anual", "estable", "transicion"])
