"""Queries over class series and candidate rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characterize as C
from ..operators import select as L
from .registry import query
from .roles import CANDS, LULC, SERIES

MODE = "m as (select rect, px, mode_id, eco_id, lat from (select rect, px, class_id mode_id, min(eco_id) over (partition by rect, px) eco_id, min(lat) over (partition by rect, px) lat, row_number() over (partition by rect, px order by count(*) desc, class_id) k from r group by rect, px, class_id, eco_id, lat) where k = 1)"
MODE = "mc as (select rect, px, class_id, count(*) n from r group by rect, px, class_id), m as (select rect, px, class_id mode_id from (select *, row_number() over (partition by rect, px order by n desc, class_id) k from mc) where k = 1), pe as (select rect, px, min(eco_id) eco_id, min(lat) lat from r group by rect, px)"
STAB = MODE + ", st as (select r.rect, r.year, avg((r.class_id = m.mode_id)::int) frac from r join m using (rect, px) group by r.rect, r.year)"


@query("agg_13_temporal_mode", LULC, "select rect, px, mode_id from m", MODE)
def _(df):
    return C.pixel_modes(df, ["rect", "px"]).select("rect", "px", "mode_id")


@query("agg_14_dominant_class", LULC, "select rect, arg_max(mode_id, row(n, -mode_id)) mode_id_dom, round(max(n) * 100.0::double / sum(n), 6) mode_id_pct, count(*) mode_id_n from (select rect, mode_id, count(*) n from m group by rect, mode_id) group by rect", MODE)
def _(df):
    n = C.pixel_modes(df, ["rect", "px"]).groupBy("rect", "mode_id").agg(F.count("*").alias("n"))
    return C.dominant(n, ["rect"], "mode_id").withColumn("mode_id_pct", F.round("mode_id_pct", 6))


@query("agg_15_shannon", LULC, "select rect, round(-sum(p * ln(p)), 8) shannon from (select rect, n::double / sum(n) over (partition by rect) p from (select rect, mode_id, count(*) n from m group by rect, mode_id)) group by rect", MODE)
def _(df):
    n = C.pixel_modes(df, ["rect", "px"]).groupBy("rect", "mode_id").agg(F.count("*").alias("n"))
    return C.shannon(n, ["rect"]).withColumn("shannon", F.round("shannon", 8))


@query("agg_16_win_07_transition_pct", LULC, "select rect, round(avg(t) * 100, 6) tr_pct from (select rect, px, avg((class_id <> p)::int) t from (select *, lag(class_id) over (partition by rect, px order by year) p from r) where p is not null group by rect, px) group by rect")
def _(df):
    return C.transition_pct(df).withColumn("tr_pct", F.round("tr_pct", 6))


@query("agg_17_stable_years", LULC, "select rect, coalesce(string_agg(year::varchar, ',' order by year) filter (where frac >= 0.3), '') stable_years, count(*) filter (where frac >= 0.3) n_stable, round(count(*) filter (where frac >= 0.3)::double / count(*) * 100, 6) stab_yr_pct, round(avg(frac) * 100, 6) stab_pct from st group by rect", STAB)
def _(df):
    out = C.stable_years(C.year_stability(df), share=0.3)
    return out.withColumns({c: F.round(c, 6) for c in ("stab_yr_pct", "stab_pct")})


@query("win_08_longest_run", SERIES, """select rect, coalesce(run, 0)::int run, coalesce(a, -9999)::int run_start, coalesce(b, -9999)::int run_end from (select distinct rect from r) d left join (select rect, count(*) run, min(year) a, max(year) b, row_number() over (partition by rect order by count(*) desc, min(year)) k
 from (select rect, year, year - row_number() over (partition by rect order by year) g from (select rect, year from r group by rect, year having avg(value) > 50)) group by rect, g) i using (rect) where coalesce(k, 1) = 1""")
def _(df):
    flags = df.groupBy("rect", "year").agg((F.avg("value") > 50).alias("stable"))
    return C.longest_run(flags)


_P = "case when year <= 2005 then 'P1' when year <= 2012 then 'P2' when year <= 2018 then 'P3' else 'P4' end"
PERIODS = f"""pm as materialized (select rect, px, period, class_id mode_id from (select *, row_number() over (partition by rect, px, period order by n desc, class_id) j from (select rect, px, {_P} period, class_id, count(*) n from r group by all)) where j = 1),
 pd as (select rect, period, mode_id, n * 100.0::double / t pct from (select *, sum(n) over (partition by rect, period) t, row_number() over (partition by rect, period order by n desc, mode_id) k from (select rect, period, mode_id, count(*) n from pm group by all)) where k = 1),
 py as (select r.rect, {_P} period, r.year, avg((r.class_id = pm.mode_id)::int) frac from r join pm on pm.rect = r.rect and pm.px = r.px and pm.period = {_P} group by all),
 ps as (select rect, period, count(*) filter (where frac >= 0.75) n_stb, coalesce(string_agg(year::varchar, ',' order by year) filter (where frac >= 0.75), '') yrs from py group by all), pp as (select * from pd join ps using (rect, period))"""
PERIOD_COLUMNS = ", ".join(f"max(mode_id) filter (where period = '{p}') {p}_md_id, round(max(pct) filter (where period = '{p}'), 6) {p}_md_pct, max(n_stb) filter (where period = '{p}') {p}_n_stb, round(max(n_stb) filter (where period = '{p}') / {n}.0::double * 100, 6) {p}_stb_p, max(yrs) filter (where period = '{p}') {p}_stb_yrs" for p, n in (("P1", 7), ("P2", 7), ("P3", 6), ("P4", 6)))


@query("agg_18_period_stats", LULC, f"select rect, {PERIOD_COLUMNS} from pp group by rect", PERIODS)
def _(df):
    out = C.period_stats(df)
    return out.select("rect", *(F.round(c, 6).alias(c) if c.endswith(("_md_pct", "_stb_p")) else F.col(c) for c in out.columns if c != "rect"))


@query("agg_19_share_metrics", LULC, """select rect, round(avg((mode_id in (67, 23, 61, 33))::int) * 100, 6) crit_pct, round(avg((mode_id = 3 and lat >= -33.2)::int) * 100, 6) nfor_pct, round(avg((mode_id = 67)::int) * 100, 6) achap_pct,
 round(avg((mode_id in (11, 73, 74, 18, 19, 36, 9, 79, 80, 24, 30, 75, 34))::int) * 100, 6) tran_pct, round(avg((mode_id = 27)::int) * 100, 6) noobs_raw_pct from m join pe using (rect, px) group by rect""", MODE)
def _(df):
    out = C.share_metrics(C.pixel_modes(df, ["rect", "px"]))
    return out.select("rect", *(F.round(c, 6).alias(c) for c in out.columns if c != "rect"))


@query("agg_20_confusion_risk", LULC, "select rect, round(sum(case when (d = 59 and mode_id in (60, 67)) or (d = 66 and mode_id in (12, 63)) or (d = 12 and mode_id in (66, 63)) or (d = 25 and mode_id in (29, 23)) then n else 0 end) * 100.0::double / sum(n), 6) conf_risk_pct from (select *, arg_max(mode_id, row(n, -mode_id)) over (partition by rect) d from (select rect, mode_id, count(*) n from m group by rect, mode_id)) group by rect", MODE)
def _(df):
    n = C.pixel_modes(df, ["rect", "px"]).groupBy("rect", "mode_id").agg(F.count("*").alias("n"))
    return C.confusion_risk(n, C.dominant(n, ["rect"], "mode_id")).withColumn("conf_risk_pct", F.round("conf_risk_pct", 6))


_CONFUSED = "(59, 60), (59, 67), (60, 59), (60, 66), (66, 12), (66, 63), (12, 66), (12, 63), (63, 66), (63, 12), (25, 29), (25, 23), (29, 25), (15, 12), (15, 18), (18, 15)"
CHARACTER = MODE + """, md as materialized (select * from m join pe using (rect, px)), gate as materialized (select rect, count(*) filter (where eco_id > 0 and mode_id <> 27) * 100.0::double / count(*) val_pct from md group by rect having val_pct >= 20),
 va as materialized (select md.* from md join gate using (rect) where eco_id > 0 and mode_id <> 27), se as materialized (select r.* from r join (select rect, px from va) using (rect, px)), mn as (select rect, mode_id, count(*) n from va group by all),
 c1 as (select rect, arg_max(mode_id, row(n, -mode_id)) mode_id_dom, max(n) * 100.0::double / sum(n) mode_id_pct, count(*) mode_id_n from mn group by rect), c2 as (select rect, arg_max(eco_id, row(n, -eco_id)) eco_id_dom, max(n) * 100.0::double / sum(n) eco_id_pct from (select rect, eco_id, count(*) n from va group by all) group by rect),
 c3 as (select rect, arg_max(class_id, row(n, -class_id)) last_id_dom, max(n) * 100.0::double / sum(n) last_id_pct from (select rect, class_id, count(*) n from se where year = (select max(year) from se) group by all) group by rect),
 c4 as (select rect, -sum(p * ln(p)) shannon from (select rect, n::double / sum(n) over (partition by rect) p from mn) group by rect), c5 as (select rect, avg(t) * 100 tr_pct from (select rect, px, avg((class_id <> p)::int) t from (select *, lag(class_id) over (partition by rect, px order by year) p from se) where p is not null group by rect, px) group by rect),
 fr as materialized (select se.rect, se.year, avg((se.class_id = va.mode_id)::int) frac from se join va using (rect, px) group by all),
 c6 as (select rect, coalesce(string_agg(year::varchar, ',' order by year) filter (where frac >= 0.75), '') stable_years, count(*) filter (where frac >= 0.75) n_stable, count(*) filter (where frac >= 0.75)::double / count(*) * 100 stab_yr_pct, avg(frac) * 100 stab_pct from fr group by rect),
 c7 as (select rect, coalesce(run, 0)::int run, coalesce(run_start, -9999)::int run_start, coalesce(run_end, -9999)::int run_end from (select distinct rect from fr) left join (select rect, count(*) run, min(year) run_start, max(year) run_end, row_number() over (partition by rect order by count(*) desc, min(year)) k from (select rect, year, year - row_number() over (partition by rect order by year) g from fr where frac >= 0.75) group by rect, g) using (rect) where coalesce(k, 1) = 1),
 c8 as (select rect, avg((mode_id in (67, 23, 61, 33))::int) * 100 crit_pct, avg((mode_id = 3 and lat >= -33.2)::int) * 100 nfor_pct, avg((mode_id = 67)::int) * 100 achap_pct, avg((mode_id in (11, 73, 74, 18, 19, 36, 9, 79, 80, 24, 30, 75, 34))::int) * 100 tran_pct, avg((mode_id = 27)::int) * 100 noobs_raw_pct from va group by rect),
 c9 as (select mn.rect, sum(case when (mode_id_dom, mode_id) in (""" + _CONFUSED + """) then n else 0 end) * 100.0::double / sum(n) conf_risk_pct from mn join c1 using (rect) group by mn.rect), """ + PERIODS.replace("from r ", "from se r ") + f""", c10 as (select rect, {PERIOD_COLUMNS} from pp group by rect),
 ch as (select * from gate join c1 using (rect) join c2 using (rect) join c3 using (rect) join c4 using (rect) join c5 using (rect) join c6 using (rect) join c7 using (rect) join c8 using (rect) join c9 using (rect) join c10 using (rect)),
 kd as (select *, case when tr_pct >= 15 then 'transicion' when (run < 5 and (P3_n_stb >= 3 or P4_n_stb >= 3)) or tran_pct > 0 then 'anual' else 'estable' end dim_temporal, case when mode_id_pct >= 85 and shannon <= 0.3 then 'homogenea' when mode_id_n <= 4 and mode_id_pct >= 45 then 'simple_media' else 'compleja' end dim_espacial,
 val_pct / 100 * 2 + crit_pct / 100 * 4 + nfor_pct / 100 * 3 + achap_pct / 100 * 3 + least(mode_id_n, 19) / 19.0::double * 2 + shannon / ln(19) * 1.5 + tr_pct / 100 * 1.5 prio_sc from ch)"""
CHARACTER_ROUND = ["val_pct", "mode_id_pct", "eco_id_pct", "last_id_pct", "shannon", "tr_pct", "stab_yr_pct", "stab_pct", "crit_pct", "nfor_pct", "achap_pct", "tran_pct", "noobs_raw_pct", "conf_risk_pct", "prio_sc"]


@query("dom_04_characterize", LULC, f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in CHARACTER_ROUND)}), 0.0::double noobs_pct, dim_temporal || '_' || dim_espacial sample_type from kd", CHARACTER)
def _(df):
    out = C.characterize(df)
    more = [c for c in out.columns if c.endswith(("_md_pct", "_stb_p"))]
    return out.withColumns({c: F.round(c, 6) for c in [*CHARACTER_ROUND, *more]})


@query("agg_22_priority_score", CANDS, "select grid_id, round(valid_area_pct / 100 * 2 + critical_pct / 100 * 4 + north_forest_pct / 100 * 3 + achaparrado_pct / 100 * 3 + least(n_mode_classes, 19) / 19.0::double * 2 + shannon_idx / ln(19) * 1.5 + transition_pct / 100 * 1.5 - noobs_pct * 0.05, 8) prio_sc from r")
def _(df):
    c = F.col
    return df.select("grid_id", F.round(C.priority_score(c("valid_area_pct"), c("critical_pct"), c("north_forest_pct"), c("achaparrado_pct"), c("n_mode_classes"), c("shannon_idx"), c("transition_pct"), c("noobs_pct")), 8).alias("prio_sc"))


@query("dom_04_kinds", CANDS, "select grid_id, case when transition_pct >= 15 then 'transicion' when (max_stab_run < 5 and (n_stb_P3 >= 3 or n_stb_P4 >= 3)) or rare_presence_pct > 20 then 'anual' else 'estable' end t, case when lulc_mode_pct >= 85 and shannon_idx <= 0.3 then 'homogenea' when n_mode_classes <= 4 and lulc_mode_pct >= 45 then 'simple_media' else 'compleja' end s from r")
def _(df):
    c = F.col
    return df.select("grid_id", C.temporal_kind(c("transition_pct"), c("max_stab_run"), c("n_stb_P3"), c("n_stb_P4"), c("rare_presence_pct") - 20).alias("t"), C.spatial_kind(c("lulc_mode_pct"), c("shannon_idx"), c("n_mode_classes")).alias("s"))


# --- selection ------------------------------------------------------------------


@query("flt_04_quality", CANDS, "select grid_id from r where valid_area_pct >= 40 and eco_dom_pct >= 50 and noobs_pct <= 10")
def _(df):
    return L.quality(df).select("grid_id")


@query("flt_05_12_ecoregions", CANDS, "select grid_id from r where eco_dom_name not in ('sin_nombre', '', 'nan') and eco_dom_id > 0 and eco_dom_id between 1 and 15")
def _(df):
    return L.valid_ecoregion(df).where(F.col("eco_dom_id").between(1, 15)).select("grid_id")


POOLS = """p as (select *, max_stab_run >= 5 and transition_pct <= 10 and stable_yr_pct >= 60 and lulc_mode_pct >= 85 and shannon_idx <= 0.3 p1, max_stab_run >= 3 and transition_pct <= 15 and lulc_mode_pct >= 45 and lulc_mode_pct < 85 and n_mode_classes between 2 and 6 p2,
 greatest(n_stb_P1, n_stb_P2, n_stb_P3, n_stb_P4) >= 3 and greatest(case when n_stb_P1 >= 3 then md_pct_P1 else 0 end, case when n_stb_P2 >= 3 then md_pct_P2 else 0 end, case when n_stb_P3 >= 3 then md_pct_P3 else 0 end, case when n_stb_P4 >= 3 then md_pct_P4 else 0 end) >= 85 p3,
 greatest(n_stb_P1, n_stb_P2, n_stb_P3, n_stb_P4) >= 2 and lulc_mode_pct >= 45 and lulc_mode_pct < 85 and n_mode_classes between 2 and 6 p4,
 (transition_pct >= 5 and greatest(lulc_mode_pct, lulc_last_pct) >= 70) or (eco_dom_id in (1, 2, 3, 4, 5) and (transition_pct >= 3 or (lulc_mode_id <> lulc_last_id and transition_pct >= 3))) p5 from r)"""


@query("flt_06_07_pools", CANDS, "select grid_id, p1 as p_estable_homogenea, p2 as p_estable_simple_media, p3 as p_anual_homogenea, p4 as p_anual_simple_media, p5 as p_transicion_homogenea, p5 and n_mode_classes between 2 and 6 and lulc_mode_pct >= 30 and lulc_mode_pct < 80 as p_transicion_simple_media from p", POOLS)
def _(df):
    return L.pools(df).select("grid_id", *(f"p_{k}" for k in ("estable_homogenea", "estable_simple_media", "anual_homogenea", "anual_simple_media", "transicion_homogenea", "transicion_simple_media")))


EXEMPT = "(trim(target_rare_class) <> '' or eco_dom_id in (7, 8, 9, 12, 15) or lulc_mode_id in (23, 61, 3) or north_forest_pct >= 5)"


@query("flt_08_block_desert", CANDS, f"select grid_id from r where not (eco_dom_id in (1, 2, 3) and lulc_mode_id = 25) or {EXEMPT}")
def _(df):
    return L.block_desert(df).select("grid_id")


@query("flt_09_block_water", CANDS, "select grid_id from r where lulc_mode_id <> 33 or trim(target_rare_class) <> ''")
def _(df):
    return L.block_water(df).select("grid_id")


@query("flt_10_transversal_modal", CANDS, "select grid_id, m in (11, 73, 74, 18, 19, 36, 9, 79, 80, 24, 30, 75, 34, 14) or (m in (10, 22) and transition_pct >= 25) v from (select *, case k % 4 when 0 then 11 when 1 then 10 when 2 then 14 else 59 end m from r)")
def _(df):
    from ..functions import taxonomy as T

    m = F.when(F.col("k") % 4 == 0, 11).when(F.col("k") % 4 == 1, 10).when(F.col("k") % 4 == 2, 14).otherwise(59)
    return df.select("grid_id", T.transversal_modal(m, F.col("transition_pct")).alias("v"))


PRES = lambda c: f"(lulc_mode_id = {c} or lulc_last_id = {c} or (md_id_P1 = {c} and md_pct_P1 >= 25) or (md_id_P2 = {c} and md_pct_P2 >= 25) or (md_id_P3 = {c} and md_pct_P3 >= 25) or (md_id_P4 = {c} and md_pct_P4 >= 25))"


@query("flt_11_class_presence", CANDS, f"select grid_id, {PRES(23)} c23, {PRES(61)} c61, {PRES(33)} c33, {PRES(67)} or achaparrado_pct >= 5 c67, north_forest_pct >= 5 c3 from r")
def _(df):
    return df.select("grid_id", *(L.class_present(c).alias(f"c{c}") for c in (23, 61, 33, 67, 3)))


STR = lambda c: "greatest(" + ", ".join(f"case when {i} = {c} then {p} else 0 end" for i, p in (("lulc_mode_id", "lulc_mode_pct"), ("lulc_last_id", "lulc_last_pct"), *((f"md_id_P{k}", f"md_pct_P{k}") for k in (1, 2, 3, 4))))


@query("dom_09_presence_strength", CANDS, f"select grid_id, {STR(23)}) s23, {STR(67)}, achaparrado_pct) s67, north_forest_pct s3, round({STR(61)}) / 100 * 5 + critical_pct / 100 * 2 + valid_area_pct / 100 * 2 + eco_dom_pct / 100 + case when eco_dom_id in (2, 4) then 1.5 else 0 end, 8) rare61 from r")
def _(df):
    return df.select("grid_id", L.presence_strength(23).alias("s23"), L.presence_strength(67).alias("s67"), L.presence_strength(3).alias("s3"), F.round(L.rare_score(61), 8).alias("rare61"))


@query("dom_18_critical_names", CANDS, f"select grid_id, concat_ws('; ', case when {PRES(23)} then 'Arena' end, case when {PRES(61)} then 'Salar' end) names, ({PRES(23)})::int + ({PRES(61)})::int n from r")
def _(df):
    have = F.array_compact(F.array(F.when(L.class_present(23), "Arena"), F.when(L.class_present(61), "Salar")))
    return df.select("grid_id", F.array_join(have, "; ").alias("names"), F.size(have).alias("n"))


BASE = "valid_area_pct / 100 * 2 + eco_dom_pct / 100"
FEW = "least(greatest(n_mode_classes, 2), 4) / 4.0::double"
ANN = "greatest(" + ", ".join(f"case when n_stb_P{k} >= 1 then n_stb_P{k} / {n}.0::double * 5 + stb_p_P{k} / 100 * 4 + md_pct_P{k} / 100 * 3 + {BASE} else 0 end" for k, n in ((1, 7), (2, 7), (3, 6), (4, 6))) + ")"
SCORES = f"""sc as (select *, max_stab_run / 26.0::double * 5 + stable_yr_pct / 100 * 4 + lulc_mode_pct / 100 * 3 + (1 - least(greatest(shannon_idx / ln(19), 0), 1)) * 2 + {BASE} sc_e_h, max_stab_run / 26.0::double * 4 + stable_yr_pct / 100 * 3 + lulc_mode_pct / 100 * 3 + {FEW} * 2 + {BASE} sc_e_s,
 {ANN} sc_a_h, transition_pct / 100 * 5 + greatest(lulc_mode_pct, lulc_last_pct) / 100 * 4 + critical_pct / 100 * 2 + {BASE} sc_t_h, transition_pct / 100 * 5 + {FEW} * 3 + conf_risk_pct / 100 * 3 + critical_pct / 100 * 2 + {BASE} sc_t_s from r)"""


@query("dom_05_scores", CANDS, "select grid_id, round(sc_e_h, 8) sc_e_h, round(sc_e_s, 8) sc_e_s, round(sc_a_h, 8) sc_a_h, round(sc_t_h, 8) sc_t_h, round(sc_t_s, 8) sc_t_s from sc", SCORES)
def _(df):
    return L.scores(df).select("grid_id", *(F.round(c, 8).alias(c) for c in ("sc_e_h", "sc_e_s", "sc_a_h", "sc_t_h", "sc_t_s")))


@query("scl_23_periods", CANDS, "select grid_id, case when n_stb_P4 >= 4 then 'P4' when n_stb_P3 >= 4 then 'P3' when n_stb_P2 >= 4 then 'P2' when n_stb_P1 >= 4 then 'P1' end best from r")
def _(df):
    return df.select("grid_id", L.best_period(4).alias("best"))


@query("win_03_top_per_group", CANDS, "select grid_id from (select grid_id, row_number() over (partition by eco_dom_id order by stable_yr_pct desc, grid_id) k from r) where k <= 4")
def _(df):
    return L.top_per_group(df, ["eco_dom_id"], "stable_yr_pct", 4).select("grid_id")


@query("win_04_interleave_tiles", CANDS, "select grid_id, (row_number() over (order by rk, stable_yr_pct desc, grid_id))::int place from (select *, row_number() over (partition by mgrs_dom order by stable_yr_pct desc, grid_id) rk from r)")
def _(df):
    return L.interleave_tiles(df, "stable_yr_pct").select("grid_id", "place")


@query("win_09_dom_10_proportional_cut", CANDS, "select grid_id from (select grid_id, row_number() over (partition by sample_type order by stable_yr_pct desc, grid_id) k, count(*) over (partition by sample_type) n from r) where k <= greatest(1, floor(n * 0.3))")
def _(df):
    return L.proportional(df, "sample_type", 0.3, "stable_yr_pct").select("grid_id")


@query("win_11_quota", CANDS, "select grid_id from (select grid_id, eco_dom_id, row_number() over (partition by eco_dom_id order by stable_yr_pct desc, grid_id) k from r) left join (select eco_dom_id, count(*) n from r where k % 50 = 0 group by eco_dom_id) using (eco_dom_id) where k + coalesce(n, 0) <= 6")
def _(df):
    had = df.where("k % 50 = 0").groupBy("eco_dom_id").agg(F.count("*").alias("n"))
    return L.quota(df, "eco_dom_id", "stable_yr_pct", 6, had).select("grid_id")


@query("srt_08_modal_cap", CANDS, f"select grid_id from (select *, {EXEMPT} ex, row_number() over (partition by lulc_mode_id = 25 order by (lulc_mode_id = 25 and {EXEMPT}) desc, rare_presence_pct desc, lulc_mode_pct desc, max_stab_run desc, grid_id) n from r) where lulc_mode_id <> 25 or ex or n <= 60")
def _(df):
    return L.modal_cap(df, 25, 60, L.exempt()).select("grid_id")


@query("srt_09_cap_type", CANDS, "select grid_id from (select *, row_number() over (partition by sample_type = 'anual_homogenea' order by (sample_type = 'anual_homogenea' and target_rare_class <> '') desc, stable_yr_pct desc, grid_id) n from r) where sample_type <> 'anual_homogenea' or target_rare_class <> '' or n <= 60")
def _(df):
    return L.cap_type(df, "anual_homogenea", 60, "stable_yr_pct").select("grid_id")


@query("srt_10_mix_order", CANDS, "select grid_id, (row_number() over (order by (grid_mode = 'mixto')::int desc, stable_yr_pct desc, grid_id))::int place from r")
def _(df):
    return L.mix_order(df, "stable_yr_pct").select("grid_id", "place")


@query("dom_16_reserves", CANDS, f"""select grid_id, 'reserva_eco' sample_role from (select *, row_number() over (partition by eco_dom_id order by (grid_mode = 'mixto')::int desc, sc_e_s desc, grid_id) n from sc where k % 40 <> 0 and eco_dom_id in (3, 6) and (lulc_mode_id <> 33 or target_rare_class <> '') and (not (eco_dom_id in (1, 2, 3) and lulc_mode_id = 25) or {EXEMPT}))
 where n <= 3 and (select count(*) from r q where q.k % 40 = 0 and q.eco_dom_id = 3) <= 600""", SCORES)
def _(df):
    sc = L.scores(df)
    return L.reserves(sc, sc.where("k % 40 = 0"), few=600).select("grid_id", "sample_role")


@query("dom_13_profile", CANDS, "select count(*) n, count(*) filter (where dim_temporal = 'estable') stable, case when count(*) filter (where dim_temporal = 'estable') < greatest(25, floor(count(*) * 0.08)) then 'dominado_anual_transicion' else 'mixto' end selection_profile from r")
def _(df):
    return L.profile(df)


@query("jon_11_remaining", CANDS, "select grid_id from r where grid_id not in (select grid_id from r where k % 3 = 0)")
def _(df):
    return L.remaining(df, df.where("k % 3 = 0")).select("grid_id")


@query("jon_07_reattach_scores", CANDS, "select s.grid_id, round(sc_e_h, 6) sc_e_h from (select grid_id from r where k % 5 = 0) s left join sc using (grid_id)", SCORES)
def _(df):
    return df.where("k % 5 = 0").select("grid_id").join(L.scores(df).select("grid_id", "sc_e_h").dropDuplicates(["grid_id"]), "grid_id", "left").withColumn("sc_e_h", F.round("sc_e_h", 6))


#: Clusters of touching cells, named by their smallest id.
TOUCH = """ed as materialized (select a.grid_id a, b.grid_id b from r a join r b on a.mgrs = b.mgrs and abs(a.col - b.col) <= 1 and abs(a.row - b.row) <= 1 and not (a.col = b.col and a.row = b.row)),
 reach as (select grid_id n, grid_id c from r union select ed.b, reach.c from reach join ed on ed.a = reach.n where ed.b > reach.c), cl as materialized (select n grid_id, min(c) as cluster from reach group by n)"""


@query("geo_12_clusters", CANDS, "select grid_id, cluster from cl", TOUCH)
def _(df):
    return L.clusters(df)


SPLITS = TOUCH + """, u as (select r.grid_id, cluster, case when trim(target_rare_class) <> '' then 'rare:' || trim(target_rare_class) else sample_type || '|' || eco_dom_id end s from r join cl using (grid_id)),
 e as (select *, count(*) over (partition by s) n, row_number() over (partition by s order by md5('2026|' || s || '|' || cluster), cluster) k from (select distinct cluster, s from u)), v as (select *, greatest(1, round_even(n * 0.15::double, 0)) v from e),
 nm as (select cluster, s, case when n = 1 then 'train' when n = 2 then case when k = 1 then 'train' else 'val' end when k <= greatest(1, n - 2 * v) then 'train' when k <= greatest(1, n - 2 * v) + v then 'val' else 'test' end split from v)"""


@query("dom_14_split", CANDS, "select u.grid_id, u.cluster, nm.split from u join (select cluster, max(s) s from u group by cluster) l using (cluster) join nm on nm.cluster = u.cluster and nm.s = l.s", SPLITS)
def _(df):
    return L.split(df.drop("split")).select("grid_id", "cluster", "split")


@query("dom_15_split_leaks", CANDS, """select count(*) neighbor_pairs, floor(count(*) filter (where a.split <> b.split) / 2)::bigint leak_pairs from r a join r b on a.mgrs = b.mgrs and abs(a.col - b.col) <= 1 and abs(a.row - b.row) <= 1 and not (a.col = b.col and a.row = b.row)""")
def _(df):
    return L.split_leaks(df)
