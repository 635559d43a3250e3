"""Queries over review plans, reports, labels and their QA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as T
from ..operators import labels as B
from ..operators import review as V
from ..operators import views as W
from .registry import query
from .roles import CANDS, GRID, POLYS

# --- review ---------------------------------------------------------------------

YEARS = "y as (select *, case when k % 7 = 0 then []::int[] when k % 5 = 0 then [1999, 2001, 2013] else list_sort(list_distinct([(1999 + k % 26)::int, 2024])) end ys from r)"


@query("dom_19_stable_years", CANDS, """select grid_id, array_to_string(case when len(ys) = 0 then [1999, 2013, 2024] else list_sort(list_distinct([case when list_contains(ys, 1999) then 1999 else (select y from (select unnest(ys) y) order by abs(y - 2001), y limit 1) end,
 case when list_contains(ys, 2013) then 2013 else (select y from (select unnest(ys) y) order by abs(y - 2013), y limit 1) end, list_max(ys)])) end, ',') v from y""", YEARS)
def _(df):
    from ..functions import scalars as S

    return df.select("grid_id", F.array_join(V.stable_years(S.year_list(F.col("stable_years"))), ",").alias("v"))


@query("dom_19_review_plan", CANDS)
def _(df):
    names = {f"md_nm_P{i}": F.lit("") for i in (1, 2, 3, 4)} | {f"stb_yrs_P{i}": F.col("stable_years") for i in (1, 2, 3, 4)}
    out = V.plan(df.withColumns(names | {"target_rare_class_id": F.when(F.col("target_rare_class") == "Salar", 61).otherwise(-9999)}))
    return out.select("grid_id", "review_years", "n_review_years", "review_rule", "review_priority", "review_notes")


def _plan(df):
    return V.national(df.withColumnRenamed("stable_years", "review_years").withColumn("review_rule", F.col("dim_temporal")).withColumn("review_priority", F.col("review_tier")))


NAT = YEARS + ", n as (select *, array_to_string(ys, ',') review_years, len(ys) n_review_years from y)"


@query("dom_20_national_plan", CANDS, "select grid_id, review_years, n_review_years::int n_review_years, n_review_years > 0 has_review_years, review_desc = 'auto_sin_revision' is_auto_sin_revision, target_rare_class <> '' has_rare_class from n", NAT)
def _(df):
    return _plan(df).select("grid_id", "review_years", "n_review_years", "has_review_years", "is_auto_sin_revision", "has_rare_class")


@query("dom_20_rect_years", CANDS, "select utm, grid_id, unnest(ys) as year, sample_type, split from y", YEARS)
def _(df):
    return V.rect_years(_plan(df)).select("utm", "grid_id", "year", "sample_type", "split")


@query("agg_27_summary_utm", CANDS, """select coalesce(utm, 'TOTAL') utm, count(grid_id) n_rectangulos, count(distinct grid_id) n_grid_id_unicos, sum(n_review_years)::bigint n_anios_revision_total, round(avg(n_review_years), 2) n_anios_revision_promedio, count(*) filter (where n_review_years = 0) n_sin_review_years,
 count(*) filter (where review_desc = 'auto_sin_revision') n_auto_sin_revision, count(*) filter (where target_rare_class <> '') n_con_clase_rara from n group by rollup (utm)""", NAT)
def _(df):
    return V.summary_utm(_plan(df))


@query("agg_27_summary_type", CANDS, "select utm, dim_temporal, dim_espacial, sample_type, count(grid_id) n_rectangulos, sum(n_review_years)::bigint n_anios_revision_total, round(avg(n_review_years), 2) n_anios_revision_promedio from n group by utm, dim_temporal, dim_espacial, sample_type", NAT)
def _(df):
    return V.summary_by(_plan(df), ["utm", "dim_temporal", "dim_espacial", "sample_type"])


@query("agg_27_summary_rule_priority", CANDS, "select utm, review_tier review_priority, review_desc, count(grid_id) n_rectangulos, sum(n_review_years)::bigint n_anios_revision_total, round(avg(n_review_years), 2) n_anios_revision_promedio from n group by utm, review_tier, review_desc", NAT)
def _(df):
    return V.summary_by(_plan(df), ["utm", "review_priority", "review_desc"])


@query("jon_06_agg_27_summary_year", CANDS, """select y as year, utm, count(*) n_rectangulos_a_revisar, count(*) filter (where split = 'train') n_train, count(*) filter (where split = 'val') n_val, count(*) filter (where split = 'test') n_test,
 count(*) filter (where dim_temporal = 'anual') n_anual, count(*) filter (where dim_temporal = 'estable') n_estable, count(*) filter (where dim_temporal = 'transicion') n_transicion from (select *, unnest(ys) y from y) group by y, utm""", YEARS)
def _(df):
    return V.summary_year(V.rect_years(_plan(df)))


@query("agg_24_crosstab", CANDS, "select coalesce(eco_dom_id::varchar, 'TOTAL') eco_dom_id, count(*) filter (where utm = 'UTM18') \"UTM18\", count(*) filter (where utm = 'UTM19') \"UTM19\", count(*) \"TOTAL\" from r group by rollup (eco_dom_id)")
def _(df):
    return V.crosstab(df, "eco_dom_id", "utm", ["UTM18", "UTM19"])


@query("agg_23_group_sizes", CANDS, "select utm, sample_type, count(*) n from r group by utm, sample_type")
def _(df):
    return V.group_sizes(df, ["utm", "sample_type"])


METRICS = ["valid_area_pct", "eco_dom_pct", "noobs_pct", "transition_pct", "lulc_mode_pct", "stable_yr_pct", "shannon_idx", "max_stab_run", "critical_pct", "conf_risk_pct"]
_METRICS = ", ".join(f"round(avg({m}), 2) {m}_mean, min({m}) {m}_min, max({m}) {m}_max" for m in METRICS)


@query("agg_25_quality_summary", CANDS, f"select utm, sample_type, count(*) n, {_METRICS} from r group by utm, sample_type")
def _(df):
    return V.quality_summary(df, ["utm", "sample_type"], METRICS)


@query("agg_26_general_summary", CANDS, "select coalesce(utm, 'TOTAL') utm, count(*) n, count(distinct eco_dom_id) ecos, count(distinct mgrs_dom) tiles, count(distinct lulc_mode_id) modes, count(distinct sample_type) types, count(*) filter (where target_rare_class <> '') rare from r group by rollup (utm)")
def _(df):
    return V.general_summary(df)


@query("agg_28_critical_summary", CANDS, "select coalesce(nullif(t, ''), 'none') clase, count(*) n from (select target_rare_class t from r union all select 'TOTAL' from r where target_rare_class <> '') group by 1")
def _(df):
    return V.critical_summary(df)


_N = lambda c: f"count(*) filter (where {c})"
_WOOD = "regexp_matches(target_rare_class, 'Formacion_boscosa|Bosque', 'i')"
CHECKS = [
    ("total", "count(*)", "{} between 300 and 350"), ("utm18", _N("utm = 'UTM18'"), "{} between 100 and 130"), ("utm19", _N("utm = 'UTM19'"), "{} between 140 and 180"),
    ("e_h_18", _N("utm = 'UTM18' and sample_type = 'estable_homogenea'"), "{} >= 8"), ("e_s_18", _N("utm = 'UTM18' and sample_type = 'estable_simple_media'"), "{} >= 10"),
    ("t_h", _N("sample_type = 'transicion_homogenea'"), "{} between 20 and 35"), ("t_h_19", _N("utm = 'UTM19' and sample_type = 'transicion_homogenea'"), "{} >= 10"),
    ("arid_trans", _N("sample_type like 'transicion%' and eco_dom_id in (1, 2, 3, 4, 5)"), "{} >= 5"), ("otra", _N("lulc_mode_id = 25"), "{} <= 45"), ("pastizal", _N("lulc_mode_id = 15"), "{} >= 6"),
    ("salar", _N("target_rare_class = 'Salar'"), "{} between 8 and 14"), ("arena", _N("target_rare_class = 'Arena_playa_duna'"), "{} between 8 and 14"),
    ("bosque", _N(_WOOD), f"{_N(_WOOD + ' and split = $$val$$')} >= 1 and {_N(_WOOD + ' and split = $$test$$')} >= 1"), ("train", _N("split = 'train'"), "abs({}::double / greatest(count(*), 1) - 0.70) < 0.08"),
    ("val", _N("split = 'val'"), "{} >= 25"), ("tier0", _N("review_tier = 0"), "{} >= 0"),
]


@query("agg_36_audit", CANDS, " union all ".join(f"select '{k}' as \"check\", {v} as value, {ok.format(v)} ok from r" for k, v, ok in CHECKS))
def _(df):
    return V.audit(df)


@query("agg_42_describe", CANDS, "select round(avg(transition_pct), 6) m, min(transition_pct) a, max(transition_pct) b from r")
def _(df):
    d = V.describe(df, ["transition_pct"])
    return d.select(F.round("transition_pct_mean", 6).alias("m"), F.col("transition_pct_min").alias("a"), F.col("transition_pct_max").alias("b"))


@query("agg_48_wide_to_long", CANDS, "select grid_id, metric, value from r unpivot (value for metric in (valid_area_pct, eco_dom_pct, transition_pct, lulc_mode_pct, stable_yr_pct, shannon_idx, critical_pct))")
def _(df):
    return V.wide_to_long(df, ["grid_id"], ["valid_area_pct", "eco_dom_pct", "transition_pct", "lulc_mode_pct", "stable_yr_pct", "shannon_idx", "critical_pct"])


@query("srt_01_operational_order", CANDS, "select grid_id, row_number() over (order by review_tier, utm, dim_temporal, sample_type, grid_id)::int place from r")
def _(df):
    return V.operational_order(df).select("grid_id", "place")


_LEGEND = ", ".join(f"({k}, '{T.names(k)[5]}')" for k in T.CODES)


@query("set_03_missing_classes", CANDS, f"select c clase, n nombre from (values {_LEGEND}) v(c, n) where c not in (select lulc_mode_id from r)")
def _(df):
    return B.missing_classes(df.select(F.col("lulc_mode_id").alias("class_id")))


@query("set_06_duplicates", CANDS, "select mgrs, col, row, count(*) n from r group by all having count(*) > 1")
def _(df):
    return W.repeated(df, ["mgrs", "col", "row"])


@query("set_07_dom_21_groups", CANDS, "select grid_id, sample_type grupo from r union all select grid_id, 'clases_raras' from r where target_rare_class <> '' union all select grid_id, 'clases_transversales' from r where lulc_mode_id = 25")
def _(df):
    return B.expand_groups(df.withColumn("es_transversal", F.col("lulc_mode_id") == 25)).select("grid_id", "grupo")


@query("dom_22_pilot", CANDS, "select grid_id, 'forced' role from r where k in (5, 9) union all select min(grid_id), 'first' from r where eco_dom_id not in (select eco_dom_id from r where k in (5, 9)) group by eco_dom_id")
def _(df):
    return B.pilot(df, ["G5", "G9"]).select("grid_id", "role")


@query("prj_12_16_names_defaults", CANDS, "select grid_id, case when lower(trim(target_rare_class)) in ('', 'nan', 'none', '-9999') then 'sin_nombre' else target_rare_class end etiqueta from r")
def _(df):
    return df.select("grid_id", W.named_or_default(F.col("target_rare_class")).alias("etiqueta"))


# --- labels and QA --------------------------------------------------------------

UID = "grid_id || '|' || rev_year || '|' || class_id || '|' || patch_id"
COV = "round(case when sum(area_ha) over w = 0 then 0 else sum(case when poly_qa = 'aprobado' then area_ha else 0 end) over w / sum(area_ha) over w * 100 end, 2)"
LBL = "case when corr_id > 0 then corr_id else class_id end"


@query("dom_25_init_qa", POLYS, f"select {UID} poly_uid, poly_qa, 'auto' qa_scope, {LBL} lbl_id, rect_qa from r")
def _(df):
    return B.init_qa(df).select("poly_uid", "poly_qa", "qa_scope", "lbl_id", "rect_qa")


@query("agg_30_win_06_reviewed_area", POLYS, "select distinct grid_id, rev_year, round(case when t = 0 then 0 else a / t * 100 end, 2) cov from (select grid_id, rev_year, sum(case when poly_qa = 'aprobado' then area_ha else 0 end) a, sum(area_ha) t from r group by grid_id, rev_year)")
def _(df):
    return B.reviewed_area(df).select("grid_id", "rev_year", F.col("cov_rect").alias("cov")).distinct()


@query("win_05_patch_ids", POLYS, "select grid_id, rev_year, class_id, patch_id as was, row_number() over (partition by grid_id, rev_year, class_id order by patch_id)::int patch_id from r")
def _(df):
    return B.patch_ids(df.withColumnRenamed("patch_id", "was"), "was").select("grid_id", "rev_year", "class_id", "was", "patch_id")


@query("jon_12_dom_27_merge_edits", POLYS, f"""select {UID} poly_uid, case when grid_id || '|' || rev_year in ('R1|1999', 'R2|2000') then 'rechazado' when patch_id % 100 = 0 then 'aprobado' else poly_qa end poly_qa, case when patch_id % 100 = 0 then 12 when corr_id > 0 then corr_id else class_id end lbl_id, case when grid_id || '|' || rev_year in ('R1|1999', 'R2|2000') then 'rechazado' else rect_qa end rect_qa from r""")
def _(df):
    base = B.init_qa(df)
    edits = base.where("patch_id % 100 = 0").select("poly_uid", F.lit("aprobado").alias("poly_qa"), F.lit(12).alias("corr_id"))
    rects = df.sparkSession.createDataFrame([("R1|1999", "rechazado"), ("R2|2000", "rechazado")], "rect_key string, rect_qa string")
    return B.merge_edits(base, edits, rects).select("poly_uid", "poly_qa", "lbl_id", "rect_qa")


@query("dom_26_violations", POLYS, f"""select 'split_inconsistente' as "check", grid_id || '|' || rev_year as key from r group by grid_id, rev_year having count(distinct split) > 1 union all
 select 'uid_duplicado', {UID} from r group by 2 having count(*) > 1 union all select 'lbl_id_invalido', {UID} from r where poly_qa = 'aprobado' and {LBL} not in ({', '.join(map(str, [*T.CODES, 35]))}) union all
 select 'cobertura', key from (select grid_id || '|' || rev_year as key, any_value(rect_qa) q, min(rev_tier) t, round(case when sum(area_ha) = 0 then 0 else sum(case when poly_qa = 'aprobado' then area_ha else 0 end) / sum(area_ha) * 100 end, 2) s from r group by 1)
 where q in ('aprobado', 'parcial') and s < case t when 0 then 100 when 1 then 85 when 2 then 90 when 3 then 95 else 90 end""")
def _(df):
    return B.violations(B.init_qa(df))


@query("dom_28_batch_rules", POLYS, f"select {UID} poly_uid, case when p >= 5 then 'aprobado' when p < 1 then 'rechazado' else poly_qa end poly_qa, case when p >= 5 then 'ninguno' when p < 1 then 'borde' else 'ninguno' end err_type from (select *, area_ha / sum(area_ha) over (partition by grid_id, rev_year) * 100 p from r)")
def _(df):
    return B.batch_rules(B.init_qa(df)).select("poly_uid", "poly_qa", "err_type")


@query("agg_29_label_summary", POLYS, "select rev_year, class_id, count(*) n_poligonos, count(distinct grid_id) n_rectangulos, round(sum(area_ha), 2) area_ha from r group by rev_year, class_id")
def _(df):
    return B.summary(df, ["rev_year", "class_id"])


@query("agg_49_class_shares", POLYS, "select grid_id, rev_year, class_id, round(ha / sum(ha) over (partition by grid_id, rev_year) * 100, 1) pct from (select grid_id, rev_year, class_id, sum(area_ha) ha from r group by all)")
def _(df):
    return B.class_shares(df).select("grid_id", "rev_year", "class_id", "pct")


@query("geo_14_dissolve", POLYS, "select grid_id, rev_year, class_id, round(sum(area_ha), 4) area_ha, count(*) n_parts from r group by grid_id, rev_year, class_id")
def _(df):
    return B.dissolve(df, ["grid_id", "rev_year", "class_id"]).withColumn("area_ha", F.round("area_ha", 4))


@query("agg_31_patch_table", POLYS, """select class_id, conn, n_parches, ha_total, px_p50, px_p90, px_max, pct_small, pct_area, coalesce(max(case when conn = 4 then n_parches end) over (partition by class_id) >= 200, false) confiable from (select class_id, conn, count(*) n_parches, round(sum(px) * 0.09::double, 2) ha_total,
 round(quantile_cont(px, 0.5), 1) px_p50, round(quantile_cont(px, 0.9), 1) px_p90, max(px) px_max, round(avg((px <= 5)::int) * 100, 1) pct_small, round(sum(case when px <= 5 then px else 0 end)::double / sum(px) * 100, 1) pct_area from (select class_id, 4 + 4 * (patch_id % 2) conn, 1 + patch_id % 17 px from r) group by class_id, conn)""")
def _(df):
    p = df.select("class_id", (F.lit(4) + 4 * (F.col("patch_id") % 2)).alias("conn"), (F.lit(1) + F.col("patch_id") % 17).alias("px"))
    return B.patch_table(p).select("class_id", "conn", "n_parches", "ha_total", "px_p50", "px_p90", "px_max", F.col("pct_parches_speckle").alias("pct_small"), F.col("pct_area_speckle").alias("pct_area"), "confiable")


@query("agg_32_extent_tables", POLYS, "select rev_year, count(distinct grid_id) n_rectangulos, sum(patch_id % 5)::bigint n_parches, count(distinct grid_id) < 30 poca_representacion from r group by rev_year")
def _(df):
    return B.extent_by(df.withColumn("n_parches", F.col("patch_id") % 5), "rev_year", 30)


@query("agg_33_sieve_changes", GRID, """select coalesce(tile, '__TOTAL__') archivo, coalesce(value::varchar, '__TOTAL__') clase, count(*) pixeles_clase, count(*) filter (where value <> s) pixeles_reasignados, round(count(*) filter (where value <> s)::double / count(*) * 100, 3) pct_area_cambiada
 from (select *, case when elev % 7 = 0 then 59 else value end s from r where value <> 0) group by grouping sets ((tile, value), (tile), ())""")
def _(df):
    return B.change_stats(df.withColumn("sieved", F.when(F.col("elev") % 7 == 0, 59).otherwise(F.col("value"))))


@query("jon_05_extent_eco", POLYS, "select s, count(distinct grid_id) n from (select *, case when grid_id < 'R3' then 'E' || (patch_id % 3) end s from r) group by s")
def _(df):
    eco = df.where("grid_id < 'R3'").select("patch_id", F.concat(F.lit("E"), (F.col("patch_id") % 3).cast("string")).alias("s"))
    return B.rectangles_by(df.join(eco, "patch_id", "left"), "s")
