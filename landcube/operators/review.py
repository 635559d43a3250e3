"""Review plans, national consolidation, crosstabs and the balance audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Years around the border of two periods (fixed values).
WINDOWS = {("P1", "P2"): (2004, 2007), ("P2", "P3"): (2011, 2014), ("P3", "P4"): (2017, 2020)}
STABLE_ANCHORS, TRANSITION_ANCHORS = (1999, 2013, 2024), (1999, 2005, 2012, 2018, 2024)


def _years(ys) -> Column:
    return F.array(*map(F.lit, ys))


def stable_years(stable: Column) -> Column:
    n = F.size(stable)
    has = lambda y: F.array_contains(stable, y)
    first = F.when(has(1999), 1999).otherwise(S.nearest_year(2001, stable))
    mid = F.when(has(2013), 2013).otherwise(S.nearest_year(2013, stable))
    last = F.when(has(2024), 2024).otherwise(F.array_max(stable))
    return F.when(n == 0, _years(STABLE_ANCHORS)).otherwise(S.compact_years(F.array(first, mid, last)))


def boundary_years() -> Column:
    parts = [F.when(F.col(f"md_id_{a}") != F.col(f"md_id_{b}"), F.sequence(F.lit(lo), F.lit(hi))).otherwise(F.array().cast("array<int>")) for (a, b), (lo, hi) in WINDOWS.items()]
    return S.compact_years(F.concat(*parts), 9)


def unstable_years(stable: Column) -> Column:
    off = F.array_except(F.sequence(F.lit(S.FIRST_YEAR), F.lit(S.LAST_YEAR)), stable)
    around = F.flatten(F.transform(off, lambda y: F.array(y - 1, y, y + 1)))
    return F.when(F.size(stable) == 0, F.array().cast("array<int>")).otherwise(S.compact_years(around, 9))


def rare_years() -> Column:
    """First and last stable year (or the ends) of the periods with the rare class."""
    rare, ident = S.clean_text(F.col("target_rare_class")), F.coalesce("target_rare_class_id", F.lit(-9999))
    parts = []
    for p, (a, b) in S.PERIODS.items():
        stb = S.year_list(F.col(f"stb_yrs_{p}"))
        hit = ((ident > 0) & (F.col(f"md_id_{p}") == ident)) | ((rare != "") & (S.clean_text(F.col(f"md_nm_{p}")) == rare))
        ends = F.when(F.size(stb) > 0, F.array(F.array_min(stb), F.array_max(stb))).otherwise(_years((a, b)))
        parts.append(F.when(hit, ends).otherwise(F.array().cast("array<int>")))
    return S.compact_years(F.concat(*parts), 6)


def plan(df: DataFrame) -> DataFrame:
    """``df`` with review_years, n_review_years, review_rule, review_priority,
    review_notes."""
    dim, stable = S.clean_text(F.col("dim_temporal")), S.year_list(F.col("stable_years"))
    ref = F.coalesce("ref_year", F.lit(-9999))
    none = F.array().cast("array<int>")
    bound, off = boundary_years(), unstable_years(stable)
    ref_ok, near = ref.between(S.FIRST_YEAR, S.LAST_YEAR), S.nearest_year(2019, stable)
    years = (
        F.when(dim == "anual", F.when(ref_ok, F.array(ref)).when(F.size(stable) > 0, F.array(near)).otherwise(none))
        .when(dim == "transicion", F.when(F.size(bound) > 0, bound).when(F.size(off) > 0, off).otherwise(_years(TRANSITION_ANCHORS)))
        .otherwise(stable_years(stable)))
    rule = (
        F.when(dim == "anual", F.when(ref_ok | (F.size(stable) == 0), "anual_ref_year").otherwise("anual_fallback_stable_year")).when(dim == "estable", "estable_anclas_temporales")
        .when(dim == "transicion", F.when(F.size(bound) > 0, "transicion_cambio_modal_entre_periodos").when(F.size(off) > 0, "transicion_anios_no_estables").otherwise("transicion_sin_anio_exacto_usar_anclas"))
        .otherwise("fallback_anclas_temporales"))
    out = df.withColumns({"_y": years, "_r": rare_years(), "review_rule": rule})
    out = out.withColumn("_all", F.when(F.size("_r") > 0, S.compact_years(F.concat("_y", "_r"), 10)).otherwise(S.compact_years(F.col("_y"))))
    note = lambda c, t: F.when(c, t)
    notes = F.array_join(F.array_compact(F.array(
        note((dim == "anual") & ~ref_ok, "anual_sin_ref_year_valido"), note(~dim.isin("anual", "estable", "transicion"), "dim_temporal_no_reconocida"),
        note((F.size("_r") > 0) & (F.array_sort("_all") != F.array_sort("_y")), "incluye_anios_clase_rara"))), ";")
    urgent = (S.clean_text(F.col("target_rare_class")) != "") | (dim == "transicion") | F.col("sample_type").isin("transicion_homogenea", "anual_homogenea")
    tier = F.coalesce("review_tier", F.lit(2))
    return out.withColumns({
        "review_years": F.array_join("_all", ","), "n_review_years": F.size("_all"), "review_priority": F.when(urgent, F.least(tier, F.lit(1))).otherwise(tier), "review_notes": notes}).drop("_y", "_r", "_all")


def national(df: DataFrame) -> DataFrame:
    """Normalised plan rows with control flags."""
    years = S.year_list(F.col("review_years"), 1900, 2100, digits_only=False)
    return df.withColumns({
        "review_years_list": years, "review_years": F.array_join(years, ","), "n_review_years": F.size(years), "has_review_years": F.size(years) > 0,
        "is_auto_sin_revision": F.coalesce(F.col("review_desc") == "auto_sin_revision", F.lit(False)), "has_rare_class": F.trim(F.coalesce("target_rare_class", F.lit(""))) != ""})


def rect_years(plan_: DataFrame) -> DataFrame:
    return plan_.withColumn("year", F.explode("review_years_list")).drop("review_years_list")


def summary_utm(plan_: DataFrame) -> DataFrame:
    """By zone and TOTAL, in one rollup."""
    out = plan_.rollup("utm").agg(
        F.count("grid_id").alias("n_rectangulos"), F.count_distinct("grid_id").alias("n_grid_id_unicos"), F.sum("n_review_years").alias("n_anios_revision_total"),
        F.round(F.avg("n_review_years"), 2).alias("n_anios_revision_promedio"), F.count_if(~F.col("has_review_years")).alias("n_sin_review_years"),
        F.count_if("is_auto_sin_revision").alias("n_auto_sin_revision"), F.count_if("has_rare_class").alias("n_con_clase_rara"), F.grouping("utm").alias("_g"))
    return out.withColumn("utm", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("utm"))).drop("_g")


def summary_by(plan_: DataFrame, by: list[str]) -> DataFrame:
    return plan_.groupBy(*by).agg(F.count("grid_id").alias("n_rectangulos"), F.sum("n_review_years").alias("n_anios_revision_total"), F.round(F.avg("n_review_years"), 2).alias("n_anios_revision_promedio"))


def summary_year(rect_year: DataFrame) -> DataFrame:
    """One conditional aggregation in place of two crosstabs and joins."""
    n = lambda c, *v: F.count_if(F.col(c).isin(*v))
    return rect_year.groupBy("year", "utm").agg(
        F.count("*").alias("n_rectangulos_a_revisar"), n("split", "train").alias("n_train"), n("split", "val", "validation").alias("n_val"), n("split", "test").alias("n_test"),
        n("dim_temporal", "anual").alias("n_anual"), n("dim_temporal", "estable").alias("n_estable"), n("dim_temporal", "transicion").alias("n_transicion"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts with a TOTAL row and column; ``values`` are the columns."""
    out = df.rollup(row).agg(*(F.count_if(F.col(col) == v).alias(str(v)) for v in values), F.count("*").alias("TOTAL"), F.grouping(row).alias("_g"))
    return out.withColumn(row, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(row).cast("string"))).drop("_g")


def quality_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    aggs = [f(m).alias(f"{m}_{s}") if s in ("min", "max") else F.round(f(m), 2).alias(f"{m}_{s}") for m in metrics for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def wide_to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def audit(df: DataFrame) -> DataFrame:
    """(check, value, ok): all scalar checks in one aggregation, then unpivoted."""
    n = lambda c: F.count_if(c)
    utm, kind, mode, rare, eco = F.col("utm"), F.col("sample_type"), F.col("lulc_mode_id"), F.trim(F.coalesce("target_rare_class", F.lit(""))), F.col("eco_dom_id")
    e = lambda z, t: n((utm == z) & (kind == t))
    bosque = rare.rlike("(?i)Formacion_boscosa|Bosque")
    one = df.agg(
        F.count("*").alias("total"), n(utm == "UTM18").alias("utm18"), n(utm == "UTM19").alias("utm19"), e("UTM18", "estable_homogenea").alias("e_h_18"),
        e("UTM18", "estable_simple_media").alias("e_s_18"), n(kind == "transicion_homogenea").alias("t_h"), e("UTM19", "transicion_homogenea").alias("t_h_19"),
        n(kind.startswith("transicion") & eco.isin(1, 2, 3, 4, 5)).alias("arid_trans"), n(mode == 25).alias("otra"), n(mode == 15).alias("pastizal"), n(rare == "Salar").alias("salar"),
        n(rare == "Arena_playa_duna").alias("arena"), n(bosque).alias("bosque"), n(bosque & (F.col("split") == "val")).alias("bosque_val"), n(bosque & (F.col("split") == "test")).alias("bosque_test"),
        n(F.col("split") == "train").alias("train"), n(F.col("split") == "val").alias("val"), n(F.col("split") == "test").alias("test"), n(F.col("review_tier") == 0).alias("tier0"))
    c = F.col
    ok = {
        "total": c("total").between(300, 350), "utm18": c("utm18").between(100, 130), "utm19": c("utm19").between(140, 180), "e_h_18": c("e_h_18") >= 8, "e_s_18": c("e_s_18") >= 10,
        "t_h": c("t_h").between(20, 35), "t_h_19": c("t_h_19") >= 10, "arid_trans": c("arid_trans") >= 5, "otra": c("otra") <= 45, "pastizal": c("pastizal") >= 6, "salar": c("salar").between(8, 14),
        "arena": c("arena").between(8, 14), "bosque": (c("bosque_val") >= 1) & (c("bosque_test") >= 1), "train": F.abs(c("train") / F.greatest(c("total"), F.lit(1)) - 0.70) < 0.08, "val": c("val") >= 25,
        "tier0": c("tier0") >= 0,
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), c(k).alias("value"), v.alias("ok")) for k, v in ok.items()))
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def operational_order(df: DataFrame) -> DataFrame:
    """``place`` in the order of work: tier, zone, kind, type, id."""
    from .views import in_order

    return in_order(df, ["review_tier", "utm", "dim_temporal", "sample_type", "grid_id"])


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def general_summary(df: DataFrame, by: str = "utm") -> DataFrame:
    """Rows and distinct ecoregions, tiles, modal classes and types of each zone, and in all."""
    out = df.rollup(by).agg(
        F.count("*").alias("n"), F.count_distinct("eco_dom_id").alias("ecos"), F.count_distinct("mgrs_dom").alias("tiles"), F.count_distinct("lulc_mode_id").alias("modes"),
        F.count_distinct("sample_type").alias("types"), F.count_if(F.col("target_rare_class") != "").alias("rare"))
    return out.withColumn(by, F.coalesce(by, F.lit("TOTAL")))


def critical_summary(df: DataFrame, rare: str = "target_rare_class") -> DataFrame:
    """Rows of each rare class, of none, and of all rare ones."""
    t = df.select(F.col(rare).alias("t")).unionByName(df.where(F.col(rare) != "").select(F.lit("TOTAL").alias("t")))
    return t.groupBy(F.coalesce(F.nullif("t", F.lit("")), F.lit("none")).alias("clase")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: mean, least and greatest of each metric."""
    return df.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
