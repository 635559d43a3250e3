"""Statistics of rectangles over yearly class maps: ``lulc(rect, px, year,
class_id, eco_id, lat)`` with one row per pixel and year.

Two aggregations (pixel, then rectangle), no UDF. Modes of equal count are the
lowest id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import taxonomy as T
from .rounds import written

NO_OBS = 27
STABLE_SHARE = 0.75
NORTH_FOREST, NORTH_LAT, ACHAPARRADO = 3, -33.2, 67
#: Classes easily taken for the modal one (fixed values of the caller's legend).
CONFUSION = {59: (60, 67), 60: (59, 66), 66: (12, 63), 12: (66, 63), 63: (66, 12), 25: (29, 23), 29: (25,), 15: (12, 18), 18: (15,)}


def pixel_modes(lulc: DataFrame, by: list[str], keep=("eco_id", "lat")) -> DataFrame:
    """(by..., mode_id) of each pixel's series, lowest id on ties, and the least value of
    the columns ``keep``, which are one a pixel."""
    return lulc.groupBy(*by).agg(F.mode("class_id", True).alias("mode_id"), *(F.min(c).alias(c) for c in keep))


def dominant(counts: DataFrame, by: list[str], ident: str, n: str = "n") -> DataFrame:
    """The id of highest count in each group, the lowest of equals, and its share."""
    return counts.groupBy(*by).agg(
        F.max_by(ident, F.struct(F.col(n), -F.col(ident))).alias(f"{ident}_dom"), (F.max(n) / F.sum(n) * 100).alias(f"{ident}_pct"), F.count("*").alias(f"{ident}_n"))


def shannon(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("shannon"))


def transition_pct(lulc: DataFrame, rect: str = "rect", pixel: str = "px") -> DataFrame:
    """Share of year-to-year changes, a mean over pixels of their means."""
    w = Window.partitionBy(rect, pixel).orderBy("year")
    step = lulc.withColumn("_prev", F.lag("class_id").over(w)).where("_prev is not null")
    per = step.groupBy(rect, pixel).agg(F.avg((F.col("class_id") != F.col("_prev")).cast("int")).alias("t"))
    return per.groupBy(rect).agg((F.avg("t") * 100).alias("tr_pct"))


def year_stability(lulc: DataFrame, rect: str = "rect", pixel: str = "px") -> DataFrame:
    """(rect, year, frac): pixels of each year that have their own mode's class."""
    mode = F.mode("class_id", True).over(Window.partitionBy(rect, pixel))
    return lulc.withColumn("_m", mode).groupBy(rect, "year").agg(F.avg((F.col("class_id") == F.col("_m")).cast("int")).alias("frac"))


def stable_years(stability: DataFrame, rect: str = "rect", share: float = STABLE_SHARE) -> DataFrame:
    """(rect, stable_years, n_stable, stab_yr_pct, stab_pct)."""
    hit = F.col("frac") >= share
    return stability.groupBy(rect).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("year")))), ",").alias("stable_years"), F.count_if(hit).alias("n_stable"),
        (F.count_if(hit) / F.count("*") * 100).alias("stab_yr_pct"), (F.avg("frac") * 100).alias("stab_pct"))


def longest_run(flags: DataFrame, rect: str = "rect", year: str = "year", flag: str = "stable") -> DataFrame:
    """(rect, run, run_start, run_end) of flagged consecutive years, the first of
    equals; rectangles without any have 0 and -9999."""
    on = flags.where(flag)
    island = on.withColumn("_g", F.col(year) - F.row_number().over(Window.partitionBy(rect).orderBy(year)))
    runs = island.groupBy(rect, "_g").agg(F.count("*").cast("int").alias("run"), F.min(year).alias("run_start"), F.max(year).alias("run_end"))
    best = runs.groupBy(rect).agg(F.max_by(F.struct("run", "run_start", "run_end"), F.struct(F.col("run"), -F.col("run_start"))).alias("b"))
    all_ = flags.select(rect).distinct().join(best, rect, "left")
    return all_.select(rect, F.coalesce("b.run", F.lit(0)).alias("run"), F.coalesce("b.run_start", F.lit(-9999)).alias("run_start"), F.coalesce("b.run_end", F.lit(-9999)).alias("run_end"))


def share_metrics(modes: DataFrame, rect: str = "rect") -> DataFrame:
    """Percentages of pixels by modal class: critical, northern forest, stunted
    forest, transversal, unobserved."""
    pct = lambda c: F.avg(c.cast("int")) * 100
    m = F.col("mode_id")
    return modes.groupBy(rect).agg(
        pct(m.isin(*sorted(T.CRITICAL))).alias("crit_pct"), pct((m == NORTH_FOREST) & (F.col("lat") >= NORTH_LAT)).alias("nfor_pct"),
        pct(m == ACHAPARRADO).alias("achap_pct"), pct(m.isin(*sorted(T.TRANSVERSAL))).alias("tran_pct"), pct(m == NO_OBS).alias("noobs_raw_pct"))


def confusion_risk(counts: DataFrame, dom: DataFrame, rect: str = "rect", pairs: dict = CONFUSION) -> DataFrame:
    """Share of pixels whose class is easily taken for the modal one. The pairs
    are a fixed table, broadcast."""
    spark = counts.sparkSession
    table = spark.createDataFrame([(a, b) for a, bs in pairs.items() for b in bs], "modal int, other int")
    met = counts.join(dom.select(rect, "mode_id_dom"), rect).join(
        F.broadcast(table), (F.col("modal") == F.col("mode_id_dom")) & (F.col("other") == F.col("mode_id")), "left")
    return met.groupBy(rect).agg((F.sum(F.when(F.col("other").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("conf_risk_pct"))


def period_stats(lulc: DataFrame, rect: str = "rect", pixel: str = "px") -> DataFrame:
    """Per period: modal class and share, stable years; one row a rectangle."""
    p = lulc.withColumn("period", S.period_of(F.col("year"))).where("period is not null")
    mode = F.mode("class_id", True).over(Window.partitionBy(rect, pixel, "period"))
    p = p.withColumn("mode_id", mode)
    counts = p.select(rect, pixel, "period", "mode_id").distinct().groupBy(rect, "period", "mode_id").agg(F.count("*").alias("n"))
    dom = dominant(counts, [rect, "period"], "mode_id")
    frac = p.groupBy(rect, "period", "year").agg(F.avg((F.col("class_id") == F.col("mode_id")).cast("int")).alias("frac"))
    return _by_period(dom, frac, rect)


def priority_score(val, crit, nfor, achap, n_mode, shannon_, tr, noobs) -> Column:
    """Weighted sum of eight terms; percentages in."""
    return (val / 100 * 2.0 + crit / 100 * 4.0 + nfor / 100 * 3.0 + achap / 100 * 3.0 + F.least(n_mode, F.lit(19)) / 19 * 2.0
            + shannon_ / math.log(19) * 1.5 + tr / 100 * 1.5 + noobs * -0.05)


def temporal_kind(tr_pct, run, p3_stable, p4_stable, tran_pct) -> Column:
    return (F.when(tr_pct >= 15, "transicion").when(((run < 5) & ((p3_stable >= 3) | (p4_stable >= 3))) | (tran_pct > 0), "anual").otherwise("estable"))


def spatial_kind(mode_pct, shannon_, n_mode) -> Column:
    return F.when((mode_pct >= 85) & (shannon_ <= 0.3), "homogenea").when((n_mode <= 4) & (mode_pct >= 45), "simple_media").otherwise("compleja")


def facts(lulc: DataFrame, drop_zero: bool = False) -> DataFrame:
    """What all statistics of rectangles are made of, in one pass over the pixels:
    (rect, kind, k, y, n, x_sum, x_n, z_sum, z_n), counts of pixels by

    * ``pixel``: y is 1 for valid pixels;
    * ``mode``: k is the modal class of valid pixels, y is 1 in the north; x is a pixel's
      share of changes from year to year;
    * ``eco``: k is their ecoregion;
    * ``period``: k is the modal class in period y (1, 2, ...);
    * ``year``: k is the class in year y; x says whether it is the pixel's modal class,
      z whether it is that of its period.

    A pixel's series is one row; its facts are added up before they are shuffled."""
    within = lambda p: F.when(F.col("year").between(*S.PERIODS[p]), F.col("class_id"))
    px = lulc.groupBy("rect", "px").agg(
        F.mode("class_id", True).alias("mode_id"), F.min("eco_id").alias("eco_id"), F.min("lat").alias("lat"), F.array_sort(F.collect_list(F.struct("year", "class_id"))).alias("series"),
        *(F.mode(within(p), True).alias(p) for p in S.PERIODS))
    ok = (F.col("eco_id") > 0) & (F.col("mode_id") != NO_OBS)
    if drop_zero:
        ok = ok & (F.col("mode_id") != 0)
    ok = F.coalesce(ok, F.lit(False))
    classes = F.transform("series", lambda s: s["class_id"])
    later = F.slice(classes, F.lit(2), F.size(classes))
    changed = F.filter(F.zip_with(F.slice(classes, F.lit(1), F.size(classes) - 1), later, lambda a, b: (a != b).cast("int")), lambda c: c.isNotNull())
    share = F.try_divide(F.aggregate(changed, F.lit(0), lambda t, c: t + c), F.size(changed))

    none = F.lit(None).cast("double")
    fact = lambda kind, k, y, x=none, z=none: F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("k"), y.cast("int").alias("y"), x.cast("double").alias("x"), z.cast("double").alias("z"))
    zero = F.lit(0)
    own = [fact("mode", F.col("mode_id"), F.coalesce((F.col("lat") >= NORTH_LAT), F.lit(False)), share), fact("eco", F.col("eco_id"), zero)]
    own += [fact("period", F.col(p), F.lit(i)) for i, p in enumerate(S.PERIODS, 1)]
    period_mode = lambda y: F.coalesce(*(F.when(y.between(*years), F.col(p)) for p, years in S.PERIODS.items()))
    years = F.transform("series", lambda s: fact("year", s["class_id"], s["year"], s["class_id"] == F.col("mode_id"), s["class_id"] == period_mode(s["year"])))
    all_ = F.concat(F.array(fact("pixel", zero, ok)), F.when(ok, F.concat(F.array(*own), years)).otherwise(F.array().cast(F_TYPE)))
    rows = px.select("rect", F.explode(all_).alias("f")).select("rect", "f.*").where("kind != 'period' or k is not null")
    return rows.groupBy("rect", "kind", "k", "y").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"), F.count("x").alias("x_n"), F.sum("z").alias("z_sum"), F.count("z").alias("z_n"))


F_TYPE = "array<struct<kind: string, k: int, y: int, x: double, z: double>>"


def _periods(found: DataFrame) -> DataFrame:
    """Per period from facts: modal class and share, stable years; one row a rectangle."""
    named = F.element_at(F.array(*map(F.lit, S.PERIODS)), F.col("y"))
    dom = dominant(found.where("kind = 'period'").select("rect", named.alias("period"), F.col("k").alias("mode_id"), "n"), ["rect", "period"], "mode_id")
    frac = found.where("kind = 'year'").withColumn("period", S.period_of(F.col("y"))).where("period is not null").groupBy("rect", "period", "y").agg((F.sum("z_sum") / F.sum("z_n")).alias("frac"))
    return _by_period(dom, frac.withColumnRenamed("y", "year"), "rect")


def _by_period(dom: DataFrame, frac: DataFrame, rect: str) -> DataFrame:
    hit = F.col("frac") >= STABLE_SHARE
    years = F.element_at(F.create_map(*(F.lit(x) for k, (a, b) in S.PERIODS.items() for x in (k, b - a + 1))), F.col("period"))
    stb = frac.groupBy(rect, "period").agg(F.count_if(hit).alias("n_stb"), F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("year")))), ",").alias("stb_yrs"))
    long = dom.join(stb, [rect, "period"]).withColumn("stb_p", F.col("n_stb") / years * 100)
    return long.groupBy(rect).pivot("period", list(S.PERIODS)).agg(
        F.first("mode_id_dom").alias("md_id"), F.first("mode_id_pct").alias("md_pct"), F.first("n_stb").alias("n_stb"), F.first("stb_p").alias("stb_p"), F.first("stb_yrs").alias("stb_yrs"))


def _shares(modes: DataFrame) -> DataFrame:
    """``share_metrics`` and the share of changes, from facts about modes."""
    pct = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n") * 100
    m = F.col("k")
    return modes.groupBy("rect").agg(
        (F.sum("x_sum") / F.sum("x_n") * 100).alias("tr_pct"), pct(m.isin(*sorted(T.CRITICAL))).alias("crit_pct"), pct((m == NORTH_FOREST) & (F.col("y") == 1)).alias("nfor_pct"),
        pct(m == ACHAPARRADO).alias("achap_pct"), pct(m.isin(*sorted(T.TRANSVERSAL))).alias("tran_pct"), pct(m == NO_OBS).alias("noobs_raw_pct"))


def characterize(lulc: DataFrame, min_valid_pct: float = 20.0, drop_zero: bool = False) -> DataFrame:
    """All statistics of each rectangle that has ``min_valid_pct`` valid pixels.

    A pixel is valid with an ecoregion and a mode other than unobserved; class 0
    counts unless ``drop_zero``. The pixels are read once (``facts``); what follows
    works on a rectangle's few facts.
    """
    found = written(facts(lulc, drop_zero))
    valid = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    gate = found.where("kind = 'pixel'").groupBy("rect").agg((valid / F.sum("n") * 100).alias("val_pct")).where(F.col("val_pct") >= min_valid_pct)
    gate = written(gate)
    found = found.join(gate.select("rect"), "rect", "left_semi")
    of = lambda kind, name: found.where(F.col("kind") == kind).groupBy("rect", F.col("k").alias(name)).agg(F.sum("n").alias("n"))
    counts = of("mode", "mode_id")
    years = found.where("kind = 'year'")
    # one row: the last year of all
    latest = F.broadcast(years.agg(F.max("y").alias("_last")))
    last = years.join(latest, F.col("y") == F.col("_last")).groupBy("rect", F.col("k").alias("last_id")).agg(F.sum("n").alias("n"))
    dom = dominant(counts, ["rect"], "mode_id")
    stab = years.groupBy("rect", F.col("y").alias("year")).agg((F.sum("x_sum") / F.sum("x_n")).alias("frac"))
    shares = _shares(found.where("kind = 'mode'"))
    parts = [dom, dominant(of("eco", "eco_id"), ["rect"], "eco_id").drop("eco_id_n"), dominant(last, ["rect"], "last_id").drop("last_id_n"), shannon(counts, ["rect"]), shares.select("rect", "tr_pct"),
             stable_years(stab), longest_run(stab.withColumn("stable", F.col("frac") >= STABLE_SHARE)), shares.drop("tr_pct"), confusion_risk(counts, dom), _periods(found)]
    out = gate
    for p in parts:
        out = out.join(p, "rect")
    out = out.withColumns({
        "noobs_pct": F.lit(0.0),
        "dim_temporal": temporal_kind(F.col("tr_pct"), F.col("run"), F.col("P3_n_stb"), F.col("P4_n_stb"), F.col("tran_pct")),
        "dim_espacial": spatial_kind(F.col("mode_id_pct"), F.col("shannon"), F.col("mode_id_n")),
        "prio_sc": priority_score(F.col("val_pct"), F.col("crit_pct"), F.col("nfor_pct"), F.col("achap_pct"), F.col("mode_id_n"), F.col("shannon"), F.col("tr_pct"), F.lit(0.0)),
    })
    return out.withColumn("sample_type", F.concat_ws("_", "dim_temporal", "dim_espacial"))
