"""Balancing of a selection: rare classes, quotas, fills, final labels.

Every order ends in ``grid_id``. What is ordered as a whole is bounded first, by
the number of rows asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import select as L
from .rounds import written
from .spatial import greedy_non_overlap

#: Sensor of a reference year by period, and thresholds of the types (fixed values).
REF_SENSORS = {"P1": "Landsat_5_7", "P2": "Landsat_5_7", "P3": "Landsat_8", "P4": "Landsat_8_9"}
TRANSITION_PCT, FILL_TRANSITION_PCT = 5.0, 8.0
SIMPLE_CLASSES, SIMPLE_MODE_PCT = 2, 80.0
ANNUAL_YEARS = {"homogenea": 3, "simple_media": 2}
STABLE_RUN, STABLE_MODE_PCT, STABLE_SHANNON, STABLE_TR_PCT, STABLE_YEARS_PCT = 5, 85.0, 0.3, 10.0, 60.0
MEDIUM_RUN, MEDIUM_MODE_PCT, MEDIUM_CLASSES, MEDIUM_TR_PCT = 3, (45.0, 85.0), (2, 6), 15.0
BARE, SAND, SALT, NORTH_FOREST, STUNTED = 25, 23, 61, 3, 67
MAINLAND = tuple(range(1, 16))


def _dims(df: DataFrame, kind: Column) -> DataFrame:
    """``sample_type`` and the two dimensions that its name joins."""
    return df.withColumn("sample_type", kind).withColumns({
        "dim_temporal": F.substring_index("sample_type", "_", 1), "dim_espacial": F.expr("substr(sample_type, instr(sample_type, '_') + 1)")})


def _stable_in(period: Column) -> Column:
    """Stable years of the period that ``period`` names."""
    return F.coalesce(*(F.when(period == p, F.col(f"n_stb_{p}")) for p in S.PERIODS))


def rare_type() -> Column:
    """The type that fits a rectangle of a rare class."""
    c = F.col
    pure, best = c("grid_mode") == "homogeneo", L.best_period(1)
    years = _stable_in(best)
    simple = (c("n_mode_classes") >= SIMPLE_CLASSES) & (c("lulc_mode_pct") < SIMPLE_MODE_PCT)
    steady = pure & (c("max_stab_run") >= STABLE_RUN) & (c("lulc_mode_pct") >= STABLE_MODE_PCT) & (c("shannon_idx") <= STABLE_SHANNON)
    return (
        F.when(c("transition_pct") >= TRANSITION_PCT, F.when(simple, "transicion_simple_media").otherwise("transicion_homogenea"))
        .when(pure & (years >= ANNUAL_YEARS["homogenea"]), "anual_homogenea").when(years >= ANNUAL_YEARS["simple_media"], "anual_simple_media")
        .when(steady, "estable_homogenea").otherwise("estable_simple_media"))


def rare_metadata(df: DataFrame, class_id: int, name: str, tier: int = 1) -> DataFrame:
    """Type, class and presence of rectangles picked for a rare class."""
    out = _dims(df, rare_type()).withColumns({
        "target_rare_class": F.lit(name), "target_rare_class_id": F.lit(class_id), "rare_presence_pct": L.presence_strength(class_id), "review_tier": F.lit(tier)})
    extra = {STUNTED: "achap_presence_pct", NORTH_FOREST: "north_forest_presence_pct"}.get(class_id)
    out = out if extra is None else out.withColumn(extra, F.col("rare_presence_pct"))
    return out.withColumn("target_rare_class_source", F.lit("north_forest_pct")) if class_id == NORTH_FOREST else out


def rare_order(class_id: int, score: str) -> list[Column]:
    """Desert ecoregions break ties of sand and salt; northern forest goes by presence."""
    if class_id in (SAND, SALT):
        return [F.desc(score), F.desc(F.col("eco_dom_id").isin(2, 4)), F.col("grid_id")]
    first = [F.desc(L.presence_strength(class_id))] if class_id == NORTH_FOREST else []
    return [*first, F.desc(score), F.col("grid_id")]


def pick_rare(pool: DataFrame, class_id: int, name: str, score: str, per_eco: int, most: int, tier: int = 1) -> DataFrame:
    """At most ``most`` rectangles where the class is present: the first
    ``per_eco`` of each ecoregion, then whatever comes next."""
    order = rare_order(class_id, score)
    have = pool.where(L.class_present(class_id))
    n = F.row_number().over(Window.partitionBy("eco_dom_id").orderBy(*order))
    got = have.withColumn("_late", n > per_eco).orderBy("_late", *order).limit(most).drop("_late")
    return rare_metadata(got, class_id, name, tier)


def pick_exclusive(df: DataFrame, rare: list[tuple], types: list[tuple], cell: float | None = None) -> DataFrame:
    """Rare classes (id, name, score, per ecoregion, most), then types (type, pool
    flag, score, per ecoregion, most), in turn; a rectangle is picked once. With
    ``cell`` also none that overlaps one picked before it, by boxes x0..y1."""
    picked = None

    def free() -> DataFrame:
        if picked is None:
            return df
        out = df.join(picked.select("grid_id"), "grid_id", "left_anti")
        if cell is not None:
            from .spatial import previous_overlap

            out = previous_overlap(out, picked.select("grid_id", "x0", "y0", "x1", "y1"), cell).drop("ovlp_m2", "ovlp_pct")
        return out

    def apart(got: DataFrame, order: list) -> DataFrame:
        return got if cell is None else greedy_non_overlap(got, cell, order)

    for class_id, name, score, per_eco, most in rare:
        got = apart(pick_rare(free(), class_id, name, score, per_eco, most), rare_order(class_id, score))
        got = written(got.select(*df.columns, F.lit(name).alias("picked_type")))  # a turn's few rows, or each later turn would pick them again
        picked = got if picked is None else picked.unionByName(got)
    for kind, flag, score, per_eco, most in types:
        got = L.top_per_group(free().where(F.col(flag)), ["eco_dom_id"], score, per_eco)
        got = got.withColumn("_r", F.row_number().over(Window.partitionBy("mgrs_dom").orderBy(F.desc(score), "grid_id")))
        got = apart(got.orderBy("_r", F.desc(score), "grid_id").limit(most), ["_r", F.desc(score), "grid_id"]).drop("_r")
        got = written(got.select(*df.columns, F.lit(kind).alias("picked_type")))
        picked = got if picked is None else picked.unionByName(got)
    return picked


def temporal_bucket() -> Column:
    return F.when(F.col("transition_pct") >= FILL_TRANSITION_PCT, "transicion").when(L.best_period(2).isNotNull(), "anual").otherwise("estable")


def fill_type() -> Column:
    """The type of a rectangle that fills a gap."""
    pure, mixed, bucket = F.col("grid_mode") == "homogeneo", F.col("grid_mode") == "mixto", temporal_bucket()
    return (F.when(bucket == "transicion", "transicion_simple_media").when(bucket == "anual", F.when(mixed, "anual_simple_media").otherwise("anual_homogenea"))
            .otherwise(F.when(pure, "estable_homogenea").otherwise("estable_simple_media")))


def _open(selected: DataFrame, candidates: DataFrame, ecos=MAINLAND) -> DataFrame:
    free = candidates.join(selected.select("grid_id"), "grid_id", "left_anti")
    return L.block_water(L.block_desert(free)).where(F.col("eco_dom_id").isin(*ecos))


def _filled(df: DataFrame, kind: Column) -> DataFrame:
    return _dims(df, kind).withColumns({"target_rare_class": F.lit(""), "target_rare_class_id": F.lit(-9999), "review_tier": F.lit(2)})


def fill_quotas(selected: DataFrame, candidates: DataFrame, per_eco: int, priority, most: int, score: str = "sc_e_h", ecos=MAINLAND) -> DataFrame:
    """Candidates that raise each ecoregion to ``per_eco``, at most ``most`` in
    all; ecoregions of ``priority`` first, then the emptiest. In an ecoregion those
    with a temporal kind that it lacks come first (2), then a new modal class (1),
    bare ground last (-1), new tiles and mixed grids before others."""
    have = selected.groupBy("eco_dom_id").agg(F.count("*").alias("_have"), F.collect_set("dim_temporal").alias("_kinds"), F.collect_set("lulc_mode_id").alias("_modes"), F.collect_set(F.trim("mgrs_dom")).alias("_tiles"))
    pool = _open(selected, candidates, ecos).join(have, "eco_dom_id", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    lacks = lambda known, value: ~F.coalesce(F.array_contains(known, value), F.lit(False))
    new = lambda known, value: lacks(F.col(known), value).cast("int")
    prio = 2 * new("_kinds", temporal_bucket()) + new("_modes", F.col("lulc_mode_id")) - (F.col("lulc_mode_id") == BARE).cast("int")
    order = [F.desc("_prio"), F.desc(new("_tiles", F.trim("mgrs_dom"))), F.desc(F.coalesce(F.col("grid_mode") == "mixto", F.lit(False))), F.desc(score), "grid_id"]
    ranked = pool.withColumn("_prio", prio).withColumn("_n", F.row_number().over(Window.partitionBy("eco_dom_id").orderBy(*order))).where(F.col("_n") <= per_eco - F.col("_have"))
    # a row for each ecoregion: how many the ones before it have taken
    share = ranked.groupBy("eco_dom_id").agg(F.count("*").alias("_take"), F.first("_have").alias("_h"))
    turn = Window.orderBy((~F.col("eco_dom_id").isin(*priority)).cast("int"), "_h", "eco_dom_id").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumn("_before", F.coalesce(F.sum("_take").over(turn), F.lit(0))).select("eco_dom_id", "_before")
    got = ranked.join(share, "eco_dom_id").where(F.col("_n") + F.col("_before") <= most)
    kind = F.concat(temporal_bucket(), F.lit("_simple_media"))
    return _filled(got.drop("_have", "_kinds", "_modes", "_tiles", "_prio", "_n", "_before"), kind)


def fill_to_target(selected: DataFrame, candidates: DataFrame, target: int, score: str = "sc_e_s", ecos=MAINLAND) -> DataFrame:
    """Candidates that fill the selection up to ``target``: tiles in turn, by score."""
    free = _open(selected, candidates, ecos)
    turn = free.withColumn("_r", F.row_number().over(Window.partitionBy("mgrs_dom").orderBy(F.desc(score), "grid_id")))
    order = ["_r", F.desc(score), "grid_id"]
    some = turn.orderBy(*order).limit(target).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # of at most ``target`` rows
    have = selected.agg(F.count("*").alias("_have"))
    got = some.join(F.broadcast(have), F.lit(True)).where(F.col("_n") <= target - F.col("_have"))
    return _filled(got.drop("_r", "_n", "_have"), fill_type())


def promoted() -> Column:
    """The stable type that a rectangle reaches, or NULL."""
    c = F.col
    pure = (c("grid_mode") == "homogeneo") & (c("max_stab_run") >= STABLE_RUN) & (c("lulc_mode_pct") >= STABLE_MODE_PCT) & (c("transition_pct") <= STABLE_TR_PCT) & (c("shannon_idx") <= STABLE_SHANNON)
    low, high = MEDIUM_MODE_PCT
    medium = (c("max_stab_run") >= MEDIUM_RUN) & (c("lulc_mode_pct") >= low) & (c("lulc_mode_pct") < high) & c("n_mode_classes").between(*MEDIUM_CLASSES) & (c("transition_pct") <= MEDIUM_TR_PCT)
    return F.when(pure, "estable_homogenea").when(medium, "estable_simple_media")


def reference_years(df: DataFrame, years: str = "years", by: str = "utm") -> DataFrame:
    """``ref_year``, ``ref_period`` and ``ref_sensor`` of annual rectangles: of its
    stable ``years`` each takes the one least used so far in its zone, ties by the
    sum of its id's characters; without any, -9999. Others have no reference.

    Each choice depends on all before it, in order of id: a zone's annual rectangles
    stream through one task, sorted by Spark, which keeps the uses of each year alone."""
    kept = [c for c in df.columns if c not in ("ref_year", "ref_period", "ref_sensor")]
    kinds = dict(df.dtypes)

    def run(batches):
        zone, used = None, {}
        for b in batches:
            out = []
            for now, grid_id, own in zip(b.column(by).to_pylist(), b.column("grid_id").to_pylist(), b.column(years).to_pylist()):
                if now != zone:
                    zone, used = now, {}
                own, year = sorted(set(int(y) for y in own)), -9999
                if own and not used:
                    year = own[-1]
                elif own:
                    low = min(used.get(y, 0) for y in own)
                    best = [y for y in own if used.get(y, 0) == low]
                    year = best[sum(map(ord, grid_id)) % len(best)]
                if year > 0:
                    used[year] = used.get(year, 0) + 1
                out.append(year)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "ref_year"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", ref_year int"
    chosen = F.coalesce((F.col("dim_temporal") == "anual") & F.col(years).isNotNull() & (F.size(years) > 0), F.lit(False))
    some = df.select(*kept).where(chosen).repartition(by).sortWithinPartitions(by, "grid_id")
    out = some.mapInArrow(run, schema).unionByName(df.select(*kept).where(~chosen).withColumn("ref_year", F.lit(-9999)))
    period = S.period_of(F.col("ref_year"))
    return out.withColumns({"ref_period": F.coalesce(period, F.lit("")), "ref_sensor": F.coalesce(*(F.when(period == p, s) for p, s in REF_SENSORS.items()), F.lit(""))})


def final_labels(df: DataFrame, years: str = "years", by: str = "utm") -> DataFrame:
    """Annual rectangles that are stable by every measure become stable; of the
    others each takes a reference year, or becomes stable, or goes."""
    c = F.col
    sure = (c("sample_type") == "anual_homogenea") & (c("max_stab_run") >= STABLE_RUN) & (c("lulc_mode_pct") >= STABLE_MODE_PCT) & (c("transition_pct") <= STABLE_TR_PCT) & (c("stable_yr_pct") >= STABLE_YEARS_PCT)
    out = reference_years(_dims(df, F.when(sure, "estable_homogenea").otherwise(c("sample_type"))), years, by)
    without = (c("dim_temporal") == "anual") & (c("ref_year") <= 0)
    out = out.withColumn("_p", F.when(without, promoted())).where(~without | c("_p").isNotNull())
    return _dims(out, F.coalesce("_p", "sample_type")).drop("_p")


# --- joins of plans --------------------------------------------------------------


def plan_with_selection(plan: DataFrame, selection: DataFrame, key: str = "grid_id") -> DataFrame:
    """Inner join on the key; columns of both get ``_plan`` and ``_sel``."""
    both = (set(plan.columns) & set(selection.columns)) - {key}
    mark = lambda df, end: df.select(*(F.col(c).alias(c + end if c in both else c) for c in df.columns))
    return mark(plan, "_plan").join(mark(selection, "_sel"), key)


def with_zone(df: DataFrame, zones: DataFrame, strict: bool = True, key: str = "grid_id", zone: str = "utm_zone") -> DataFrame:
    """``df`` with each id's zone. Ids without one are an error that the job raises
    when it meets them, or go if not ``strict``."""
    out = df.join(zones.select(key, zone), key, "left" if strict else "inner")
    if not strict:
        return out
    fault = F.raise_error(F.concat(F.lit("no zone for "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    return out.withColumn(zone, F.when(F.col(zone).isNull(), fault.cast("string")).otherwise(F.col(zone).cast("string")))


def with_geometry(plan: DataFrame, rects: DataFrame, key: str = "grid_id") -> DataFrame:
    return plan.join(rects.select(key), key, "left_semi")


def review_queue(df: DataFrame) -> DataFrame:
    """``place`` by priority, tier, homogeneous first, id."""
    from .views import in_order

    return in_order(df, ["review_priority", "review_tier", (~F.coalesce(F.col("dim_espacial") == "homogenea", F.lit(False))).cast("int"), "grid_id"])
