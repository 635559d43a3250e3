"""Filters, projections and small tables of plans, reports and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as T

# --- filters ---------------------------------------------------------------------


def matching(df: DataFrame, equal: dict | None = None, known=(), one_of: dict | None = None, holds: dict | None = None) -> DataFrame:
    """Rows by their metadata: equal values, known values, values in a list, texts
    that hold a part."""
    keep = F.lit(True)
    for c, v in (equal or {}).items():
        keep = keep & (F.col(c) == v)
    for c in known:
        keep = keep & F.col(c).isNotNull()
    for c, vs in (one_of or {}).items():
        keep = keep & F.col(c).isin(*vs)
    for c, part in (holds or {}).items():
        keep = keep & F.col(c).contains(part)
    return df.where(keep)


def subset(df: DataFrame, one_of: dict | None = None, most: int | None = None, most_ids: int | None = None, order=("grid_id",)) -> DataFrame:
    """Rows of the listed values; of those the first ``most_ids`` ids, and the
    first ``most`` rows in a total ``order``."""
    out = matching(df, one_of={k: v for k, v in (one_of or {}).items() if v})
    if most_ids is not None:
        out = out.join(out.select("grid_id").distinct().orderBy("grid_id").limit(most_ids), "grid_id", "left_semi")
    return out if most is None else out.orderBy(*order).limit(most)


def zone_view(df: DataFrame, utm: str, path: str = "") -> DataFrame:
    """Rows of a zone: by their column, else all if the file's name says so, else none."""
    if utm == "TOTAL":
        return df
    zone = int(utm.replace("UTM", ""))
    if "utm_zone" in df.columns:
        return df.where(F.col("utm_zone").try_cast("int") == zone)
    return df if f"UTM{zone}" in path.rsplit("/", 1)[-1].upper() else df.limit(0)


def switches(env: dict[str, str]) -> dict[str, int | bool]:
    """Limits of a trial run from environment variables; what is no number is none."""
    number = lambda k: int(v) if (v := env.get(k, "").strip()).isdigit() else 0
    return {"max_jobs": number("MAX_JOBS"), "max_rows": number("MAX_ROWS"), "dry_run": env.get("DRY_RUN", "").strip().lower() in ("1", "true", "yes")}


def limited(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows of a total order; all without a limit."""
    return df.orderBy(*order).limit(most) if most > 0 else df


def job_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("grid_name", "year", "satellite")


# --- projections -----------------------------------------------------------------

#: Bands of the reduced and the core export (fixed values).
REDUCED_BASES = ("blue", "green", "red", "nir", "swir1", "swir2", "ndvi", "ndwi")
REDUCED_STATS = ("median", "median_dry", "median_wet", "min", "max", "amp", "stdDev")


def reduced_bands() -> list[str]:
    return [f"{b}_{s}" for b in REDUCED_BASES for s in REDUCED_STATS] + ["ndvi_p25", "ndvi_p75"]


def core_bands() -> list[str]:
    return [f"{b}_median" for b in REDUCED_BASES]


def map_columns(df: DataFrame) -> DataFrame:
    """Columns that maps and reports show: texts with defaults, canonical names of
    ecoregions, the zone's name."""
    have = df.columns
    kind = next((F.col(c).cast("string") for c in ("sample_type", "sample_type_gee") if c in have), F.lit("sin_tipo"))
    out = {"sample_type": kind}
    for c in ("grid_mode", "eco_dom_name", "lulc_mode_name", "split", "clases_criticas", "target_rare_class", "parent_grid_id"):
        out[c] = F.col(c).cast("string") if c in have else F.lit("")
    if "eco_dom_id" in have:
        out["eco_dom_name"] = T.ecoregion_label(F.col("eco_dom_id"), out["eco_dom_name"])
    if "utm_zone" in have:
        out["utm"] = F.concat(F.lit("UTM"), F.coalesce(F.col("utm_zone").try_cast("int"), F.lit(0)).cast("string"))
    return df.withColumns(out)


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of tables whose columns differ; what a table lacks is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def allowed_tiles(tiles: DataFrame, masks: DataFrame, key: str = "mgrs_tile") -> DataFrame:
    return tiles.join(masks.select(key), key, "left_semi")


def period_columns(df: DataFrame, stem: str, periods=("P1", "P2", "P3", "P4")) -> Column:
    """``{stem}_{period}`` columns as a map by period."""
    return F.create_map(*(x for p in periods for x in (F.lit(p), F.col(f"{stem}_{p}"))))


# --- report tables ---------------------------------------------------------------


def kpi_row(summary: DataFrame, utm: str) -> DataFrame:
    """The zone's row of a summary, else the total's, else the first by name; the
    critical count falls back on that of stunted forest."""
    rank = F.when(F.col("utm") == utm, 0).when(F.col("utm") == "TOTAL", 1).otherwise(2)
    crit = F.coalesce("n_clases_criticas", *(["n_achaparrado"] if "n_achaparrado" in summary.columns else []), F.lit(0))
    return summary.orderBy(rank, "utm").limit(1).withColumn("n_criticas", crit.cast("long"))


def eco_pivot(df: DataFrame, column: str = "sample_type", values=None) -> DataFrame:
    """Counts of an ecoregion by the values of a column, with canonical names and a
    total column."""
    named = df.withColumn("_eco", T.ecoregion_label(F.col("eco_dom_id"), F.col("eco_dom_name")))
    wide = named.groupBy(F.col("_eco").alias("eco_dom_name")).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("TOTAL", sum((F.col(f"`{c}`") for c in wide.columns[1:]), F.lit(0)))


def labels_are_names(df: DataFrame, name: str = "eco_dom_name") -> DataFrame:
    """(ok): whether most labels of a table are ecoregions, and not land cover by mistake."""
    good = F.coalesce(F.col(name).rlike(r"^E\d+_"), F.lit(False))
    return df.agg((F.avg(good.cast("int")) >= 0.5).alias("ok"))


def in_order(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` numbered from 1 in a total order, in two steps: range partitions are
    numbered each by itself, and their sizes say where each begins. No task sees
    more than its own part."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written, so that both steps see the same parts
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from .rounds import written

    placed = written(placed)
    n = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = n.withColumn("_before", before).drop("_n")  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def named_or_default(name: Column, default: str = T.NONE) -> Column:
    """A name, or the default where it says nothing."""
    return F.when(F.lower(F.trim(name)).isin("", "nan", "none", "-9999"), default).otherwise(name)
