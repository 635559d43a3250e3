"""Job parameters: normalisation, grid-to-grid expansion, yearly satellites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def normalize(df: DataFrame, country: str = "CHILE", cloud_cover: int = 80, mask_default: bool = True, unknown_mask: bool | None = None) -> DataFrame:
    """Spreadsheet rows to job rows; rows without year, grid or valid satellite go.

    ``df(YEAR, GRID_NAME, SATELLITE, BLACK LIST, USETILEMASK)``, all text or numbers.
    """
    year = S.safe_int(F.col("YEAR"))
    out = df.select(
        F.lit(country).alias("country"), F.trim("GRID_NAME").alias("grid_name"), year.alias("year"), S.satellite(F.col("SATELLITE")).alias("satellite"),
        F.concat(year.cast("string"), F.lit("-01-01")).alias("t0_s"),
        F.concat(year.cast("string"), F.lit("-12-31")).alias("t1_s"), F.lit(cloud_cover).alias("cloud_cover"),
        S.split_list(F.col("`BLACK LIST`")).alias("black_list"), S.parse_bool(F.col("USETILEMASK"), mask_default, unknown_mask).alias("use_tile_mask"))
    return out.where((F.col("year") != -9999) & (F.col("grid_name") != "") & F.col("satellite").isNotNull())


def skipped(df: DataFrame) -> DataFrame:
    """Rows that have year and grid but no valid satellite."""
    return df.where((S.safe_int(F.col("YEAR")) != -9999) & (F.trim("GRID_NAME") != "") & S.satellite(F.col("SATELLITE")).isNull() & (F.trim(F.col("SATELLITE").cast("string")) != ""))


def summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct("GRID_NAME").alias("grids"), F.min(S.safe_int(F.col("YEAR"))).alias("years_min"),
        F.max(S.safe_int(F.col("YEAR"))).alias("years_max"), F.count("`BLACK LIST`").alias("black_list_rows"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last of the input order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def united_black_lists(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, black_list): the sorted union of the black lists of rows that share the
    keys; a scene counts once, map side, before a key's are gathered."""
    rows = jobs.select(*keys, F.explode_outer("black_list").alias("_scene"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("_scene")).alias("black_list"))


def expand(jobs: DataFrame, xwalk: DataFrame, min_frac: float = 0.0) -> DataFrame:
    """One job row becomes a row for each tile that its grid overlaps by
    ``min_frac`` or more; rows that meet on (tile, year, satellite) become one,
    with the union of their black lists and the names of their grids."""
    pairs = xwalk.where(F.coalesce(S.number(F.col("overlap_frac_of_cim")), F.lit(0.0)) >= min_frac).select(F.trim("cim_name").alias("cim_name"), F.trim("mgrs_tile").alias("mgrs_tile")).where("cim_name != '' and mgrs_tile != ''").distinct()
    met = jobs.withColumn("cim_name", F.trim("grid_name")).drop("grid_name").join(pairs, "cim_name")
    rest = [c for c in jobs.columns if c not in ("grid_name", "year", "satellite", "black_list")]
    # each scene of a black list counts once, map side, before a key's are gathered
    met = met.withColumn("_scene", F.explode_outer("black_list"))
    return met.groupBy(F.col("mgrs_tile").alias("grid_name"), "year", "satellite").agg(
        F.array_sort(F.collect_set("_scene")).alias("black_list"),
        F.array_join(F.array_sort(F.collect_set("cim_name")), ",").alias("cim_name"),
        *(F.min_by(c, "cim_name").alias(c) for c in rest))


def unmatched(jobs: DataFrame, xwalk: DataFrame, min_frac: float = 0.0) -> DataFrame:
    pairs = xwalk.where(F.coalesce(S.number(F.col("overlap_frac_of_cim")), F.lit(0.0)) >= min_frac).select(F.trim("cim_name").alias("grid_name"))
    return jobs.select(F.trim("grid_name").alias("grid_name")).distinct().join(pairs, "grid_name", "left_anti")


def satellite_for_year(jobs: DataFrame) -> DataFrame:
    """(year, satellite): the most frequent of the year, the lowest name of equals."""
    n = jobs.groupBy("year", "satellite").count()
    return n.groupBy("year").agg(F.min_by("satellite", F.struct(-F.col("count"), F.col("satellite"))).alias("satellite"))


def tile_jobs(jobs: DataFrame, tiles: DataFrame, mgrs_to_cim: DataFrame, country: str = "CHILE") -> DataFrame:
    """Tiles times years: each with its year's satellite and the black lists that
    the tile's grids have for both, in order of grid and place."""
    listed = (
        mgrs_to_cim.join(jobs.select(F.col("grid_name").alias("cim_name"), "year", "satellite", F.posexplode("black_list").alias("pos", "scene")), "cim_name")
        .groupBy("mgrs_tile", "year", "satellite", "scene").agg(F.min(F.struct("cim_name", "pos")).alias("at"))
        .groupBy("mgrs_tile", "year", "satellite").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "scene"))), lambda r: r["scene"]).alias("black_list")))
    years = satellite_for_year(jobs)
    # every tile meets every year: a stated, complete plan of tiles x years rows
    plan = tiles.select("mgrs_tile", "crs").join(F.broadcast(years), F.lit(True))
    return plan.join(listed, ["mgrs_tile", "year", "satellite"], "left").select(
        F.lit(country).alias("country"), F.col("mgrs_tile").alias("grid_name"), "year", "satellite", F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("t0_s"),
        F.concat(F.col("year").cast("string"), F.lit("-12-31")).alias("t1_s"), F.lit(80).alias("cloud_cover"), F.coalesce("black_list", F.array().cast("array<string>")).alias("black_list"),
        F.lit(False).alias("use_tile_mask"), "crs", F.lit("MGRS").alias("grid_type"))


def guard(jobs: DataFrame, strict: bool = True) -> DataFrame:
    """Year and sensor have to agree: strict drops, lax marks."""
    ok = F.array_contains(S.sensors_allowed(F.col("year")), F.col("satellite"))
    return jobs.where(ok) if strict else jobs.withColumn("sensor_ok", ok)


def exclusions(meta: DataFrame) -> DataFrame:
    """Scene ids that earlier mosaics excluded, from their joined lists."""
    return meta.select(F.explode(F.split("black_list", ",")).alias("scene_id")).where("scene_id != ''").distinct()
