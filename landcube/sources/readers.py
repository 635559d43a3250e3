"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

TSV_ALIASES = {
    "YEAR": ("YEAR", "year", "ANIO"), "GRID_NAME": ("GRID_NAME", "grid_name", "CARTA"), "SATELLITE": ("SATELLITE", "satellite"),
    "BLACK LIST": ("BLACK LIST", "BLACKLIST", "black_list"), "USETILEMASK": ("USETILEMASK", "use_tile_mask"),
}
XWALK = "cim_name string, mgrs_tile string, overlap_m2 string, cim_area_m2 string, mgrs_area_m2 string, overlap_frac_of_cim string, overlap_frac_of_mgrs string, mgrs_rank_by_cim_overlap string, cim_mgrs_relation string"
#: Properties that may name a tile, the first present one first (fixed values).
TILE_ID_FIELDS = ("name", "Name", "tile", "Tile", "id", "ID", "TILE_ID", "tile_id", "MGRS_TILE", "mgrs_tile", "MGRS", "mgrs")


def _no_mark(df: DataFrame) -> DataFrame:
    """Column names without a byte-order mark and outer blanks."""
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def require(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def params_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Parameter rows of a TSV or CSV export, all text, with the known aliases."""
    raw = _no_mark(spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path))
    out = {}
    for name, aliases in TSV_ALIASES.items():
        have = [F.col(f"`{a}`") for a in aliases if a in raw.columns]
        if not have:
            raise ValueError(f"missing column: {name}")
        out[name] = S.first_of(*have)
    return raw.select(*(c.alias(n) for n, c in out.items()))


def params_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "country string, grid_name string, year int, satellite string, t0_s string, t1_s string, cloud_cover int, black_list array<string>, use_tile_mask boolean, crs string, grid_type string, cim_name string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def crosswalk_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(XWALK).option("header", True).csv(path)


def plan_csv(spark: SparkSession, path: str, required=("grid_id", "review_years")) -> DataFrame:
    df = require(_no_mark(spark.read.option("header", True).csv(path)), required)
    return df if "target_rare_class" in df.columns else df.withColumn("target_rare_class", F.lit(""))


#: Collection of each satellite (fixed values).
COLLECTIONS = {
    "l4": "LANDSAT/LT04/C02/T1_L2", "l5": "LANDSAT/LT05/C02/T1_L2", "l7": "LANDSAT/LE07/C02/T1_L2", "l8": "LANDSAT/LC08/C02/T1_L2", "l9": "LANDSAT/LC09/C02/T1_L2",
}


def collection(satellite: F.Column) -> F.Column:
    """The collection that a satellite's scenes are in; NULL for others."""
    return F.coalesce(*(F.when(F.lower(satellite) == k, v) for k, v in COLLECTIONS.items()))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """Paths of class rasters below ``path``: those of the preferred name, or all if
    there is none. Decided by the job, from one listing."""
    found = _files(spark, path, "*.tif*").withColumn("_best", F.col("path").endswith("_classes.tif"))
    any_ = found.agg(F.coalesce(F.bool_or("_best"), F.lit(False)).alias("_any"))
    return found.join(F.broadcast(any_), F.lit(True)).where(F.col("_best") | ~F.col("_any")).drop("_best", "_any")


def selections(spark: SparkSession, path: str, zone: int | None = None, same: bool = True) -> DataFrame:
    """(path, stem, utm): selection files below ``path``, no taxonomies, one for each
    stem (GPKG before GeoJSON before CSV); of a zone, or of all others."""
    name = F.element_at(F.split("path", "/"), -1)
    out = _files(spark, path, "seleccion_*").select("path", name.alias("_n")).where(~F.col("_n").contains("taxonomia"))
    kind = F.lower(F.element_at(F.split("_n", r"\."), -1))
    out = out.withColumns({"stem": F.regexp_replace("_n", r"\.[^.]*$", ""), "utm": S.utm_of_path(F.col("path")), "_k": F.when(kind == "gpkg", 0).when(kind == "geojson", 1).otherwise(2)})
    if zone is not None:
        out = out.where(F.col("utm") == zone if same else F.col("utm") != zone)
    return out.groupBy("stem", "utm").agg(F.min_by("path", F.struct("_k", "path")).alias("path")).select("path", "stem", "utm")


def pixels(spark: SparkSession, path: str, nodata: int | None = None) -> DataFrame:
    """A class map written as rows (tile, row, col, value[, nodata]); the file's own
    nodata value comes before the given one, and 0 before nothing. Nodata is NULL."""
    raw = spark.read.parquet(path)
    own = F.coalesce(*([F.col("nodata")] if "nodata" in raw.columns else []), F.lit(nodata), F.lit(0))
    return raw.withColumn("value", F.when(F.col("value") != own, F.col("value"))).drop("nodata")


def stack(scenes: DataFrame, bands: DataFrame, wanted, nodata: int = 65535) -> DataFrame:
    """Every wanted band of every scene's pixels: ``bands(scene_id, band, tile, row,
    col, value)``. A band that a scene lacks is nodata, and ``missing`` says so."""
    grid = bands.select("scene_id", "tile", "row", "col").distinct().join(scenes.select("scene_id"), "scene_id", "left_semi")
    wide = bands.groupBy("scene_id", "tile", "row", "col").pivot("band", list(wanted)).agg(F.first("value"))
    out = grid.join(wide, ["scene_id", "tile", "row", "col"], "left")
    lost = F.array_compact(F.array(*(F.when(F.col(b).isNull(), F.lit(b)) for b in wanted)))
    return out.withColumn("missing", lost).withColumns({b: F.coalesce(b, F.lit(nodata)) for b in wanted})


def yearly_raster(plan: DataFrame, files: DataFrame) -> DataFrame:
    """``plan(grid_id, year)`` with the path of its year's map ``{year}.tif``, else of
    its own ``{grid_id}_{year}.tif``; NULL if there is neither."""
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tiff?$", "").alias("_stem"), "path")
    year, own = F.col("year").cast("string"), F.concat_ws("_", "grid_id", F.col("year").cast("string"))
    out = plan.withColumns({"_y": year, "_g": own})
    out = out.join(named.select(F.col("_stem").alias("_y"), F.col("path").alias("_py")), "_y", "left").join(named.select(F.col("_stem").alias("_g"), F.col("path").alias("_pg")), "_g", "left")
    return out.withColumn("path", F.coalesce("_py", "_pg")).drop("_y", "_g", "_py", "_pg")


def tiles_of_zone(tiles: DataFrame, zone: int, name: str = "tile") -> DataFrame:
    """Tiles whose name begins with the zone's number."""
    return tiles.where(F.substring(name, 1, 2).try_cast("int") == zone)


def rectangle_zones(*frames: DataFrame) -> DataFrame:
    """Rectangles of several zone files as one table, the first of each id by zone."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return drop_repeated(out, "grid_id", ["utm_zone"])


def report(spark: SparkSession, zone_path: str | None, total_path: str, utm: str, schema: str) -> DataFrame:
    """A report's rows: of the zone's file if there is one, else those of the total
    file that are the zone's."""
    read = spark.read.schema(schema).option("header", True)
    return read.csv(zone_path) if zone_path else read.csv(total_path).where(F.col("utm") == utm)


def pivot_rows(df: DataFrame, key: str) -> DataFrame:
    """A pivot without its total row and column."""
    return df.where(F.col(key) != "TOTAL").drop("TOTAL")


def means_only(df: DataFrame, keys) -> DataFrame:
    """Keys and the columns ``*_mean`` under their plain names."""
    return df.select(*keys, *(F.col(c).alias(c.removesuffix("_mean")) for c in df.columns if c.endswith("_mean")))


def quality_report(spark: SparkSession, path: str, utm: str | None = None) -> DataFrame:
    """Means of a quality report whose first two lines are its header: names of metrics,
    each over its statistics (an empty name repeats the one before), then a line of
    index names. Numbers that are none are NULL; of one zone, if ``utm`` is given."""
    text = spark.read.option("encoding", "UTF-8").csv(path)
    # the driver sees the header alone
    first, second = (list(r) for r in text.limit(2).collect())
    names, metric = [], ""
    for i, (m, stat) in enumerate(zip(first, second)):
        metric = (m or metric).lstrip("\ufeff").strip()
        names.append(("utm", "tipo_muestra")[i] if i < 2 else f"{metric}_{(stat or '').strip()}")
    means = [(c, n.removesuffix("_mean")) for c, n in zip(text.columns, names) if n.endswith("_mean")]
    utm_col, kind = (F.col(c) for c in text.columns[:2])
    head = utm_col.eqNullSafe(F.lit(first[0])) & kind.eqNullSafe(F.lit(first[1]))
    rows = text.where(~head & kind.isNotNull() & (utm_col != "utm"))
    out = rows.select(utm_col.alias("utm"), kind.alias("tipo_muestra"), *(F.col(c).try_cast("double").alias(n) for c, n in means))
    return out if utm is None else out.where(F.col("utm") == utm)


def inspect(df: DataFrame) -> DataFrame:
    """One row: rows, and the names of the properties."""
    return df.agg(F.count("*").alias("rows")).withColumn("properties", F.array(*map(F.lit, sorted(df.columns))))


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON features: their properties by ``properties`` (DDL) and the geometry as text."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"), F.lit(None).cast("string").alias("_")).drop("_")


def qa_draft(df: DataFrame, text: str = "json") -> tuple[DataFrame, DataFrame]:
    """Polygon and rectangle edits of draft documents; a bare map of edits is a
    draft too."""
    edit = "struct<poly_qa: string, qa_scope: string, corr_id: int, err_type: string, poly_note: string, qa_user: string, qa_date: string>"
    rect = "struct<rect_qa: string, rect_note: string, qa_user: string, qa_date: string>"
    whole = F.from_json(text, f"edits map<string, {edit}>, rect_edits map<string, {rect}>")
    bare = F.from_json(text, f"map<string, {edit}>")
    edits = df.select(F.explode(F.coalesce(whole["edits"], F.when(F.get_json_object(text, "$.edits").isNull() & F.get_json_object(text, "$.rect_edits").isNull(), bare))).alias("poly_uid", "e")).select("poly_uid", "e.*")
    rects = df.select(F.explode(whole["rect_edits"]).alias("rect_key", "e")).select("rect_key", "e.*")
    return edits, rects


def tile_id_field(columns) -> str | None:
    return next((c for c in TILE_ID_FIELDS if c in columns), None)


def tiles_by_id(df: DataFrame, fallback: str = "id") -> DataFrame:
    """``tile_id`` from the first field that may name a tile, else from ``fallback``;
    one row for each."""
    out = df.withColumn("tile_id", F.col(tile_id_field(df.columns) or fallback).cast("string"))
    return drop_repeated(out, "tile_id", [F.to_json(F.struct(*df.columns))])


def selection_tables(frames, ecoregion=("eco_dom_name", "eco_dom_nm", "ecoregion")) -> DataFrame:
    """Selection tables as one, with ``eco`` from the first known column, one row an id."""
    out = None
    for f in frames:
        have = [F.col(c) for c in ecoregion if c in f.columns]
        f = f.withColumn("eco", F.coalesce(*have, F.lit("sin_nombre")))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return drop_repeated(out, "grid_id", [F.to_json(F.struct(*out.columns))])


def missing_inputs(plan: DataFrame, rects: DataFrame, years: DataFrame) -> DataFrame:
    """(problem, key): plan ids without geometry, planned years without a map."""
    a = plan.join(rects, "grid_id", "left_anti").select(F.lit("geometry").alias("problem"), F.col("grid_id").cast("string").alias("key"))
    want = plan.select(F.explode(S.year_list(F.col("review_years"))).alias("year")).distinct()
    return a.unionByName(want.join(years, "year", "left_anti").select(F.lit("year").alias("problem"), F.col("year").cast("string").alias("key"))).distinct()


def drop_repeated(df: DataFrame, key: str, order: list) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
