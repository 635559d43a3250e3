"""Writers; repeated runs skip what a manifest already lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mosaic_name(territory: str = "territory", version: str = "1", suffix: str = "") -> F.Column:
    return F.concat_ws("-", F.lit("TMP"), territory, "grid_name", F.col("year").cast("string"), F.upper("satellite"), F.lit(version)) if not suffix else F.concat(
        F.concat_ws("-", F.lit("TMP"), territory, "grid_name", F.col("year").cast("string"), F.upper("satellite"), F.lit(version)), F.lit(suffix))


def not_yet(jobs: DataFrame, manifest: DataFrame, key: str = "name") -> DataFrame:
    """Jobs that no manifest row names."""
    return jobs.join(manifest.select(key).distinct(), key, "left_anti")


def to_export(jobs: DataFrame, stored: DataFrame, queued: DataFrame | None = None, key: str = "name") -> DataFrame:
    """Jobs that are neither stored nor queued, one for each name."""
    out = not_yet(jobs, stored, key)
    out = out if queued is None else not_yet(out, queued, key)
    first = F.to_json(F.struct(*jobs.columns))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(first))).where("_n = 1").drop("_n")


def publish_log(df: DataFrame, path: str) -> None:
    """Appends rows of what was published, with the time."""
    df.withColumn("published_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").option("header", True).csv(path)


def text_report(df: DataFrame, title: str, path: str) -> None:
    """A small table as lines of text below a title: ``name: value`` by column."""
    line = F.concat_ws("; ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns))
    head = df.sparkSession.createDataFrame([(0, title)], "at int, value string")
    body = df.select(F.lit(1).alias("at"), line.alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at", "value").select("value").write.mode("overwrite").text(path)


def mosaic(df: DataFrame, path: str, by=("territory", "grid_name", "year")) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def params_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sanitize(df: DataFrame, skip=()) -> DataFrame:
    """For export: booleans as 0 and 1, NaN as NULL, nested values as text."""
    out = {}
    for c, k in df.dtypes:
        if c in skip:
            continue
        if k == "boolean":
            out[c] = F.col(c).cast("int")
        elif k in ("double", "float"):
            out[c] = F.when(~F.isnan(c), F.col(c))
        elif k.startswith(("array", "map", "struct")):
            out[c] = F.to_json(c)
    return df.withColumns(out) if out else df


def short_names(columns: list[str], limit: int = 10) -> dict[str, str]:
    """Unique names of at most ``limit`` characters; a name taken is cut and
    marked, one that stays too long is an error."""
    out, taken = {}, set()
    for c in columns:
        n = c[:limit]
        if n in taken:
            n = c[: limit - 2] + "_x"
        if n in taken or len(n) > limit:
            raise ValueError(f"no short name for {c}")
        taken.add(n)
        out[c] = n
    return out


def safe_file_name(grid_id: F.Column) -> F.Column:
    """A rectangle's id without separators of paths."""
    return F.regexp_replace(grid_id, r"[/\\\\]", "_")


def label_paths(grid_id: F.Column, year: F.Column, base: str) -> tuple[F.Column, F.Column]:
    """Paths of a rectangle-year's class raster and patch raster."""
    stem = F.concat_ws("_", safe_file_name(grid_id), year.cast("string"))
    at = lambda kind: F.concat(F.lit(f"{base.rstrip('/')}/raster/{kind}/"), stem, F.lit(f"_{kind}.tif"))
    return at("classes"), at("labels")


#: Beginnings of a group's names (fixed values).
GROUP_STEM, GROUP_SUMMARY, GROUP_FOLDER = "subdivisiones_C2_", "resumen_C2_", "SAMPLES_SSL4EO"


def output_paths(group: str, base: str, product: str | None = None, utm: str | None = None, layer: str | None = None, gpkg: str | None = None, summary: str | None = None) -> dict[str, str]:
    """Folder, GeoPackage, layer and summary of labels: of a file that is named, else of
    a product, else of a group, whose names are its own. Products and groups have a
    folder for each zone, if one is given."""
    base = base.rstrip("/")
    if gpkg:
        folder, _, file = gpkg.rpartition("/")
        stem = file.rsplit(".", 1)[0]
        report = f"{folder}/resumen_{stem}.csv" if folder else f"resumen_{stem}.csv"
        return {"folder": folder, "gpkg": gpkg, "layer": layer or stem, "summary": summary or report}
    folder = "/".join(x for x in (base, None if product else group, utm) if x)
    if product:
        return {"folder": folder, "gpkg": f"{folder}/{product}.gpkg", "layer": layer or product, "summary": f"{folder}/resumen_{product}.csv"}
    stem = GROUP_STEM + group
    return {"folder": folder, "gpkg": f"{folder}/{stem}.gpkg", "layer": stem, "summary": f"{folder}/{GROUP_SUMMARY}{group}.csv"}


def asset_id(group: str, base: str, asset: str | None = None, product: str | None = None) -> str:
    """The asset's own id, else that of the product, else that of the group."""
    return asset or f"{base.rstrip('/')}/{product or f'{group}/{GROUP_STEM}{group}'}"


def asset_features(group: str, base: str, path: str | None = None, product: str | None = None) -> str:
    """Path of the GeoJSON that an asset is made of, by the same order."""
    base = base.rstrip("/")
    return path or (f"{base}/{product}.geojson" if product else f"{base}/{GROUP_FOLDER}/{group}/{GROUP_STEM}{group}.geojson")


def legacy_clips(files: DataFrame, year: int) -> DataFrame:
    """Of ``files(path)`` the clips ``*_{year}.tif`` of single rectangles that a mosaic
    ``{year}.tif`` replaces."""
    return files.where(F.element_at(F.split("path", "/"), -1).rlike(rf".*_{year}\.tif$"))


def remove_legacy_clips(path: str, year: int) -> int:
    """Delete those clips in a folder; how many they were."""
    from .file_sink import list_files, open_uri

    store, at = open_uri(path)
    old = [p for p, _ in list_files(path, (f"_{year}.tif",)) if p.rsplit("/", 1)[0] == at.rstrip("/")]
    for p in old:
        store.delete_file(p)
    return len(old)
