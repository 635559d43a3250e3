"""SQL functions against column expressions; small library functions; report readers."""

import pytest
from landcube.functions import indices as X
from landcube.functions import sql as Q
from landcube.functions import taxonomy as T  # noqa: F401  the package imports as a whole
from landcube.operators import diagnostics as D
from landcube.operators import labels as B
from landcube.operators import params as P
from landcube.operators import select as L
from landcube.operators import spatial as G
from landcube.functions import masks as M
from landcube.sources import readers as R
from landcube.sources import sinks as W
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2", "tir")


@pytest.fixture(scope="module")
def scene(spark):
    rows = [(0.1, 0.2, 0.3, 0.4, 0.25, 0.15, 290.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (None, 0.2, None, 0.4, 0.25, None, 290.0), (0.9, 0.01, 0.7, -0.7, 0.3, 0.6, 1.0)]
    return spark.createDataFrame(rows, ", ".join(f"{b} double" for b in BANDS))


def test_sql_indices_equal_expressions(spark, scene):
    assert set(Q.INDICES) == set(X.INDICES)
    names = Q.register(spark)
    assert len(names) == len(Q.INDICES) + len(Q.SCALARS) + len(Q.TABLES) and Q.register(spark) == names
    made = spark.sql("select " + ", ".join(f"lc_{n}({', '.join(bands.split())}) as {n}" for n, (bands, _) in Q.INDICES.items()) + " from {s}", s=scene)
    for n in Q.INDICES:
        assert X.INDICES[n][1] == tuple(Q.INDICES[n][0].split())
    want = scene.select(*(f(*map(F.col, bands)).alias(n) for n, (f, bands) in X.INDICES.items()))
    assert [r.asDict() for r in made.collect()] == [r.asDict() for r in want.select(*made.columns).collect()]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lc_" not in plan  # inlined


def test_other_sql_functions(spark):
    Q.register(spark)
    r = spark.sql("select lc_sr_scale(10000) a, lc_reflectance(60000) b, lc_reflectance(0) c, lc_qa_clear(8, 3, 4) d, lc_qa_clear(0, 3, 4) e, lc_period(2013) f, lc_period(1990) g, lc_safe_pct(1, 0) h, lc_safe_pct(1, 4) i").first()
    assert abs(r.a - 750) < 1e-9 and (r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (1.0, 0.0, False, True, "P3", None, 0.0, 25.0)
    tiles = spark.createDataFrame([("t", 0.0, 0.0, 50000.0, 40000.0), ("u", 5.0, 5.0, 23765.0, 23765.0)], "tile string, x0 double, y0 double, x1 double, y1 double")
    got = spark.sql("select tile, s.* from {t}, lateral lc_rectangles(x0, y0, x1, y1, 15840.0D, 0.99D) s", t=tiles)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.rectangles(tiles, side=2).select("tile", "col", "row", "rx0", "ry0", "rx1", "ry1").collect())) != []


def test_collections(spark):
    s = spark.createDataFrame([("a", 1, 1, 5.0), ("b", 1, 1, None), ("c", 1, 1, 5.0), ("d", 2, 1, None), ("e", None, 1, 1.0)], "scene_id string, wrs_path int, wrs_row int, cloud_cover double")
    assert sorted(map(tuple, D.path_rows(s).collect())) == [(1, 1), (2, 1)]
    assert {r.scene_id for r in D.clearest_each(s).collect()} == {"a", "d", "e"}
    both = D.merged(s.where("scene_id = 'a'"), s.where("scene_id in ('a', 'b')").drop("cloud_cover"))
    assert both.columns == s.columns and sorted((r.scene_id, r.cloud_cover) for r in both.collect() if r.scene_id == "b") == [("b", None)] and both.count() == 3
    px = spark.createDataFrame([("t", 59, 900.0), ("t", 59, 900.0), ("t", 0, 900.0), ("t", None, 1.0)], "tile string, class_id int, m2 double")
    assert [tuple(r) for r in D.class_areas(px).collect()] == [("t", 59, 0.18)]


def test_masks_picks_and_lists(spark):
    px = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31)], "px int, v int")
    mask = spark.createDataFrame([(1, 1), (2, 0), (3, 5), (3, 5)], "px int, mask int")
    assert sorted(r.v for r in M.tile_mask(px, mask, ["px"]).collect()) == [10, 30, 31]
    assert sorted(r.v for r in M.tile_mask(px, mask.select("px"), ["px"]).collect()) == [10, 20, 30, 31]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "grid_id string")
    assert sorted(r.grid_id for r in L.remaining(ids("a", "b", "c", "d"), ids("a", "a"), ids("c")).collect()) == ["b", "d"] and L.remaining(ids("a")).count() == 1
    jobs = spark.createDataFrame([(1, ["b", "a"]), (1, ["b", "c"]), (2, []), (3, None)], "k int, black_list array<string>")
    assert {r.k: r.black_list for r in P.united_black_lists(jobs, ["k"]).collect()} == {1: ["a", "b", "c"], 2: [], 3: []}


def test_overwritten_properties(spark):
    df = spark.createDataFrame([("a", "x", 1, "n"), ("b", "y", 2, "n")], "poly_uid string, poly_qa string, corr_id int, note string")
    edits = spark.createDataFrame([("a", "aprobado", None, "?"), ("z", "rechazado", 3, "?")], "poly_uid string, poly_qa string, corr_id int, other string")
    assert sorted(map(tuple, B.overwritten(df, edits).collect())) == [("a", "aprobado", 1, "n"), ("b", "y", 2, "n")]


def test_quality_report(spark, tmp_path):
    """Two header lines and one of index names; an empty metric repeats the one before."""
    p = tmp_path / "09_calidad_por_tipo.csv"
    p.write_text("﻿utm,tipo_muestra,valid_pct,,noobs,\n,,mean,std,mean,std\nutm,tipo_muestra,,,,\nUTM18,anual,80.5,1,3,0\nUTM19,estable,x,2,4.25,0\n", encoding="utf-8")
    out = R.quality_report(spark, str(p))
    assert out.columns == ["utm", "tipo_muestra", "valid_pct", "noobs"]
    assert sorted(map(tuple, out.collect())) == [("UTM18", "anual", 80.5, 3.0), ("UTM19", "estable", None, 4.25)]
    assert R.quality_report(spark, str(p), "UTM19").count() == 1


def test_paths_and_clips(spark, tmp_path):
    df = spark.createDataFrame([("19H/a\\b", 2020)], "g string, y int")
    assert tuple(df.select(*W.label_paths(F.col("g"), F.col("y"), "/out/")).first()) == ("/out/raster/classes/19H_a_b_2020_classes.tif", "/out/raster/labels/19H_a_b_2020_labels.tif")
    assert W.output_paths("anual", "/l/", utm="UTM18") == {"folder": "/l/anual/UTM18", "gpkg": "/l/anual/UTM18/subdivisiones_C2_anual.gpkg", "layer": "subdivisiones_C2_anual", "summary": "/l/anual/UTM18/resumen_C2_anual.csv"}
    assert W.output_paths("anual", "/l", product="p", layer="x") == {"folder": "/l", "gpkg": "/l/p.gpkg", "layer": "x", "summary": "/l/resumen_p.csv"}
    assert (W.asset_id("g", "b/"), W.asset_id("g", "b", product="p"), W.asset_id("g", "b", asset="a")) == ("b/g/subdivisiones_C2_g", "b/p", "a")
    assert W.output_paths("g", "/l", gpkg="/o/own.gpkg", product="p") == {"folder": "/o", "gpkg": "/o/own.gpkg", "layer": "own", "summary": "/o/resumen_own.csv"}
    assert W.output_paths("g", "/l", gpkg="/o/own.gpkg", layer="x", summary="/s.csv") == {"folder": "/o", "gpkg": "/o/own.gpkg", "layer": "x", "summary": "/s.csv"}
    assert W.output_paths("g", "/l", layer="x")["layer"] == "subdivisiones_C2_g" and W.output_paths("g", "/l", utm="UTM19", product="p")["gpkg"] == "/l/UTM19/p.gpkg"
    assert (W.asset_features("g", "/l/"), W.asset_features("g", "/l", product="p"), W.asset_features("g", "/l", path="f")) == ("/l/SAMPLES_SSL4EO/g/subdivisiones_C2_g.geojson", "/l/p.geojson", "f")
    for n in ("2020.tif", "R1_2020.tif", "R2_2020.tif", "R1_2021.tif", "R1_2020.txt"):
        (tmp_path / n).write_bytes(b"")
    files = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    assert W.legacy_clips(files, 2020).count() == 2 and W.remove_legacy_clips(str(tmp_path), 2020) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2020.tif", "R1_2020.txt", "R1_2021.tif"]
