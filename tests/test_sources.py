import json

from landcube.sources import readers as R
from landcube.sources import sinks as W


def test_params_table_with_mark_and_aliases(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("﻿year\tGRID_NAME\tSATELLITE\tBLACKLIST\tUSETILEMASK\n2020\tA\t5\t\tTrue\n", encoding="utf-8")
    r = R.params_table(spark, str(p)).first()
    assert (r["YEAR"], r["GRID_NAME"], r["BLACK LIST"]) == ("2020", "A", None)


def test_qa_draft_shapes(spark):
    df = spark.createDataFrame([(json.dumps({"edits": {"u": {"poly_qa": "aprobado"}}, "rect_edits": {"k": {"rect_qa": "rechazado"}}}),), (json.dumps({"v": {"poly_qa": "rechazado"}}),)], "json string")
    edits, rects = R.qa_draft(df)
    assert {(r.poly_uid, r.poly_qa) for r in edits.collect()} == {("u", "aprobado"), ("v", "rechazado")} and rects.first().rect_key == "k"


def test_params_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("CHILE", "A", 2020, "l8", ["x"])], "country string, grid_name string, year int, satellite string, black_list array<string>")
    W.params_json(df, str(tmp_path / "o"))
    assert R.params_json(spark, str(tmp_path / "o")).first().black_list == ["x"]


def test_short_names():
    assert W.short_names(["target_rare_class", "target_rare_class_id"]) == {"target_rare_class": "target_rar", "target_rare_class_id": "target_r_x"}


def test_not_yet(spark):
    jobs, done = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a",)], "name string")
    assert [r.name for r in W.not_yet(jobs, done).collect()] == ["b"]


def test_discovery_and_logs(spark, tmp_path):
    from landcube.sources import readers as R
    from landcube.sources import sinks as W

    for name in ("a/2001.tif", "a/G2_2002.tif", "a/UTM18/seleccion_x.geojson", "a/UTM18/seleccion_x.gpkg", "a/UTM19/seleccion_y.csv", "a/UTM19/seleccion_taxonomia.csv"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    root = str(tmp_path / "a")
    assert R.rasters(spark, root).count() == 2
    (tmp_path / "a" / "m_classes.tif").write_text("x")
    files = R.rasters(spark, root)
    assert files.count() == 1
    plan = spark.createDataFrame([("G1", 2001), ("G2", 2002), ("G3", 2003)], "grid_id string, year int")
    got = {r.grid_id: r.path for r in R.yearly_raster(plan, R._files(spark, root, "*.tif")).collect()}
    assert got["G1"].endswith("2001.tif") and got["G2"].endswith("G2_2002.tif") and got["G3"] is None
    assert {(r.stem, r.utm, r.path[-4:]) for r in R.selections(spark, root).collect()} == {("seleccion_x", 18, "gpkg"), ("seleccion_y", 19, ".csv")}
    assert [r.utm for r in R.selections(spark, root, 18, same=False).collect()] == [19]
    jobs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1)], "name string, v int")
    one = lambda n: spark.createDataFrame([(n,)], "name string")
    assert [r.name for r in W.to_export(jobs, one("b"), one("c")).collect()] == ["a"]
    W.publish_log(jobs.limit(1), str(tmp_path / "log"))
    W.publish_log(jobs.limit(1), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    W.text_report(jobs.where("name = 'b'"), "Jobs", str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["Jobs", "name: b; v: 1"]


def test_tables(spark):
    from landcube.sources import readers as R

    t = spark.createDataFrame([("19HCC", 1), ("19HCC", 1), ("18GXN", 2)], "MGRS string, v int")
    assert sorted(r.tile_id for r in R.tiles_by_id(t).collect()) == ["18GXN", "19HCC"]
    assert [r.MGRS for r in R.tiles_of_zone(t, 18, "MGRS").collect()] == ["18GXN"]
    a = spark.createDataFrame([("G1", "E1_x")], "grid_id string, eco_dom_name string")
    b = spark.createDataFrame([("G2", 3), ("G2", 3)], "grid_id string, z int")
    assert {(r.grid_id, r.eco) for r in R.selection_tables([a, b]).collect()} == {("G1", "E1_x"), ("G2", "sin_nombre")}
    bands = spark.createDataFrame([("s", "red", "t", 0, 0, 5), ("s", "nir", "t", 0, 1, 7), ("u", "red", "t", 0, 0, 9)], "scene_id string, band string, tile string, row int, col int, value int")
    got = {(r.col): (r.red, r.nir, r.missing) for r in R.stack(spark.createDataFrame([("s",)], "scene_id string"), bands, ["red", "nir"]).collect()}
    assert got == {0: (5, 65535, ["nir"]), 1: (65535, 7, ["red"])}
    assert R.inspect(t).first().asDict() == {"rows": 3, "properties": ["MGRS", "v"]}


def test_first_name_of_a_tile_wins(spark):
    """The order of the candidates decides, not that of the columns."""
    t = spark.createDataFrame([("a", "b", "c")], "mgrs_tile string, name string, TILE_ID string")
    assert R.tile_id_field(t.columns) == "name" and R.tiles_by_id(t).first().tile_id == "b"
    assert R.tile_id_field(["MGRS", "tile_id", "Tile"]) == "Tile" and R.tile_id_field(["grid"]) is None
