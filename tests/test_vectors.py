"""Vector files: round trips, windows, parts."""

import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from landcube.sources import vector_files as V
from pyarrow import fs as pafs
from pyspark.sql import functions as F

SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[2.0, 2.0], [2.0, 4.0], [4.0, 4.0], [4.0, 2.0], [2.0, 2.0]]]
FAR = [[[100.0, 100.0], [103.0, 100.0], [100.0, 104.0], [100.0, 100.0]]]
ROWS = [([SQUARE], 1, "a,é", 0.5, True), ([SQUARE, FAR], 1 << 60, 'quote "x"', None, False), ([FAR], None, None, float("nan"), None), (None, 4, "no place", 1.0, True)]
SCHEMA = f"parts {V.PARTS}, k long, note string, v double, ok boolean"


def test_wkb_of_many_kinds():
    for kind, parts in ((3, [SQUARE]), (6, [SQUARE, FAR]), (6, [])):
        assert V.read_wkb(V.write_wkb(parts))[:2] == (kind, parts)
    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    assert V.read_wkb(point) == (1, [[[[3.0, 4.0]]]], 21) and V.read_wkb(struct.pack(">BIdd", 0, 1, 3.0, 4.0))[1] == [[[[3.0, 4.0]]]]
    assert V.read_wkb(struct.pack("<BIdd", 1, 1, float("nan"), float("nan")))[1] == []
    for head, extra in ((1001, 1), (2001, 1), (3001, 2), (0x80000001, 1), (0xC0000001, 2)):  # heights and measures are left out
        assert V.read_wkb(struct.pack(f"<BI{2 + extra}d", 1, head, 3.0, 4.0, *[9.0] * extra))[1] == [[[[3.0, 4.0]]]]
    assert V.read_wkb(struct.pack("<BIIdd", 1, 0x20000001, 4326, 3.0, 4.0))[1] == [[[[3.0, 4.0]]]]
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 1.0, 1.0)
    assert V.read_wkb(struct.pack("<BII", 1, 5, 2) + line * 2)[1] == [[[[0.0, 0.0], [1.0, 1.0]]]] * 2
    with pytest.raises(ValueError):
        V.read_wkb(struct.pack("<BII", 1, 7, 0))
    assert V.read_geometry(V.write_geometry([SQUARE], 32719)) == (32719, 3, [SQUARE]) and V.read_geometry(V.write_geometry([], 5))[2] == []


def test_gpkg_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("list", F.array(F.lit(1), F.col("k")))
    V.write_gpkg(df, str(tmp_path), "zones", 32719)
    back = V.read_gpkg(spark, str(tmp_path))
    assert back.columns == ["fid", "k", "note", "v", "ok", "list", "kind", "epsg", "x0", "y0", "x1", "y1", "parts"]
    got = {r.note: r for r in back.collect()}
    assert got["a,é"].parts == [SQUARE] and got['quote "x"'].parts == [SQUARE, FAR] and got[None].parts == [FAR] and got["no place"].parts is None
    assert [got[n].k for n in ("a,é", 'quote "x"', None)] == [1, 1 << 60, None] and got[None].v is None and got["a,é"].ok is True and got['quote "x"'].ok is False
    assert (got['quote "x"'].kind, got["a,é"].kind, got["a,é"].epsg) == ("MultiPolygon", "Polygon", 32719)
    assert (got['quote "x"'].x0, got['quote "x"'].y1) == (0.0, 104.0) and json.loads(got["a,é"].list) == [1, 1]
    one = V.single_parts(back)
    assert sorted((r.note or "", r.part) for r in one.collect()) == [("", 0), ("a,é", 0), ('quote "x"', 0), ('quote "x"', 1)]
    assert {r.note: r.a for r in back.select("note", V.area(F.col("parts")).alias("a")).collect()} == {"a,é": 96.0, 'quote "x"': 102.0, None: 6.0, "no place": None}
    # other readers see a database of the standard's tables
    db = sqlite3.connect(tmp_path / "zones.gpkg")
    assert db.execute("pragma application_id").fetchone()[0] == 0x47504B47 and db.execute("select min_x, max_y, srs_id from gpkg_contents").fetchone() == (0.0, 104.0, 32719)
    assert db.execute("pragma integrity_check").fetchone()[0] == "ok" and db.execute("select count(*) from rtree_zones_geom").fetchone()[0] == 3


def squares(spark, n=400):
    at = lambda k: ((k % 20) * 10.0, (k // 20) * 10.0)
    return spark.createDataFrame([(k, f"z{k % 2}", *at(k)) for k in range(n)], "k int, zone string, x double, y double").select("k", "zone", V.rectangle(F.col("x"), F.col("y"), F.col("x") + 5, F.col("y") + 5).alias("parts"))


def test_a_box_reads_fewer_rows(spark, tmp_path):
    V.write_gpkg(squares(spark), str(tmp_path), "s", 32719)
    box = (31.0, 42.0, 52.0, 55.0)
    rows = V.read_gpkg(spark, str(tmp_path), box=box)
    meets = lambda k: (k % 20) * 10 + 5 >= 31 and (k % 20) * 10 <= 52 and (k // 20) * 10 + 5 >= 42 and (k // 20) * 10 <= 55
    assert {r.k for r in rows.collect()} == {k for k in range(400) if meets(k)}
    store = pafs.LocalFileSystem()
    with V.connect(store, str(tmp_path / "s.gpkg")) as db:
        layer = V.layer_of(db, None)
        assert layer.index == "rtree_s_geom"
    # all other geometries are broken, and no one notices
    with sqlite3.connect(tmp_path / "s.gpkg") as db:
        keep = [r[0] for r in db.execute("select id from rtree_s_geom where maxx >= 31 and minx <= 52 and maxy >= 42 and miny <= 55")]
        assert len(keep) == 6
        db.execute(f"update s set geom = x'00' where fid not in ({','.join(map(str, keep))})")
    assert V.read_gpkg(spark, str(tmp_path), box=box).count() == 6
    with pytest.raises(Exception, match="not a GeoPackage geometry"):
        V.read_gpkg(spark, str(tmp_path)).count()


def test_many_files_tasks_and_layers(spark, tmp_path):
    V.write_gpkg(squares(spark), str(tmp_path / "o"), "s", 32719, name="zone", max_rows=60)
    names = sorted(p.name for p in (tmp_path / "o").iterdir())
    assert names == sorted(f"z{i}-{k}.gpkg" for i in (0, 1) for k in range(4))
    back = V.read_gpkg(spark, str(tmp_path / "o"), layer="s", rows_per_task=10)
    assert sorted(r.k for r in back.collect()) == list(range(400)) and back.rdd.getNumPartitions() > 20
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.write(tmp_path / "o" / names[0], "inner.gpkg")
    assert V.read_gpkg(spark, str(tmp_path / "one.zip")).count() == V.read_gpkg(spark, str(tmp_path / "o" / names[0])).count() > 0
    with pytest.raises(Exception, match="no layer"):
        V.read_gpkg(spark, str(tmp_path / "o"), layer="other").count()
    V.write_gpkg(squares(spark).limit(0), str(tmp_path / "none"), "s", 32719)
    assert not list((tmp_path / "none").glob("*.gpkg"))


def test_geojson_and_csv(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    V.write_geojson(df, str(tmp_path / "g"))
    text = json.loads((tmp_path / "g" / "features.geojson").read_text(encoding="utf-8"))
    by = {f["properties"]["note"]: f for f in text["features"]}
    assert len(by) == 4 and by["a,é"]["geometry"] == {"type": "Polygon", "coordinates": SQUARE} and by['quote "x"']["geometry"] == {"type": "MultiPolygon", "coordinates": [SQUARE, FAR]}
    assert by["no place"]["geometry"] is None and by["a,é"]["properties"]["ok"] is True and by[None]["properties"]["k"] is None
    V.write_geojson(df.limit(0), str(tmp_path / "g"), file="none")
    assert json.loads((tmp_path / "g" / "none.geojson").read_text()) == {"type": "FeatureCollection", "features": []}
    V.write_csv(df.select("k", "note"), str(tmp_path / "c"), "plan", ["k"])
    assert (tmp_path / "c" / "plan.csv").read_bytes() == "﻿k,note\n,\n1,\"a,é\"\n4,no place\n1152921504606846976,\"quote \\\"x\\\"\"".encode()
    V.write_csv(df.select("k").limit(0), str(tmp_path / "c"), "empty", ["k"])
    assert (tmp_path / "c" / "empty.csv").read_bytes() == b""


def test_random_geometries(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [([[[[float(x) for x in p] for p in rng.normal(size=(rng.integers(3, 9), 2)) * 1e6] for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 4))], k) for k in range(60)]
    V.write_gpkg(spark.createDataFrame(rows, f"parts {V.PARTS}, k int"), str(tmp_path), "r", 4326)
    assert {r.k: r.parts for r in V.read_gpkg(spark, str(tmp_path)).collect()} == {k: p for p, k in rows}
