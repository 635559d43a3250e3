import numpy as np
import pytest
from landcube.functions import unmix as U
from landcube.operators import composite as C
from landcube.operators import diagnostics as D
from landcube.operators import raster as R
from landcube.operators import spatial as G
from pyspark.sql import functions as F


def test_unmix_weights():
    w = U.weights(U.ENDMEMBERS)
    assert w["gv"][0] == pytest.approx(-3.6560734071e-05, rel=1e-9) and w["cloud"][5] == pytest.approx(-4.6274083888e-05, rel=1e-9)


def test_profile_counts():
    p = C.chile_profile()
    kinds = list(p.values())
    assert len(p) == 184
    assert {k: kinds.count(k) for k in set(kinds)} == {"uint16": 73, "uint8": 71, "int32": 31, "int16": 8, "uint32": 1}


def test_typed_clamps(spark):
    df = spark.createDataFrame([(300.7,), (-5.2,), (None,), (12.9,)], "v double")
    assert [r[0] for r in df.select(C.typed(F.col("v"), "uint8")).collect()] == [255, 0, None, 12]


def grid(spark, a):
    return spark.createDataFrame([("t", i, j, int(v)) for i, r in enumerate(a) for j, v in enumerate(r)], "tile string, row int, col int, value int")


def test_slope_of_a_plane(spark):
    a = [[60 * j + 30 * i for j in range(5)] for i in range(5)]
    r = R.terrain(grid(spark, a).withColumnRenamed("value", "elev")).where("row = 2 and col = 2").first()
    assert r.slope == int(np.degrees(np.arctan(np.hypot(2, 1))) * 100)


def test_tpi_of_a_plane_is_zero_inside(spark):
    a = [[2 * j + 3 * i for j in range(13)] for i in range(13)]
    assert R.tpi(grid(spark, a).withColumnRenamed("value", "elev")).where("row = 6 and col = 6").first().tpi == 0


def test_focal_with_gaps(spark):
    df = grid(spark, [[1, 2, 3], [4, 5, 6]]).where("not (row = 1 and col = 2)")
    r = R.focal(df, "value", 2, gaps=True).where("row = 0 and col = 2").first()
    assert r.value_mean == 3.0


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(-70.66, -33.45), (-69.0, -18.0), (-72.5, -50.0)], "lon double, lat double")
    x, y = G.to_utm(F.col("lon"), F.col("lat"), F.lit(19))
    lon, lat = G.from_utm(x, y, F.lit(19))
    for r in df.select("lon", "lat", x.alias("x"), lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.a - r.lon) < 1e-7 and abs(r.b - r.lat) < 1e-7
    assert abs(df.limit(1).select(x.alias("x")).first().x - 345732) < 300


def test_greedy_matches_a_scan(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i:03d}", float(s), float(x), float(y), float(x + 9), float(y + 9)) for i, (s, x, y) in enumerate(zip(rng.permutation(60), rng.uniform(0, 60, 60), rng.uniform(0, 60, 60)))]
    kept = []
    for r in sorted(rows, key=lambda r: -r[1]):
        if all(max(0, min(r[4], k[4]) - max(r[2], k[2])) * max(0, min(r[5], k[5]) - max(r[3], k[3])) <= 1 for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "grid_id string, s double, x0 double, y0 double, x1 double, y1 double")
    assert {r.grid_id for r in G.greedy_non_overlap(df, 20.0, [F.desc("s")]).collect()} == {k[0] for k in kept}


def test_sensor_shift_delta(spark):
    df = spark.createDataFrame([(1, 2010, "l7", 10.0), (1, 2015, "l8", 5.0), (2, 2010, "l5", 0.0), (2, 2015, "l9", 5.0)], "sample_id int, year int, sensor string, value double")
    out = {r.sample_id: r.delta_pct for r in D.sensor_shift(df).collect()}
    assert out == {1: -50.0, 2: None}
