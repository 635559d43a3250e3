"""Labels end to end; balanced picks."""

import numpy as np
from pyspark.sql import functions as F


def test_polygons_and_rasters(spark, tmp_path):
    from landcube.operators import generate as G

    grid = np.array([[59, 59, 0, 66], [59, 66, 66, 66], [33, 33, 59, 0]])
    rows = [("R1", 2020, r, c, int(grid[r, c])) for r in range(3) for c in range(4)] + [("R2", 2020, 0, 0, 59)]
    px = spark.createDataFrame(rows, "grid_id string, rev_year int, row int, col int, class_id int")
    plan = spark.createDataFrame([("R1", 2020, "anual", 2, "2020"), ("R9", 2020, "anual", 2, "2020")], "grid_id string, review_year int, dim_temporal string, review_tier int, review_years string")
    out = {(r.class_id, r.patch_id): r for r in G.polygons(px, plan).collect()}
    assert {k: r.n_pixels for k, r in out.items()} == {(59, 1): 3, (59, 2): 1, (66, 1): 4, (33, 1): 2}
    one = out[59, 1]
    assert one.pct_rect == 25.0 and one.dim_temp == "anual" and one.rev_tier == 2 and one.poly_uid == "R1|2020|59|1" and one.class_nm == "Bosque_primario"
    assert {(r.class_id, r.n_pixels) for r in G.polygons(px, plan, min_patch_ha=0.2).collect()} == {(59, 3), (66, 4)}
    path = str(tmp_path / "rasters")
    G.write_rasters(G.rasters(px, min_pixels=2), path)
    back = spark.read.parquet(path)
    assert back.where("grid_id = 'R1'").count() == 12 and back.where("patch = 0").count() == 4  # two of nodata, two patches of one pixel


def test_overlaps_are_excluded(spark):
    from landcube.operators import balance as A

    rows = [(f"G{i}", 1, "T1", float(i * 5), 0.0, float(i * 5 + 8), 8.0, float(i), True) for i in range(6)]
    df = spark.createDataFrame(rows, "grid_id string, eco_dom_id int, mgrs_dom string, x0 double, y0 double, x1 double, y1 double, s double, p boolean")
    got = A.pick_exclusive(df, [], [("a", "p", "s", 10, 10), ("b", "p", "s", 10, 10)], cell=20.0)
    assert {(r.grid_id, r.picked_type) for r in got.collect()} == {("G5", "a"), ("G3", "a"), ("G1", "a")}


def test_tile_box(spark):
    from landcube.operators import spatial as S

    r = S.tile_box(spark.createDataFrame([("19HCC",)], "tile string")).first()
    # easting 300 to 400 km, northing 6,200 to 6,300 km of the southern zone 19
    assert abs(r.west + 71.18) < 0.05 and abs(r.south + 34.32) < 0.05 and abs(r.east + 70.08) < 0.05 and abs(r.north + 33.43) < 0.05


def test_points(spark):
    from landcube.operators import spatial as S

    boxes = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0)], "key string, x0 double, y0 double, x1 double, y1 double")
    got = S.random_points(boxes, 4, 3, F.col("x") > F.col("y"), tries=50).collect()
    assert len(got) == 4 and all(r.x > r.y for r in got) and got == S.random_points(boxes, 4, 3, F.col("x") > F.col("y"), tries=50).collect()
