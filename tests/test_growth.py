"""Steps whose cost must grow no faster than their input: by their plans, and results by plain loops."""

import numpy as np
from landcube.operators import balance as A
from landcube.operators import raster as R
from landcube.operators import spatial as S
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_broadcast_to_their_boxes(spark):
    from landcube.plans import registry

    sf = "/root/testdata/sf0.001"
    assert "Join" not in plan(registry.queries()["geo_07_random_points"](spark, sf))
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 2.0), ("b", 5.0, 5.0, 6.0, 7.0)], "key string, x0 double, y0 double, x1 double, y1 double")
    for holds in (None, F.col("x") - F.col("x0") < 0.5):
        kept = S.random_points(boxes, 20, 3, holds, keep=("x0", "y1")).collect()
        assert [(r.key, r.k, r.x, r.y) for r in sorted(kept)] == sorted(tuple(r) for r in S.random_points(boxes, 20, 3, holds).collect())
        assert len(kept) == 40 and {(r.key, r.x0, r.y1) for r in kept} == {("a", 0.0, 2.0), ("b", 5.0, 7.0)}


def test_reference_years_stream(spark):
    rows = [(f"G{i * 37 % 500}", ("U1", "U2", None)[i % 3], ("anual", "estable", "anual", None)[i % 4], None if i % 11 == 0 else [] if i % 7 == 0 else [1999 + i % 5, 1999 + i % 26], i) for i in range(500)]
    df = spark.createDataFrame(rows, "grid_id string, utm string, dim_temporal string, years array<int>, i int")
    out = A.reference_years(df)
    assert "FlatMapGroupsInPandas" not in plan(out)  # a zone is not held by one call
    want, used = {}, {}
    for grid_id, zone, kind, own, i in sorted(rows, key=lambda r: r[0]):
        own, seen, year = sorted(set(own)) if kind == "anual" and own else [], used.setdefault(zone, {}), -9999
        if own and not seen:
            year = own[-1]
        elif own:
            low = min(seen.get(y, 0) for y in own)
            best = [y for y in own if seen.get(y, 0) == low]
            year = best[sum(map(ord, grid_id)) % len(best)]
        if year > 0:
            seen[year] = seen.get(year, 0) + 1
        want[i] = year
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.i: r.ref_year for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)


def test_patches_are_ringed_many_at_a_time(spark):
    grid = np.random.default_rng(4).integers(0, 3, (12, 12))
    df = spark.createDataFrame([("t", r, c, int(grid[r, c])) for r in range(12) for c in range(12)], "tile string, row int, col int, value int")
    out = R.polygonize(df, connectivity=4, block=5)
    assert plan(out).count("FlatMapGroupsInPandas") == 1  # blocks alone, not patches
    key = lambda r: (r.patch_id, r.class_id, r.n_pixels, r.rings)
    assert sorted(map(key, out.collect())) == sorted(map(key, R.polygonize(df, connectivity=4, block=50).collect()))


def test_vectors_are_not_broadcast(spark):
    """Copies take little room in files, and much in memory."""
    from landcube.llm import norm_topk as N

    rng = np.random.default_rng(1)
    few = [rng.standard_normal(16).tolist() for _ in range(8)]
    df = spark.createDataFrame([(i, few[i % 8]) for i in range(3_000)], "vec_id long, embedding array<double>")
    p = N.Params(bucket_rows=100, block_rows=8)
    out = N.top_k(df, p)
    text = plan(out)
    assert text.count("SortMergeJoin") >= 3
    x = np.floor(np.array(few) * 256).astype(np.int64)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 3_000, 50):
        want = sorted(((-int(x[q % 8] @ x[i % 8]), i) for i in range(3_000) if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_areas_are_rounded_once_for_equal_boxes(spark):
    """Rows that lie alike have the areas of their pairs rounded before the rows are paired."""
    from landcube.plans import registry

    tree = registry.queries()["jon_02_geo_09_box_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    rounded, paired = ([k for k, x in enumerate(tree) if what in x] for what in ("round(", "Generate explode(_a_rows"))
    assert rounded and paired and min(rounded) > max(paired)
    a = spark.createDataFrame([(i, float(i % 3), 0.0, i % 3 + 1.00000049, 1.0) for i in range(40)], "i long, x0 double, y0 double, x1 double, y1 double")
    out = S.overlaps(a.withColumnRenamed("i", "a_id"), a.withColumnRenamed("i", "b_id"), 10.0, 6).collect()
    met = [(i, j, 1.0 if i % 3 == j % 3 else 0.0) for i in range(40) for j in range(40) if abs(i % 3 - j % 3) <= 1]
    assert sorted((r.a_id, r.b_id, r.inter_area) for r in out) == met
