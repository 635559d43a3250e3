"""Polygon overlaps, unions and points against brute force."""

import numpy as np
import pytest
from landcube.operators import labels as B
from landcube.operators import objects as O
from landcube.operators import polygons as P
from landcube.operators import raster as R
from landcube.operators import spatial as S
from landcube.sources.vector_files import PARTS
from pyspark.sql import functions as F


def star(rng, cx, cy, size, n, hole=False):
    """A star-shaped ring around a centre, perhaps with a hole."""
    t = (np.arange(n) + 0.8 * rng.random(n)) / n * 2 * np.pi
    r = size * (0.4 + 0.6 * rng.random(n))
    ring = [[float(cx + a * np.cos(b)), float(cy + a * np.sin(b))] for a, b in zip(r, t)]
    rings = [ring + ring[:1]]
    if hole:
        rings.append([[cx + 0.1 * size * x, cy + 0.1 * size * y] for x, y in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))])
    return rings


def inside(parts, x, y):
    odd = np.zeros(x.shape, bool)
    for part in parts:
        for ring in part:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if y0 != y1:
                    odd ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0))
    return odd


def shapes(seed, n, spread):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        parts = [star(rng, *(float(v) for v in rng.random(2) * spread), 12.0 + 20 * rng.random(), int(rng.integers(8, 16)), k % 2 == 0)]
        if k % 5 == 0:
            parts.append(star(rng, *(float(v) for v in rng.random(2) * spread + 200), 10.0, 8))
        out.append((k, parts))
    return out


@pytest.mark.parametrize("cell", [7.0, 40.0, 1000.0])
def test_overlaps_against_a_raster(spark, cell):
    a, b = shapes(1, 14, 100), shapes(2, 14, 100)
    step = 0.125
    y, x = np.meshgrid(np.arange(-40, 340, step) + step / 2, np.arange(-40, 340, step) + step / 2, indexing="ij")
    masks = {("a", k): inside(p, x, y) for k, p in a} | {("b", k): inside(p, x, y) for k, p in b}
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} int, parts {PARTS}")
    got = {(r.a_id, r.b_id): r for r in P.overlaps(df(a, "a_id"), df(b, "b_id"), cell).collect()}
    for i, _ in a:
        for j, _ in b:
            want = (masks["a", i] & masks["b", j]).sum() * step * step
            r = got.pop((i, j), None)
            assert abs((r.inter_area if r else 0.0) - want) <= 0.02 * want + 1.5
            if r:
                assert abs(r.a_area - masks["a", i].sum() * step * step) < 3 and abs(r.b_area - masks["b", j].sum() * step * step) < 3
    assert not got


def test_cell_size_changes_nothing(spark):
    a = shapes(3, 12, 80)
    df = spark.createDataFrame(a, f"k int, parts {PARTS}")
    one = {(r.a_id, r.b_id): r.inter_area for r in P.self_overlaps(df, "k", 10_000.0).collect()}
    for cell in (5.0, 33.0):
        other = {(r.a_id, r.b_id): r.inter_area for r in P.self_overlaps(df, "k", cell).collect()}
        assert other.keys() == one.keys() and all(abs(other[k] - v) < 1e-6 for k, v in one.items())
    assert len(one) > 5 and all(i < j for i, j in one)


def test_boxes_as_polygons(spark):
    """Boxes and their polygons give the same crosswalk; borders share nothing."""
    rng = np.random.default_rng(5)
    rows = [(f"C{k}", float(x), float(y), float(x + 10), float(y + 10)) for k, (x, y) in enumerate(rng.integers(0, 60, (30, 2)))]
    cim = spark.createDataFrame(rows, "cim_name string, x0 double, y0 double, x1 double, y1 double")
    tiles = spark.createDataFrame([(f"T{i}{j}", i * 20.0, j * 20.0, i * 20.0 + 20, j * 20.0 + 20) for i in range(4) for j in range(4)], "mgrs_tile string, x0 double, y0 double, x1 double, y1 double")
    parts = P.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    boxes = S.crosswalk(cim, tiles, 15.0)
    shapes_ = S.crosswalk(cim.withColumn("parts", parts), tiles.withColumn("parts", parts), 15.0)
    assert boxes.columns == shapes_.columns and sorted(map(tuple, boxes.collect())) == sorted(map(tuple, shapes_.collect()))
    c, t = (d.select(F.col(d.columns[0]).alias("grid_id"), "x0", "y0", "x1", "y1", parts.alias("parts")) for d in (cim, tiles.where("mgrs_tile = 'T11'")))
    same = lambda d: sorted((r.grid_id, r.ovlp_m2, r.ovlp_pct) for r in d.collect())
    assert same(S.previous_overlap(c, t, 15.0)) == same(S.previous_overlap(c.drop("parts"), t.drop("parts"), 15.0)) != []


def test_empty_and_degenerate(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[[[0.0, 0.0], [1.0, 1.0]]]]), (5, [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]]]), (6, [[[[0.0, 0.0], [0.0, 5.0], [0.0, 9.0], [0.0, 0.0]]]])], f"k int, parts {PARTS}")
    assert P.pieces(df, "k", 2.0).select("k").distinct().collect()[0].k == 5 and P.self_overlaps(df, "k", 2.0).count() == 0
    assert P.overlaps(df.limit(0).withColumnRenamed("k", "a_id"), df.withColumnRenamed("k", "b_id"), 2.0).count() == 0


def test_union_of_patches(spark):
    """The union's rings are those of the united pixels."""
    rng = np.random.default_rng(8)
    rows = [(t, r, c, int(v)) for t in "ab" for r in range(24) for c in range(30) if (v := rng.integers(0, 5)) > 0]
    df = spark.createDataFrame(rows, "tile string, row int, col int, value int")
    group = F.when(F.col("value") <= 2, 1).otherwise(2)
    patches = R.polygonize(df, connectivity=4, block=9).withColumn("g", F.when(F.col("class_id") <= 2, 1).otherwise(2)).withColumn("area_ha", F.col("n_pixels") * 0.09)
    got = {(r.tile, r.g): r for r in B.dissolve(patches, ["tile", "g"]).collect()}
    united = R.polygonize(df.withColumn("value", group), connectivity=4).groupBy("tile", "class_id").agg(F.sort_array(F.flatten(F.collect_list("rings"))).alias("rings"), F.sum("n_pixels").alias("n"))
    for r in united.collect():
        have = got.pop((r.tile, r.class_id))
        assert sorted(have.rings) == sorted(r.rings) and abs(have.area_ha - r.n * 0.09) < 1e-9
        assert sum(O.ring_area([tuple(p) for p in x]) for x in have.rings) == r.n
    assert not got


def greedy(boxes, tolerance=1.0):
    kept = []
    for b in boxes:
        if all((min(b[2], k[2]) - max(b[0], k[0])) <= 0 or (min(b[3], k[3]) - max(b[1], k[1])) <= 0 or (min(b[2], k[2]) - max(b[0], k[0])) * (min(b[3], k[3]) - max(b[1], k[1])) <= tolerance for k in kept):
            kept.append(b)
    return kept


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    from landcube.operators import rounds

    n, count = 10_000, [0]
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 6.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 6.0 + 10).alias("x1"), F.lit(10.0).alias("y1"))
    real = rounds.written

    def counting(d):
        count[0] += 1
        return real(d)

    monkeypatch.setattr(rounds, "written", counting)
    got = {r.k for r in S.greedy_non_overlap(df, 20.0, ["k"]).collect()}
    assert got == set(range(0, n, 2)) and count[0] <= 2 + 10 * 4  # under ten rounds of four tables


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_the_scan(spark, seed):
    rng = np.random.default_rng(seed)
    boxes = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(*rng.integers(0, 300, (2, 500)), *rng.integers(4, 40, (2, 500)))]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "k int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(r.k for r in S.greedy_non_overlap(df, 20.0, ["k"]).collect())
    want = greedy(boxes)
    assert [boxes[k] for k in got] == want and 20 < len(want) < 480


@pytest.mark.parametrize("block", [1024, 6])
def test_entropy_of_blocks(spark, block):
    rng = np.random.default_rng(6)
    g = rng.integers(0, 4, (17, 15)).astype(float)
    g[rng.random(g.shape) < 0.2] = np.nan
    g[:6, :6] = np.nan
    rows = [("t", r - 2, c, None if np.isnan(g[r, c]) else int(g[r, c])) for r in range(17) for c in range(15)]
    out = R.entropy(spark.createDataFrame(rows, "tile string, row int, col int, value int"), "value", 2, block=block).collect()
    assert len(out) == len(rows)
    for x in out:
        r, c = x.row + 2, x.col
        v = g[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].ravel()
        v = v[~np.isnan(v)]
        if len(v):
            p = np.unique(v, return_counts=True)[1] / len(v)
            assert abs(x.value_entropy + 100 * (p * np.log2(p)).sum()) < 1e-9
        else:
            assert x.value_entropy is None


def test_points_in_polygons(spark):
    """A thin polygon takes more draws, others do not; the same for a seed."""
    thin = [[[[0.0, 0.0], [100.0, 99.0], [100.0, 100.0], [0.0, 0.0]]]]
    wide = [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]]]
    df = spark.createDataFrame([("thin", 0.0, 0.0, 100.0, 100.0, thin), ("wide", 0.0, 0.0, 10.0, 10.0, wide), ("none", 0.0, 0.0, 1.0, 1.0, [])], f"key string, x0 double, y0 double, x1 double, y1 double, parts {PARTS}")
    holds = P.contains(F.col("parts"), F.col("x"), F.col("y"))
    got = S.random_points(df, 20, 5, holds, tries=600).collect()
    assert got == S.random_points(df, 20, 5, holds, tries=600).collect()
    by = {k: [r for r in got if r.key == k] for k in ("thin", "wide", "none")}
    assert len(by["thin"]) == len(by["wide"]) == 20 and not by["none"]
    assert all(inside(thin, np.array([r.x]), np.array([r.y]))[0] for r in by["thin"]) and all(not (4 < r.x < 6 and 4 < r.y < 6) for r in by["wide"])
    assert max(r.k for r in by["wide"]) < 40 < max(r.k for r in by["thin"])


def test_equal_shapes_are_joined_once(spark):
    """30,000 copies of three shapes: what is cut, held together and searched for are shapes."""
    from landcube.operators.copies import classes, expanded

    square = lambda x: [[[[x, 0.0], [x + 10.0, 0.0], [x + 10.0, 10.0], [x, 10.0], [x, 0.0]]]]
    three = spark.createDataFrame([(s, square(x), x, 0.0, x + 10.0, 10.0) for s, x in enumerate((0.0, 4.0, 30.0))], f"s int, parts {PARTS}, x0 double, y0 double, x1 double, y1 double")
    many = three.crossJoin(spark.range(10_000).withColumnRenamed("id", "i")).withColumn("grid_id", F.col("i") * 3 + F.col("s"))
    of, rows = classes(many.select("grid_id", "parts"), ["parts"])
    met = P.shape_overlaps(of, of, 7.0)
    assert {(r.inter_area, n) for r, n in met.groupBy("inter_area").count().rdd.map(lambda r: (r, r["count"])).collect()} == {(100.0, 3), (60.0, 2)}
    few = many.where("i < 40")
    pairs = {(r.a_id, r.b_id): r.inter_area for r in P.self_overlaps(few, "grid_id", 7.0).collect()}
    want = {(a, b): 100.0 if a % 3 == b % 3 else 60.0 for a in range(120) for b in range(a + 1, 120) if a % 3 == b % 3 or {a % 3, b % 3} == {0, 1}}
    assert pairs == want
    for cols in (["parts"], ["x0", "y0", "x1", "y1"]):  # 300 million pairs, as three sums
        out = S.previous_overlap(many.select("grid_id", *cols), many.withColumn("grid_id", -F.col("grid_id") - 1).select("grid_id", *cols), 7.0, tolerance=1e9).groupBy("ovlp_m2").count().collect()
        assert {tuple(r) for r in out} == {(1.6e6, 20_000), (1e6, 10_000)}
    # blocks hold a bounded number of rows, and lose none
    _, px = classes(few.select("grid_id", "x0"), ["x0"])
    same = px.select(F.col("_cls").alias("_a"), F.col("_cls").alias("_b")).distinct()
    out = expanded(same, px.withColumnRenamed("grid_id", "p").drop("x0"), px.withColumnRenamed("grid_id", "q").drop("x0"), 7)
    assert {tuple(r) for r in out.collect()} == {(a, b) for a in range(120) for b in range(120) if a % 3 == b % 3}
    near = S.near_points(few.select("grid_id", F.col("x0").alias("x"), F.col("y0").alias("y")), few.select(F.col("grid_id").alias("key"), F.col("x0").alias("px"), F.col("y0").alias("py")), 5.0)
    assert {(r.grid_id, r.key) for r in near.collect()} == {(a, b) for a in range(120) for b in range(120) if a % 3 == b % 3 or {a % 3, b % 3} == {0, 1}}
