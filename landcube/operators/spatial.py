"""Boxes: overlap joins, rectangles, neighbours, projections.

Boxes are columns x0, y0, x1, y1. Overlap joins deal both sides to the cells of a
coarse grid and keep each pair at one cell only, so that Spark joins on equality.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import polygons
from .copies import classes, expanded
from .rounds import independent_in_order, written
from .views import in_order


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def _cells(df: DataFrame, size: float) -> DataFrame:
    lo, hi = (lambda c: F.floor(F.col(c) / size)), (lambda c: F.floor(F.col(c) / size))
    return df.withColumn("_cx", F.explode(F.sequence(lo("x0"), hi("x1")))).withColumn("_cy", F.explode(F.sequence(lo("y0"), hi("y1"))))


CORNERS = ["x0", "y0", "x1", "y1"]


def overlaps(a: DataFrame, b: DataFrame, cell: float, digits: int | None = None) -> DataFrame:
    """Pairs of boxes that share an area, with ``inter_area``. ``a(a_id, x0, y0,
    x1, y1)`` and ``b(b_id, ...)``. Equal boxes are joined as one. The area is rounded
    to ``digits``, once for each pair of boxes and not for each pair of rows."""
    (a_of, a_rows), (b_of, b_rows) = classes(a.select("a_id", *CORNERS), CORNERS), classes(b.select("b_id", *CORNERS), CORNERS)
    met = box_overlaps(a_of, b_of, cell)
    if digits is not None:
        met = met.withColumn("inter_area", F.round("inter_area", digits))
    out = expanded(met, a_rows.drop(*CORNERS), b_rows.drop(*CORNERS))
    return out.select("a_id", *(f"a_{c}" for c in CORNERS), "b_id", *(f"b_{c}" for c in CORNERS), "inter_area")


def box_overlaps(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(_a, a_x0 .. a_y1, _b, b_x0 .. b_y1, inter_area): pairs of the boxes ``a(_cls, x0,
    y0, x1, y1)`` and ``b(_cls, ...)`` that share an area."""
    side = lambda df, p: _cells(df, cell).select(F.col("_cls").alias(f"_{p}"), *(F.col(c).alias(f"{p}_{c}") for c in CORNERS), "_cx", "_cy")
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    x1, y1 = F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1")
    met = side(a, "a").join(side(b, "b"), ["_cx", "_cy"]).where((x1 > x0) & (y1 > y0))
    # the cell of the common box's lower corner is the one that reports the pair
    met = met.where((F.floor(x0 / cell) == F.col("_cx")) & (F.floor(y0 / cell) == F.col("_cy")))
    return met.withColumn("inter_area", (x1 - x0) * (y1 - y0)).drop("_cx", "_cy")


def crosswalk(cim: DataFrame, mgrs: DataFrame, cell: float, primary: float = 0.95) -> DataFrame:
    """Grid-to-tile rows with areas, fractions, rank by overlap, and the relation
    on the first rank. Boxes, or polygons if both sides have ``parts``."""
    cim, mgrs = cim.withColumnRenamed("cim_name", "a_id"), mgrs.withColumnRenamed("mgrs_tile", "b_id")
    if "parts" in cim.columns and "parts" in mgrs.columns:
        met = polygons.overlaps(cim, mgrs, cell)
    else:
        area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
        met = overlaps(cim, mgrs, cell).withColumns({"a_area": area("a"), "b_area": area("b")})
    rows = met.select(
        F.col("a_id").alias("cim_name"), F.col("b_id").alias("mgrs_tile"), F.round("inter_area", 2).alias("overlap_m2"), F.round("a_area", 2).alias("cim_area_m2"),
        F.round("b_area", 2).alias("mgrs_area_m2"), F.round(F.col("inter_area") / F.col("a_area"), 6).alias("overlap_frac_of_cim"), F.round(F.col("inter_area") / F.col("b_area"), 6).alias("overlap_frac_of_mgrs"))
    w = Window.partitionBy("cim_name")
    by = w.orderBy(F.desc("overlap_frac_of_cim"), "mgrs_tile")
    n, top = F.count("*").over(w), F.max("overlap_frac_of_cim").over(w)
    relation = F.when((n == 1) & (top >= primary), "1:1").when(n == 1, "1:1_partial").when(top >= primary, "1:N").otherwise("N:N")
    return rows.withColumn("mgrs_rank_by_cim_overlap", F.row_number().over(by)).withColumn("_r", relation).withColumn(
        "cim_mgrs_relation", F.when(F.col("mgrs_rank_by_cim_overlap") == 1, F.col("_r")).otherwise("")).drop("_r")


def tile_grids(pairs: DataFrame) -> DataFrame:
    """(mgrs_tile, cims): the sorted grids of each tile."""
    return pairs.groupBy("mgrs_tile").agg(F.array_sort(F.collect_set("cim_name")).alias("cims"))


def rectangles(tiles: DataFrame, side: int = 3, pixels: int = 264, metres: float = 30.0, inside: float = 0.99) -> DataFrame:
    """Cut tiles into squares from the upper left, keeping those that lie in the
    tile by ``inside`` of their area."""
    size = pixels * metres * side
    cols = F.ceil((F.col("x1") - F.col("x0")) / size).cast("int")
    rows = F.ceil((F.col("y1") - F.col("y0")) / size).cast("int")
    out = tiles.withColumn("col", F.explode(F.sequence(F.lit(0), cols - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1)))
    rx0, ry1 = F.col("x0") + F.col("col") * size, F.col("y1") - F.col("row") * size
    inter = (F.least(rx0 + size, F.col("x1")) - rx0) * (ry1 - F.greatest(ry1 - size, F.col("y0")))
    return out.where(inter >= inside * size * size).select("tile", "col", "row", rx0.alias("rx0"), (ry1 - size).alias("ry0"), (rx0 + size).alias("rx1"), ry1.alias("ry1"))


def dominant_tile(pairs: DataFrame, min_pct: float = 60.0) -> DataFrame:
    """(a_id, mgrs_dom, mgrs_pct, n_mgrs) of rectangles whose largest overlap
    covers ``min_pct`` of them."""
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    best = F.max_by(F.struct("b_id", "inter_area"), F.struct(F.col("inter_area"), -F.col("b_id")))
    out = pairs.groupBy("a_id").agg(best.alias("best"), F.max(area).alias("area"), F.count("*").alias("n_mgrs"))
    return out.select("a_id", F.col("best.b_id").alias("mgrs_dom"), (F.col("best.inter_area") / F.col("area") * 100).alias("mgrs_pct"), "n_mgrs").where(F.col("mgrs_pct") >= min_pct)


def previous_overlap(cands: DataFrame, previous: DataFrame, cell: float, tolerance: float = 1.0, max_pct: float = 0.0) -> DataFrame:
    """Candidates whose overlap with an earlier selection is within tolerance, in
    area or in share. Boxes, or polygons if both sides have ``parts``."""
    whole = "parts" in cands.columns and "parts" in previous.columns
    shape, meet = (["parts"], polygons.shape_overlaps) if whole else (CORNERS, box_overlaps)
    # equal shapes have one sum; of the earlier ones only their number counts
    (of, rows), (before, _) = classes(cands, shape), classes(previous.select(*shape), shape)
    hit = meet(of, before, cell).join(before.select(F.col("_cls").alias("_b"), F.col("_n").alias("_times")), "_b")
    total = hit.groupBy(F.col("_a").alias("_cls")).agg(F.sum(F.col("inter_area") * F.col("_times")).alias("_o"))
    none = F.lit(False)
    for c in shape:
        none = none | F.col(c).isNull()
    rows = rows.select(*cands.columns, "_cls").unionByName(cands.where(none).withColumn("_cls", F.lit(None).cast("long")))
    out = rows.join(total, "_cls", "left").withColumn("ovlp_m2", F.coalesce("_o", F.lit(0.0))).select(*cands.columns, "ovlp_m2")
    out = out.withColumn("ovlp_pct", F.col("ovlp_m2") / (polygons.area(F.col("parts")) if whole else box_area()) * 100)
    return out.where((F.col("ovlp_m2") <= tolerance) | (F.col("ovlp_pct") <= max_pct))


def greedy_non_overlap(df: DataFrame, cell: float, order: list, tolerance: float = 1.0) -> DataFrame:
    """Rows in ``order``, each kept unless it overlaps a kept one by more than the
    tolerance, as a sequential scan would: by blocks that grow from round to round."""
    ranked = in_order(df, order, "_rank")
    pairs = overlaps(
        ranked.select(F.col("_rank").alias("a_id"), "x0", "y0", "x1", "y1"), ranked.select(F.col("_rank").alias("b_id"), "x0", "y0", "x1", "y1"), cell
    ).where((F.col("a_id") < F.col("b_id")) & (F.col("inter_area") > tolerance)).select(F.col("a_id").alias("first"), F.col("b_id").alias("later"))
    at = [F.floor(F.col(c) / cell).alias(n) for c, n in (("x0", "cx"), ("y0", "cy"))]
    kept = independent_in_order(ranked.select(F.col("_rank").alias("node"), *at), pairs)
    return ranked.join(kept.withColumnRenamed("node", "_rank"), "_rank").drop("_rank")


def neighbour_cells(df: DataFrame, tile: str = "mgrs", col: str = "col", row: str = "row", key: str = "grid_id") -> tuple[DataFrame, DataFrame]:
    """The cells of a grid that have rows, (tile, col, row, first, n) with their smallest
    id and their rows, and the directed pairs (a, b) of such cells that touch, by their
    smallest ids. Cells, and not rows, are joined: rows that share a cell cost nothing."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    cells = df.where((F.col(col) >= 0) & (F.col(row) >= 0)).groupBy(tile, col, row).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    cells = written(cells)
    near = cells.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))))
    near = near.select(F.col("first").alias("a"), F.col(tile).alias("_t"), (F.col(col) + F.col("_s.i")).alias("_c"), (F.col(row) + F.col("_s.j")).alias("_r"))
    other = cells.select(F.col("first").alias("b"), F.col(tile).alias("_t"), F.col(col).alias("_c"), F.col(row).alias("_r"))
    return cells, near.join(other, ["_t", "_c", "_r"]).select("a", "b")


# --- projections ----------------------------------------------------------------

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
K0 = 0.9996


def to_utm(lon: Column, lat: Column, zone: Column, south: bool | None = None, m=F) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees; the southern false northing below 0, or
    as ``south`` says. ``m`` has the functions: Spark's, or NumPy for arrays."""
    ep = E2 / (1 - E2)
    phi, dl = m.radians(lat), m.radians(lon - (zone * 6 - 183))
    n = A / m.sqrt(1 - E2 * m.sin(phi) * m.sin(phi))
    t, c, a = m.tan(phi) * m.tan(phi), ep * m.cos(phi) * m.cos(phi), dl * m.cos(phi)
    arc = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * m.sin(2 * phi)
               + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * m.sin(4 * phi) - (35 * E2**3 / 3072) * m.sin(6 * phi))
    x = K0 * n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a * a * a * a * a / 120) + 500000
    y = K0 * (arc + n * m.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a * a * a * a * a * a / 720))
    if south is not None:
        return x, y + (10000000 if south else 0)
    return x, F.when(lat < 0, y + 10000000).otherwise(y)


def from_utm(x: Column, y: Column, zone: Column, south: bool = True, m=F) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    ep, e1 = E2 / (1 - E2), (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = (y - (10000000 if south else 0)) / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    phi = (mu + (3 * e1 / 2 - 27 * e1**3 / 32) * m.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * m.sin(4 * mu) + (151 * e1**3 / 96) * m.sin(6 * mu) + (1097 * e1**4 / 512) * m.sin(8 * mu))
    s2 = m.sin(phi) * m.sin(phi)
    n, r = A / m.sqrt(1 - E2 * s2), A * (1 - E2) / m.pow(1 - E2 * s2, 1.5)
    t, c = m.tan(phi) * m.tan(phi), ep * m.cos(phi) * m.cos(phi)
    d = (x - 500000) / (n * K0)
    lat = phi - n * m.tan(phi) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * d * d * d * d / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * d * d * d * d * d * d / 720)
    lon = (d - (1 + 2 * t + c) * d * d * d / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * d * d * d * d * d / 120) / m.cos(phi)
    return zone * 6 - 183 + m.degrees(lon), m.degrees(lat)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres with standard parallels at 30 degrees."""
    e = math.sqrt(E2)
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return A * k0 * F.radians(lon), A * q / (2 * k0)


def snap(c: Column, size: float) -> Column:
    return F.floor(c / size) * size


#: Letters of latitude bands, of rows, and of columns by zone modulo three (fixed values).
BANDS, ROWS, COLUMNS = "CDEFGHJKLMNPQRSTUVWX", "ABCDEFGHJKLMNPQRSTUV", {1: "ABCDEFGH", 2: "JKLMNPQR", 0: "STUVWXYZ"}


def tile_corner(tile: Column) -> tuple[Column, Column, Column, Column]:
    """Zone, whether south, easting and northing of the lower left corner of a
    100 km tile such as 19HCC."""
    zone = F.substring(tile, 1, 2).cast("int")
    index = lambda letters, at: F.instr(F.lit(letters), F.substring(tile, at, 1)) - 1
    column = F.when(zone % 3 == 1, index(COLUMNS[1], 4)).when(zone % 3 == 2, index(COLUMNS[2], 4)).otherwise(index(COLUMNS[0], 4))
    row = F.pmod(index(ROWS, 5) - F.when(zone % 2 == 0, 5).otherwise(0), F.lit(20))
    low = -80 + 8 * index(BANDS, 3)
    south = low < 0
    # rows repeat every 2,000 km: the first at or above the band's lower edge
    edge = F.element_at(F.array(*map(F.lit, _band_edges())), index(BANDS, 3) + 1)
    y = row * 100000 + F.ceil(F.greatest(edge - row * 100000, F.lit(0)) / 2000000) * 2000000
    return zone, south, (column + 1) * 100000, y


def _band_edges() -> list[int]:
    """Northings of the bands' lower edges on a central meridian, in whole 100 km."""
    lat = np.array([-80.0 + 8 * i for i in range(len(BANDS))])
    y = to_utm(np.full(len(lat), -177.0), lat, 1, False, np)[1] + np.where(lat < 0, 10_000_000, 0)
    return (np.floor(y / 100_000) * 100_000).astype(int).tolist()


def tile_box(df: DataFrame, tile: str = "tile", km: float = 100.0) -> DataFrame:
    """``df`` with west, south, east, north in degrees: of the tile's lower left and
    upper right corners alone."""
    zone, south, x, y = tile_corner(F.col(tile))
    # without the southern false northing both halves have one formula
    out = df.withColumns({"_z": zone, "_x": x, "_y": y - F.when(south, 10_000_000).otherwise(0)})
    (lon0, lat0), (lon1, lat1) = (from_utm(F.col("_x") + d, F.col("_y") + d, F.col("_z"), False) for d in (0, km * 1000))
    out = out.withColumns({"_a": lon0, "_b": lat0, "_c": lon1, "_d": lat1})
    return out.withColumns({"west": F.least("_a", "_c"), "south": F.least("_b", "_d"), "east": F.greatest("_a", "_c"), "north": F.greatest("_b", "_d")}).drop("_z", "_x", "_y", "_a", "_b", "_c", "_d")


def random_points(boxes: DataFrame, n: int, seed: int = 42, holds=None, tries: int = 2000, keep=()) -> DataFrame:
    """(key, k, x, y): ``n`` points in each box ``boxes(key, x0, y0, x1, y1)``, the
    same for a seed. ``holds`` is a condition on x, y and the boxes' columns (a
    polygon's); of at most ``n * tries`` draws the first ``n`` that meet it stay. Only
    boxes that lack points draw again, four times as often as before. Points come with
    the columns ``keep`` of their boxes: Spark takes what an explode makes for as small
    as what it was made from, and could broadcast the points to join the boxes."""
    boxes = boxes.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    share = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "key", "k"), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def draw(some: DataFrame, first: int, after: int) -> DataFrame:
        at = some.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(after - 1))))
        return at.withColumns({"x": F.col("x0") + share("x") * (F.col("x1") - F.col("x0")), "y": F.col("y0") + share("y") * (F.col("y1") - F.col("y0"))})

    if holds is None:
        return draw(boxes, 0, n).select("key", "k", "x", "y", *keep)
    open_, first, after, out = boxes, 0, 2 * n, None
    while first < n * tries:
        got = written(draw(open_, first, after).where(holds).select("key", "k", "x", "y", *keep))
        out = got if out is None else out.unionByName(got)
        full = out.groupBy("key").count().where(F.col("count") >= n).select("key")
        open_ = written(boxes.join(full, "key", "left_anti"))
        if open_.isEmpty():
            break
        first, after = after, min(4 * after, n * tries)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("k"))).where(F.col("_n") <= n).drop("_n")


def near_points(pixels: DataFrame, points: DataFrame, metres: float = 120.0) -> DataFrame:
    """Pixels (x, y, ...) within ``metres`` of a point (key, px, py), once for each:
    by cells of that size and their neighbours. Rows at one place are joined as one."""
    cell = lambda c: F.floor(F.col(c) / metres)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    (a_of, a_rows), (b_of, b_rows) = classes(pixels, ["x", "y"]), classes(points, ["px", "py"])
    at = b_of.withColumn("_o", around).select(F.col("_cls").alias("_b"), "px", "py", (cell("px") + F.col("_o.i")).alias("_cx"), (cell("py") + F.col("_o.j")).alias("_cy"))
    met = a_of.select(F.col("_cls").alias("_a"), "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy")).join(at, ["_cx", "_cy"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    met = met.where(dx * dx + dy * dy <= metres * metres).select("_a", "_b")
    return expanded(met, a_rows, b_rows).select(*pixels.columns, *points.columns)


def tile_named(tiles: DataFrame, name: str, key: str = "tile") -> DataFrame:
    """The tile's rows. None is an error, which the job raises when it finds no row."""
    found = tiles.where(F.col(key) == name)
    n = found.agg(F.count("*").alias("_n"))
    sure = n.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no tile named {name}")).cast("boolean")).otherwise(True).alias("_ok"))
    return found.join(F.broadcast(sure), F.col("_ok")).drop("_ok")
