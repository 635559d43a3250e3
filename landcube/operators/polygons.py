"""Overlaps of polygons with holes.

A polygon is ``parts``: an array of parts, each an array of rings of [x, y]; inside is
what an odd number of rings encloses. Polygons are cut at the lines of a coarse grid.
A cell that lies wholly inside a polygon carries no geometry; of two pieces of one
cell only pairs of true pieces need their common area computed, by slabs between the
heights at which edges begin, end or cross.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .copies import classes, expanded

RINGS = "array<array<array<double>>>"
ARROW_RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of [x, y], positive if it runs counter-clockwise."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(F.zip_with(ring, nxt, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, x: s + x) / 2


def area(parts: Column) -> Column:
    """Area of parts: of their outer rings less that of their holes, whatever way they run."""
    size = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.abs(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(parts, size), F.lit(0.0), lambda s, x: s + x)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``parts`` of an upright rectangle."""
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return F.array(F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))))


def contains(parts: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside: a ray to the right crosses an odd number of edges.
    A lower or left border belongs to the inside, an upper or right one does not."""

    def crossings(ring):
        nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
        hit = lambda a, b: ((a[1] <= y) != (b[1] <= y)) & (x < a[0] + (y - a[1]) / F.when(b[1] != a[1], b[1] - a[1]) * (b[0] - a[0]))
        return F.size(F.filter(F.zip_with(ring, nxt, hit), lambda h: h))

    return F.aggregate(F.transform(F.flatten(parts), crossings), F.lit(0), lambda s, n: s + n) % 2 == 1


def clip(ring: np.ndarray, axis: int, bound: float, above: bool) -> np.ndarray:
    """A ring's part on one side of a line (what runs along the line encloses nothing)."""
    if not len(ring):
        return ring
    inside = ring[:, axis] >= bound if above else ring[:, axis] <= bound
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    nxt, nxt_in = np.roll(ring, -1, axis=0), np.roll(inside, -1)
    cross = inside != nxt_in
    step = np.where(cross, nxt[:, axis] - ring[:, axis], 1.0)
    at = ring + ((bound - ring[:, axis]) / step)[:, None] * (nxt - ring)
    at[:, axis] = bound
    both = np.stack([ring, at], axis=1).reshape(-1, 2)
    return both[np.stack([inside, cross], axis=1).reshape(-1)]


def signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """(x0, y0, x1, y1) of the edges that are not level, the lower end first."""
    e = np.concatenate([np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings])
    e = e[e[:, 1] != e[:, 3]]
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return e


def _inside(e: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The sorted places where the edges cross each height."""
    on = (e[:, 1][None] < y[:, None]) & (e[:, 3][None] > y[:, None])
    x = e[:, 0] + (y[:, None] - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
    return [np.sort(x[i][on[i]]) for i in range(len(y))]


def common_area(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Area inside both, by slabs in which no edge ends or crosses one of the other."""
    if not a or not b:
        return 0.0
    p, q = _edges(a), _edges(b)
    if not len(p) or not len(q):
        return 0.0
    low, high = max(p[:, 1].min(), q[:, 1].min()), min(p[:, 3].max(), q[:, 3].max())
    if low >= high:
        return 0.0
    p, q = (e[(e[:, 3] > low) & (e[:, 1] < high)] for e in (p, q))
    # heights of crossings: x of both edges are equal there
    slope = lambda e: (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    sp, sq = slope(p)[:, None], slope(q)[None]
    gap = (q[:, 0] - sq[0] * q[:, 1])[None] - (p[:, 0] - sp[:, 0] * p[:, 1])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = gap / (sp - sq)
    meet = np.isfinite(y) & (y > np.maximum(p[:, 1][:, None], q[:, 1][None])) & (y < np.minimum(p[:, 3][:, None], q[:, 3][None]))
    ys = np.unique(np.concatenate([p[:, 1], p[:, 3], q[:, 1], q[:, 3], y[meet], [low, high]]))
    ys = ys[(ys >= low) & (ys <= high)]
    mid = (ys[:-1] + ys[1:]) / 2
    total = 0.0
    for height, x, z in zip(np.diff(ys), _inside(p, mid), _inside(q, mid)):
        if len(x) and len(z):
            lo = np.maximum(x[0::2][:, None], z[0::2][None])
            hi = np.minimum(x[1::2][:, None], z[1::2][None])
            total += float(height * np.maximum(hi - lo, 0).sum())
    return total


def cut(parts: list, cell: float) -> Iterator[tuple[int, int, float, list | None]]:
    """(cx, cy, area, rings) of a polygon's pieces in the cells of a grid; rings are
    None where the cell lies inside."""
    rings = [(np.asarray(r, float), 1.0 if i == 0 else -1.0) for part in parts for i, r in enumerate(part)]
    rings = [(r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r, s) for r, s in rings]
    rings = [(r, s) for r, s in rings if len(r) >= 3]
    if not rings:
        return
    every = np.concatenate([r for r, _ in rings])
    for cy in range(int(np.floor(every[:, 1].min() / cell)), int(np.floor(every[:, 1].max() / cell)) + 1):
        row = [(clip(clip(r, 1, cy * cell, True), 1, (cy + 1) * cell, False), s) for r, s in rings]
        row = [(r, s) for r, s in row if len(r) >= 3]
        if not row:
            continue
        some = np.concatenate([r for r, _ in row])
        for cx in range(int(np.floor(some[:, 0].min() / cell)), int(np.floor(some[:, 0].max() / cell)) + 1):
            piece = [(clip(clip(r, 0, cx * cell, True), 0, (cx + 1) * cell, False), s) for r, s in row]
            piece = [(r, s) for r, s in piece if len(r) >= 3]
            size = sum(s * abs(signed(r)) for r, s in piece)
            if size <= 0:
                continue
            full = len(piece) == 1 and size >= cell * cell * (1 - 1e-12)
            yield cx, cy, cell * cell if full else size, None if full else [r.tolist() for r, _ in piece]


def pieces(df: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, cx, cy, area, rings) of the polygons ``df(key, parts)``."""

    def run(batches):
        for b in batches:
            for i, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(cut(parts or [], cell))
                for lo in range(0, len(found), 10_000):
                    cx, cy, size, rings = zip(*found[lo : lo + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(cx), b.schema.field(0).type), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(size, pa.float64()), pa.array(rings, ARROW_RINGS)],
                        names=[key, "cx", "cy", "area", "rings"])

    return df.select(key, "parts").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, cx long, cy long, area double, rings {RINGS}")


def overlaps(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id, inter_area, a_area, b_area): pairs of polygons that share an area,
    once each, of ``a(a_id, parts)`` and ``b(b_id, parts)`` with distinct ids."""
    (a_of, a_rows), (b_of, b_rows) = classes(a.select("a_id", "parts"), ["parts"]), classes(b.select("b_id", "parts"), ["parts"])
    met = shape_overlaps(a_of, b_of, cell)
    size = lambda df, end, name: df.select(F.col("_cls").alias(end), area(F.col("parts")).alias(name))
    met = met.join(size(a_of, "_a", "a_area"), "_a").join(size(b_of, "_b", "b_area"), "_b")
    return expanded(met, a_rows.drop("parts"), b_rows.drop("parts")).select("a_id", "b_id", "inter_area", "a_area", "b_area")


def shape_overlaps(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(_a, _b, inter_area): pairs of the shapes ``a(_cls, parts)`` and ``b(_cls, parts)``
    that share an area."""
    left = pieces(a, "_cls", cell).select(F.col("_cls").alias("_a"), "cx", "cy", F.col("area").alias("_a_size"), F.col("rings").alias("_p"))
    right = pieces(b, "_cls", cell).select(F.col("_cls").alias("_b"), "cx", "cy", F.col("area").alias("_b_size"), F.col("rings").alias("_q"))
    met = left.join(right, ["cx", "cy"])

    def run(batches):
        rings = lambda x: [np.asarray(r, float) for r in x]
        for t in batches:
            size = [common_area(rings(p), rings(q)) for p, q in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(size, pa.float64())], names=["_a", "_b", "_s"])

    true = met.where("_p is not null and _q is not null").select("_a", "_b", "_p", "_q").mapInArrow(run, "_a long, _b long, _s double")
    # in a cell that one of the two fills, the other's piece is what they share
    full = met.where("_p is null or _q is null").select("_a", "_b", F.when(F.col("_p").isNull(), F.col("_b_size")).otherwise(F.col("_a_size")).alias("_s"))
    return true.unionByName(full).groupBy("_a", "_b").agg(F.sum("_s").alias("inter_area")).where("inter_area > 0")


def self_overlaps(df: DataFrame, key: str, cell: float, tolerance: float = 1.0) -> DataFrame:
    """(a_id, b_id, inter_area): pairs of one table, a before b, that share more than
    the tolerance."""
    of, rows = classes(df.select(key, "parts"), ["parts"])
    met = shape_overlaps(of, of, cell).where(F.col("inter_area") > tolerance)
    end = lambda e: rows.select(F.col(key).alias(e), "_cls", "_n")
    return expanded(met, end("a_id"), end("b_id")).where(F.col("a_id") < F.col("b_id")).select("a_id", "b_id", "inter_area")
