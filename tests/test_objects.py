"""Objects against plain whole-grid versions, for blocks of any size."""

from collections import Counter

import numpy as np
import pytest
from landcube.functions import taxonomy as T
from landcube.operators import generate as G
from landcube.operators import labels as B
from landcube.operators import objects as O

FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def plain_label(grid, conn):
    out, n = np.zeros(grid.shape, int), 0
    for r in range(grid.shape[0]):
        for c in range(grid.shape[1]):
            if grid[r, c] and not out[r, c]:
                n += 1
                todo = [(r, c)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < grid.shape[0] and 0 <= j < grid.shape[1] and not out[i, j] and grid[i, j] == grid[r, c]:
                        out[i, j] = n
                        todo += [(i + a, j + b) for a, b in (FOUR if conn == 4 else EIGHT)]
    return out


def plain_merge(grid, size):
    """Rounds: each small patch follows its largest neighbour, if that comes before it."""
    out = grid.copy()
    while True:
        lab = plain_label(out, 4)
        n = np.bincount(lab.reshape(-1))
        near = {k: set() for k in range(1, len(n))}
        for i, j in ((0, 1), (1, 0)):
            a, b = lab[: lab.shape[0] - i, : lab.shape[1] - j], lab[i:, j:]
            for x, y in zip(a[(a != b) & (a > 0) & (b > 0)].tolist(), b[(a != b) & (a > 0) & (b > 0)].tolist()):
                near[x].add(y)
                near[y].add(x)
        to = {}
        for k in near:
            before = [x for x in near[k] if (-n[x], x) < (-n[k], k)]
            if n[k] < size and before:
                to[k] = min(before, key=lambda x: (-n[x], x))
        if not to:
            return out
        new = out.copy()
        for k in to:
            end = k
            while end in to:
                end = to[end]
            new[lab == k] = out[lab == end][0]
        out = new


def plain_majority(grid, sweeps=50):
    lab = plain_label(grid, 8)
    size = np.bincount(lab.reshape(-1))[lab]
    mmu = np.vectorize(lambda v: T.MMU_PIXELS.get(int(v), T.MMU_DEFAULT))(grid)
    pending, out = (size < mmu) & (grid != 0), grid.copy()
    for _ in range(sweeps):
        new, left = out.copy(), pending.copy()
        for r, c in zip(*np.nonzero(pending)):
            votes = Counter(int(out[r + i, c + j]) for i, j in EIGHT if 0 <= r + i < grid.shape[0] and 0 <= c + j < grid.shape[1] and out[r + i, c + j] and not pending[r + i, c + j])
            if votes:
                new[r, c], left[r, c] = min(votes, key=lambda v: (-votes[v], v)), False
        if (left == pending).all():
            break
        out, pending = new, left
    rows, cols = np.nonzero((out != 0) & ~pending)
    for r, c in zip(*np.nonzero(pending)):
        if len(rows):
            k = ((rows - r) ** 2 + (cols - c) ** 2).argmin()
            out[r, c] = out[rows[k], cols[k]]
    return out


def frame(spark, grids, gaps=()):
    """Tiles of one table; NULL for some of nodata; rows shifted to begin below 0."""
    rows = [(t, r - 3, c + 5, None if g[r, c] == 0 and (r + c) % 2 else int(g[r, c]), "x") for t, g in grids.items() for r in range(g.shape[0]) for c in range(g.shape[1]) if (t, r, c) not in gaps]
    return spark.createDataFrame(rows, "tile string, row int, col int, value int, note string")


def grids():
    rng = np.random.default_rng(7)
    spiral = np.zeros((25, 25), int)  # one component that winds through every block
    r = c = d = 0
    r, c = 0, -1
    for k, n in enumerate([25, *[x for y in range(24, 0, -2) for x in (y, y)]]):
        d = k % 4
        for _ in range(n):
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
            spiral[r, c] = 7
    return {"a": rng.integers(0, 3, (23, 31)), "b": rng.integers(0, 2, (20, 17)) * 5, "c": spiral, "d": np.ones((9, 9), int), "e": np.zeros((4, 4), int), "f": np.kron(rng.integers(0, 4, (8, 9)), np.ones((3, 3), int))}


@pytest.mark.parametrize("block,conn", [(1024, 8), (5, 8), (7, 4)])
def test_components_do_not_depend_on_blocks(spark, block, conn):
    g = grids()
    got = O.components(frame(spark, g), connectivity=conn, block=block)
    assert got.columns == ["tile", "row", "col", "value", "note", "component", "size"]
    rows = got.collect()
    assert len(rows) == sum(x.size for x in g.values())
    want = {t: plain_label(x, conn) for t, x in g.items()}
    size = {t: np.bincount(x.reshape(-1)) for t, x in want.items()}
    for r in rows:
        k = want[r.tile][r.row + 3, r.col - 5]
        assert (r.component, r.size) == (k, size[r.tile][k] if k else 0)


def test_kernels():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g = rng.integers(0, 3, (11, 13))
        for conn in (4, 8):
            assert (O.label(g, conn) == plain_label(g, conn)).all()
    assert (O.label(np.zeros((3, 3), int), 8) == 0).all() and (O.label(np.ones((1, 1), int), 4) == 1).all()


def area_and_holes(rings):
    areas = [O.ring_area([tuple(p) for p in r]) for r in rings]
    return sum(areas), sum(a < 0 for a in areas)


@pytest.mark.parametrize("conn", [4, 8])
def test_polygons_do_not_depend_on_blocks(spark, conn):
    g = grids()
    g["ring"] = np.pad(np.zeros((6, 6), int), 2, constant_values=3)
    df = frame(spark, g)
    whole = {(r.tile, r.patch_id): (r.class_id, r.n_pixels, r.rings) for r in O.polygonize(df, connectivity=conn).collect()}
    for block in (4, 7):
        assert {(r.tile, r.patch_id): (r.class_id, r.n_pixels, r.rings) for r in O.polygonize(df, connectivity=conn, block=block).collect()} == whole
    for t, x in g.items():
        lab = plain_label(x, conn)
        for k in range(1, lab.max() + 1):
            class_id, n, rings = whole[t, k]
            assert n == (lab == k).sum() and class_id == x[lab == k][0] and area_and_holes(rings)[0] == n
            # every ring's steps are a pixel long and bound the patch on their right
            for ring in rings:
                for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1]):
                    assert abs(r0 - r1) + abs(c0 - c1) == 1
            steps = sum(map(len, rings))
            pad = np.pad(lab, 1)
            assert steps == sum(int((pad[1 + i : pad.shape[0] - 1 + i, 1 + j : pad.shape[1] - 1 + j] != k)[lab == k].sum()) for i, j in FOUR)
    assert area_and_holes(whole["ring", 1][2]) == (64, 1)


@pytest.mark.parametrize("block", [1024, 5])
def test_merging_sieve(spark, block):
    g = grids()
    for size in (2, 6):
        rows = O.sieve(frame(spark, g), how="merge", size=size, block=block).collect()
        want = {t: plain_merge(x, size) for t, x in g.items()}
        assert len(rows) == sum(x.size for x in g.values())
        assert all((r.sieved or 0) == want[r.tile][r.row + 3, r.col - 5] for r in rows)


@pytest.mark.parametrize("block,sweeps", [(1024, 50), (6, 50), (6, 1)])
def test_majority_sieve(spark, block, sweeps):
    g = {t: np.where(x == 2, 33, np.where(x == 1, 59, x)) for t, x in grids().items()}
    island = np.zeros((70, 90), int)  # small patches far from the nearest that stays
    island[2:4, 1:3], island[60:66, 70:76], island[30, 85], island[69, 0] = 59, 66, 12, 25
    g |= {"island": island, "alone": np.pad(np.ones((1, 2), int), 3)}
    rows = O.sieve_majority(frame(spark, g), sweeps=sweeps, block=block).collect()
    want = {t: plain_majority(x, sweeps) for t, x in g.items()}
    assert len(rows) == sum(x.size for x in g.values())
    assert all((r.sieved or 0) == want[r.tile][r.row + 3, r.col - 5] for r in rows)


def test_gaps_and_empty_tables(spark):
    g = {"a": np.ones((4, 6), int)}
    gaps = {("a", r, 2) for r in range(4)} | {("a", r, 3) for r in range(4)}
    rows = O.components(frame(spark, g, gaps), block=2).collect()
    assert {(r.component, r.size) for r in rows} == {(1, 8), (2, 8)}
    none = frame(spark, g).limit(0)
    assert O.components(none).count() == 0 and O.sieve(none).count() == 0 and O.sieve(none, how="merge").count() == 0 and O.polygonize(none).count() == 0


def test_large_patches_at_the_bound(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 40)], "n_pixels long")
    for bound in (0.09, 0.18, 0.27, 0.45, 0.54, 0.63, 0.99, 1.71):
        assert B.large_patches(df, bound).count() == 40 - round(bound / 0.09)
    px = spark.createDataFrame([("R", 2020, 0, c, 59) for c in range(5)] + [("R", 2020, 2, c, 66) for c in range(4)], "grid_id string, rev_year int, row int, col int, class_id int")
    plan = spark.createDataFrame([("R", 2020, 2, "2020")], "grid_id string, review_year int, review_tier int, review_years string")
    assert [r.n_pixels for r in G.polygons(px, plan, min_patch_ha=0.45).collect()] == [5]
