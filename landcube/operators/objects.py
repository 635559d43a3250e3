"""Objects on grids of any size: components, sieves and polygons.

A grid is rows (tile, row, col, value), keys not null. It is worked on in blocks of
``block`` pixels a side, each a task's bounded piece: components are labelled in
their blocks, pairs of labels that touch across a seam are edges of a small graph,
and its connected components join the labels. What needs neighbours beyond a block
gets a halo of copied pixels. So results do not depend on the block size, and no
task holds a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from . import rounds
from .rounds import written

BLOCK = 1024
#: A pixel's place is one number, row * WIDE + column + WIDE / 2, that grows along rows.
WIDE = 1 << 32
ARROW_RINGS = pa.list_(pa.list_(pa.list_(pa.int32())))


def _tie(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest element that each of 0 .. n - 1 reaches over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):  # both ends take the smaller root, roots are shortened, settled pairs go
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            short = root[root]
            if (short == root).all():
                break
            root = short
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def label(grid: np.ndarray, connectivity: int, nodata: int = 0) -> np.ndarray:
    """Components of equal value (1, 2, ... in order of their first pixel; nodata 0)."""
    h, w = grid.shape
    at = np.arange(h * w).reshape(h, w)
    pairs = []
    for dr, dc in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else []):
        near = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        far = (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))
        same = (grid[near] == grid[far]) & (grid[near] != nodata)
        pairs.append(np.stack([at[near][same], at[far][same]]))
    root = _tie(*np.concatenate(pairs, axis=1), h * w)
    root[grid.reshape(-1) == nodata] = -1
    firsts, out = np.unique(root, return_inverse=True)
    return (out + (0 if len(firsts) and firsts[0] == -1 else 1)).reshape(h, w)


def _grid(pdf: pd.DataFrame, value: str, fill: int) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    out = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), fill, np.int64)
    out[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf[value].fillna(fill).to_numpy(np.int64)
    return out, r0, c0


def _blocked(df: DataFrame, block: int) -> DataFrame:
    return df.withColumns({"_br": F.floor(F.col("row") / block).cast("int"), "_bc": F.floor(F.col("col") / block).cast("int")})


def with_halo(df: DataFrame, block: int, halo: int) -> DataFrame:
    """Each pixel in its block, and again in those whose border is within ``halo``;
    ``_own`` says which is its own."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / block).cast("int"), F.floor((F.col(c) + halo) / block).cast("int")))
    out = df.select("*", near("row").alias("_br")).select("*", near("col").alias("_bc"))
    return out.withColumn("_own", (F.floor(F.col("row") / block) == F.col("_br")) & (F.floor(F.col("col") / block) == F.col("_bc")))


def _ddl(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + more


def _labelled(df: DataFrame, value: str, connectivity: int, nodata: int, keys, block: int) -> DataFrame:
    """``df`` with ``_br``, ``_bc`` and ``_label``: the place of the first pixel of the
    component within its block; NULL for nodata."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = _grid(pdf, value, nodata)
        lab = label(grid, connectivity, nodata)
        first = np.zeros(int(lab.max(initial=0)) + 1, np.int64)
        ids, at = np.unique(lab, return_index=True)
        first[ids] = (at // lab.shape[1] + r0) * WIDE + at % lab.shape[1] + c0 + (WIDE >> 1)
        mine = lab[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0]
        return pdf.assign(_label=pd.Series(first[mine], index=pdf.index).where(mine > 0).astype("Int64"))

    out = _blocked(df, block)
    return out.groupBy(*keys, "_br", "_bc").applyInPandas(run, _ddl(out, "_label long"))


def _seams(lab: DataFrame, value: str, keys, connectivity: int, block: int) -> DataFrame:
    """(keys, a, b): labels of equal value that touch across the border of two blocks."""
    edge = lambda c: F.pmod(F.col(c), F.lit(block)).isin(0, block - 1)
    border = lab.where(F.col("_label").isNotNull() & (edge("row") | edge("col"))).select(*keys, "row", "col", "_br", "_bc", F.col(value).alias("_v"), "_label")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))).alias("s")
    a = border.select("*", step).select(*keys, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "_v", F.col("_br").alias("ar"), F.col("_bc").alias("ac"), F.col("_label").alias("a"))
    met = a.join(border.withColumnRenamed("_label", "b"), [*keys, "row", "col", "_v"]).where("_br != ar or _bc != ac")
    return met.select(*keys, "a", "b").distinct()


def _united(own: DataFrame, seams: DataFrame, keys) -> DataFrame:
    """``own(keys, _label, ...)`` with ``_root``, the smallest label that it reaches."""
    node = lambda c: F.struct(*keys, F.col(c).alias("at"))
    edges = written(seams.select(node("a").alias("a"), node("b").alias("b")))
    if edges.isEmpty():
        return own.withColumn("_root", F.col("_label"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    root = rounds.components(ends, edges).select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.at").alias("_label"), F.col("component.at").alias("_root"))
    return own.join(root, [*keys, "_label"], "left").withColumn("_root", F.coalesce("_root", "_label"))


def _numbered(total: DataFrame, keys) -> DataFrame:
    """``total(keys, _root, ...)`` with ``component``: 1, 2, ... in order of the first
    pixel. Rows are numbered each by itself, so that no task sees a tile's components."""
    out = total.withColumn("_r", F.shiftright("_root", 32))
    rows = out.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy("_root"))
    return out.withColumn("component", own).join(start, [*keys, "_r"]).withColumn("component", F.col("component") + F.col("_before")).drop("_r", "_before")


def components(df: DataFrame, value: str = "value", connectivity: int = 8, nodata: int = 0, keys=("tile",), block: int = BLOCK) -> DataFrame:
    """``component`` and its ``size`` for each pixel, components being numbered 1, 2, ...
    by their first pixel in each tile; nodata and NULL have component 0."""
    keys = list(keys)
    lab = written(_labelled(df, value, connectivity, nodata, keys, block))
    own = lab.where("_label is not null").groupBy(*keys, "_br", "_bc", "_label").agg(F.count("*").alias("_n"))
    own = written(_united(own, _seams(lab, value, keys, connectivity, block), keys))
    total = _numbered(own.groupBy(*keys, "_root").agg(F.sum("_n").alias("size")), keys)
    names = own.join(total, [*keys, "_root"]).select(*keys, "_br", "_bc", "_label", "component", "size")
    # a key of this join has at most a block's pixels
    out = lab.join(names, [*keys, "_br", "_bc", "_label"], "left")
    return out.select(*df.columns, F.coalesce("component", F.lit(0)).cast("long").alias("component"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


# --- sieves ----------------------------------------------------------------------


def _majority(near: np.ndarray, nodata: int) -> np.ndarray:
    """Of the columns of ``near`` the commonest value, the lowest of equals; nodata
    where there is no other value."""
    n = (near[:, None, :] == near[None, :, :]).sum(axis=1)
    n[near == nodata] = 0
    best = n.max(axis=0)
    low = np.where((n == best) & (near != nodata), near, np.iinfo(np.int64).max).min(axis=0)
    return np.where(best > 0, low, nodata)


def _sweep(grid: np.ndarray, pending: np.ndarray, nodata: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Pending pixels take the majority of their eight neighbours that are not, all of
    a sweep at once; what is still pending comes back as such."""
    out = np.pad(grid, 1, constant_values=nodata)
    left = np.pad(pending, 1)
    r, c = np.nonzero(left)
    for _ in range(sweeps):
        if not len(r):
            break
        seen = np.stack([np.where(left[r + i, c + j], nodata, out[r + i, c + j]) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
        new = _majority(seen, nodata)
        got = new != nodata
        if not got.any():
            break
        out[r[got], c[got]] = new[got]
        left[r[got], c[got]] = False
        r, c = r[~got], c[~got]
    return out[1:-1, 1:-1], left[1:-1, 1:-1]


def sieve_majority(df: DataFrame, value: str = "value", nodata: int = 0, keys=("tile",), sweeps: int = 50, block: int = BLOCK) -> DataFrame:
    """``df`` with ``sieved``: patches (8-connected) below their class's size take their
    neighbours' majority, sweep by sweep (lowest id of equals); what no sweep reaches
    takes the nearest class, the first by row and column of equals.

    A pixel after so many sweeps depends on what is so many pixels away, and that is
    the halo of a block."""
    keys = list(keys)
    small = (F.col("size") < T.mmu_pixels(F.col(value))) & (F.col(value) != nodata)
    px = components(df, value, 8, nodata, keys, block).withColumn("_pending", F.coalesce(small, F.lit(False)))
    near = with_halo(px.select(*keys, "row", "col", F.coalesce(value, F.lit(nodata)).cast("long").alias("_v"), "_pending"), block, sweeps + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = _grid(pdf, "_v", nodata)
        at = (pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0)
        pending = np.zeros(grid.shape, bool)
        pending[at] = pdf["_pending"].to_numpy(bool)
        out, left = _sweep(grid, pending, nodata, sweeps)
        valid = np.pad((out != nodata) & ~left, 1)
        inner = valid[:-2, 1:-1] & valid[2:, 1:-1] & valid[1:-1, :-2] & valid[1:-1, 2:]
        own = pdf["_own"].to_numpy(bool)
        # the nearest valid pixel always has a neighbour that is not valid
        rim = valid[1:-1, 1:-1] & ~inner
        return pdf[own][[*keys, "row", "col"]].assign(_new=out[at][own], _left=left[at][own], _rim=rim[at][own])

    kinds = dict(df.dtypes)
    swept = written(near.groupBy(*keys, "_br", "_bc").applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "row", "col"]) + ", _new long, _left boolean, _rim boolean"))
    left = swept.where("_left").select(*keys, "row", "col")
    found = _nearest(left, swept.where("_rim").select(*keys, "row", "col", "_new"), keys)
    out = df.join(swept.select(*keys, "row", "col", "_new", "_left"), [*keys, "row", "col"])
    if found is None:
        return out.select(*df.columns, F.col("_new").cast("int").alias("sieved"))
    out = out.join(found, [*keys, "row", "col"], "left")
    return out.select(*df.columns, F.coalesce("_found", "_new").cast("int").alias("sieved"))


def _nearest(left: DataFrame, rim: DataFrame, keys) -> DataFrame | None:
    """(keys, row, col, _found): the value of the nearest pixel of ``rim``, by cells of
    a size that grows until all are found. Tiles without any keep their pixels."""
    open_, out, size = written(left.join(rim.select(*keys).distinct(), keys, "left_semi")), None, 64
    while not open_.isEmpty():
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))  # noqa: B023, E731
        ask = open_.select("*", around("row").alias("_cr")).select("*", around("col").alias("_cc"))
        have = rim.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), "_new", cell("row").alias("_cr"), cell("col").alias("_cc"))
        far = lambda a, b: (F.col(a) - F.col(b)).cast("long") * (F.col(a) - F.col(b))
        met = ask.join(have, [*keys, "_cr", "_cc"]).withColumn("_d", far("row", "_r") + far("col", "_c")).where(F.col("_d") <= size * size)
        got = written(met.groupBy(*keys, "row", "col").agg(F.min_by("_new", F.struct("_d", "_r", "_c")).alias("_found")))
        out = got if out is None else out.unionByName(got)
        open_ = written(open_.join(got, [*keys, "row", "col"], "left_anti"))
        size *= 4
    return out


def sieve_merge(df: DataFrame, value: str = "value", size: int = 6, nodata: int = 0, keys=("tile",), block: int = BLOCK) -> DataFrame:
    """``df`` with ``sieved``: 4-connected patches below ``size`` join the largest patch
    they touch (the first by row and column of equals).

    In rounds on the graph of patches: every small patch that touches a larger one (or
    an equal one that comes first) takes its class, along with those that join the
    small patch itself; patches of one class that touch now are one. Rounds end when
    no small patch touches another patch. Only small patches change, so that only
    their pixels are looked up."""
    keys = list(keys)
    px = written(components(df, value, 4, nodata, keys, block))
    patches = written(px.where("component > 0").groupBy(*keys, "component").agg(F.min(value).cast("long").alias("v"), F.count("*").alias("n")).withColumnRenamed("component", "id"))
    touch = written(_touching(px, keys))
    # where the small patches are: (keys, component, id)
    stands = patches.where(F.col("n") < size).select(*keys, F.col("id").alias("component"), "id")
    moved = False
    while True:
        end = lambda p: patches.select(*keys, F.col("id").alias(p), F.col("n").alias(f"{p}_n"))  # noqa: B023, E731
        small = touch.join(end("a").where(F.col("a_n") < size), [*keys, "a"]).join(end("b"), [*keys, "b"])
        larger = (F.col("b_n") > F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b") < F.col("a")))
        to = small.groupBy(*keys, "a").agg(F.min(F.when(larger, F.struct((-F.col("b_n")).alias("x"), F.col("b").alias("b"))))["b"].alias("to")).where("to is not null")
        to = written(to)
        if to.isEmpty():
            break
        patches, touch, became = _joined(patches, touch, to, keys)
        stands = written(stands.join(became, [*keys, "id"], "left").select(*keys, "component", F.coalesce("now", "id").alias("id")))
        moved = True
    if not moved:
        return px.select(*df.columns, F.col(value).cast("int").alias("sieved"))
    value_of = stands.join(patches.select(*keys, "id", "v"), [*keys, "id"]).select(*keys, "component", F.col("v").alias("_v"))
    low = px.where((F.col("component") > 0) & (F.col("size") < size)).join(value_of, [*keys, "component"])
    rest = px.where((F.col("component") == 0) | (F.col("size") >= size)).withColumn("_v", F.col(value).cast("long"))
    return low.select(*df.columns, F.col("_v").cast("int").alias("sieved")).unionByName(rest.select(*df.columns, F.col("_v").cast("int").alias("sieved")))


def _touching(px: DataFrame, keys) -> DataFrame:
    """(keys, a, b): components that share a pixel's edge, both ways."""
    out = None
    for along, across in (("col", "row"), ("row", "col")):
        w = Window.partitionBy(*keys, across).orderBy(along)
        near = px.where("component > 0").select(*keys, F.col("component").alias("a"), F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead("component").over(w)).alias("b"))
        near = near.where("a != b")
        out = near if out is None else out.unionByName(near)
    return out.unionByName(out.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _joined(patches: DataFrame, touch: DataFrame, to: DataFrame, keys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patches and their contacts after each ``a`` has joined its ``to``, and patches of
    one class that touch then each other; and (keys, id, now)."""
    root = to.withColumnRenamed("a", "id")
    while True:  # steps double along the chains
        on = root.select(*keys, F.col("id").alias("to"), F.col("to").alias("next"))
        longer = written(root.join(on, [*keys, "to"], "left").select(*keys, "id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")))
        root = longer.drop("more")
        if longer.where("more").isEmpty():
            break
    now = patches.join(root, [*keys, "id"], "left").withColumn("to", F.coalesce("to", "id"))
    now = now.join(patches.select(*keys, F.col("id").alias("to"), F.col("v").alias("to_v")), [*keys, "to"])
    now = written(now.select(*keys, "id", "to", F.col("to_v").alias("v"), "n"))
    end = lambda p: now.select(*keys, F.col("id").alias(p), F.col("to").alias(f"{p}_to"), F.col("v").alias(f"{p}_v"))
    met = written(touch.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).where("a_to != b_to").select(*keys, "a_to", "b_to", "a_v", "b_v").distinct())
    node = lambda c: F.struct(*keys, F.col(c).alias("at"))
    same = written(met.where("a_v = b_v").select(node("a_to").alias("a"), node("b_to").alias("b")))
    one = same.select(F.col("a").alias("node"), F.col("a").alias("component")) if same.isEmpty() else rounds.components(same.select(F.col("a").alias("node")).distinct(), same)
    one = written(one.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.at").alias("to"), F.col("component.at").alias("one")))
    became = written(now.join(one, [*keys, "to"], "left").select(*keys, "id", F.coalesce("one", "to").alias("now"), "v", "n"))
    # the first pixel of a united patch is that of its first member
    name = became.groupBy(*keys, "now").agg(F.min("id").alias("name"), F.min("v").alias("v"), F.sum("n").alias("n"))
    became = written(became.select(*keys, "id", "now").join(name.select(*keys, "now", "name"), [*keys, "now"]).select(*keys, "id", F.col("name").alias("now")))
    new = written(name.select(*keys, F.col("name").alias("id"), "v", "n"))
    to_now = lambda p: became.select(*keys, F.col("id").alias(p), F.col("now").alias(f"{p}_now"))
    contacts = written(touch.join(to_now("a"), [*keys, "a"]).join(to_now("b"), [*keys, "b"]).where("a_now != b_now").select(*keys, F.col("a_now").alias("a"), F.col("b_now").alias("b")).distinct())
    return new, contacts, became


def sieve(df: DataFrame, value: str = "value", how: str = "majority", size: int = 6, nodata: int = 0, keys=("tile",), block: int = BLOCK) -> DataFrame:
    """``df`` with ``sieved``, by ``sieve_majority`` or ``sieve_merge``."""
    return sieve_majority(df, value, nodata, keys, block=block) if how == "majority" else sieve_merge(df, value, size, nodata, keys, block)


# --- polygons --------------------------------------------------------------------

#: Steps east, south, west, north: clockwise with rows growing downward.
STEP = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])


def _edges(comp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(component, row, col, direction) of the unit edges of own pixels, each with its
    pixel on the right."""
    pad = np.pad(comp, 1)
    found = []
    for d, (i, j, di, dj) in enumerate([(-1, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (0, -1, 1, 0)]):
        other = pad[1 + i : pad.shape[0] - 1 + i, 1 + j : pad.shape[1] - 1 + j]
        r, c = np.nonzero(own & (comp > 0) & (other != comp))
        found.append((comp[r, c], r + di, c + dj, np.full(len(r), d)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _follow(k: np.ndarray, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(k, row, col, directions): paths along the edges of each ``k``, closed ones or
    from where no edge leads on. At a corner where two paths cross, each goes on along
    the pixel on its right."""
    if not len(k):
        return []
    r0, c0 = int(r.min()) - 1, int(c.min()) - 1
    width, height = int(c.max()) - c0 + 3, int(r.max()) - r0 + 3
    code = lambda r, c: ((k * height + r - r0) * width) + c - c0
    begin, end = code(r, c), code(r + STEP[d, 0], c + STEP[d, 1])
    order = np.argsort(begin, kind="stable")
    sorted_ = begin[order]
    lo, hi = np.searchsorted(sorted_, end), np.searchsorted(sorted_, end, "right")
    one = order[np.minimum(lo, len(order) - 1)]
    two = order[np.minimum(lo + 1, len(order) - 1)]
    right = (d + 1) % 4
    after = np.where(hi == lo, -1, np.where((hi - lo == 2) & (d[one] != right), two, one))
    heads = np.ones(len(k), bool)
    heads[after[after >= 0]] = False
    seen, out, after, dirs = np.zeros(len(k), bool), [], after.tolist(), d.tolist()
    for start in [*np.flatnonzero(heads).tolist(), *range(len(k))]:
        if seen[start]:
            continue
        path, e = [], start
        while e >= 0 and not seen[e]:
            seen[e] = True
            path.append(dirs[e])
            e = after[e]
        out.append((int(k[start]), int(r[start]), int(c[start]), bytes(path)))
    return out


def _corners(r: int, c: int, path: bytes) -> np.ndarray:
    """The corners that a path visits, its start and its end included."""
    steps = STEP[np.frombuffer(path, np.uint8)]
    return np.concatenate([[(r, c)], np.cumsum(steps, axis=0) + (r, c)])


def _ring(points: np.ndarray) -> list[list[int]]:
    """A closed path from its first corner by row and column, without the repeated end."""
    points = points[:-1]
    nxt = np.roll(points, -1, axis=0)
    first = np.lexsort((nxt[:, 1], nxt[:, 0], points[:, 1], points[:, 0]))[0]
    return np.roll(points, -first, axis=0).tolist()


def _rings(rows) -> list[list[list[int]]]:
    """Rings of one component from its chains (row, col, path), in order of their first
    corners. An open chain goes on where another one begins."""
    out, begins = [], {}
    for r, c, path in rows:
        points = _corners(r, c, path)
        if (points[0] == points[-1]).all():
            out.append(_ring(points))
        else:
            begins[tuple(points[0].tolist())] = points
    while begins:
        at, points = begins.popitem()
        parts = [points]
        while tuple(parts[-1][-1].tolist()) != at:
            parts.append(begins.pop(tuple(parts[-1][-1].tolist())))
        out.append(_ring(np.concatenate([p[:-1] for p in parts] + [parts[-1][-1:]])))
    return sorted(out)


def ring_area(ring: list[tuple[int, int]]) -> float:
    """Positive for outer rings, negative for holes."""
    return 0.5 * sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1]))


def polygonize(df: DataFrame, value: str = "value", connectivity: int = 8, nodata: int = 0, keys=("tile",), block: int = BLOCK) -> DataFrame:
    """(keys, patch_id, class_id, n_pixels, rings): one polygon a component. Rings are
    corners (row, col) a pixel apart, outer ones clockwise as seen with rows growing
    downward, holes the other way; diagonal contacts stay apart.

    Blocks follow the edges of their own pixels, knowing one pixel around them; what
    is joined for a component are its chains of edges."""
    keys = list(keys)
    px = written(components(df, value, connectivity, nodata, keys, block))
    near = with_halo(px.select(*keys, "row", "col", "component"), block, 1)

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        comp, r0, c0 = _grid(pdf, "component", 0)
        own = np.zeros(comp.shape, bool)
        own[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf["_own"].to_numpy(bool)
        head = [pdf[x].iloc[0] for x in keys]
        rows = [(*head, k, r + r0, c + c0, path) for k, r, c, path in _follow(*_edges(comp, own))]
        return pd.DataFrame(rows, columns=[*keys, "patch_id", "r", "c", "path"])

    def rings(batches):
        for b in batches:
            found = [_rings((x["r"], x["c"], x["path"]) for x in own) for own in b.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, ARROW_RINGS)], names=[*b.schema.names[:-1], "rings"])

    kinds = dict(df.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    lines = near.groupBy(*keys, "_br", "_bc").applyInPandas(chains, f"{head}, patch_id long, r int, c int, path binary")
    # a patch's chains are one row, and a task takes many patches at a time
    lines = lines.groupBy(*keys, "patch_id").agg(F.collect_list(F.struct("r", "c", "path")).alias("lines"))
    shapes = lines.mapInArrow(rings, f"{head}, patch_id long, rings array<array<array<int>>>")
    own = px.where("component > 0").groupBy(*keys, F.col("component").alias("patch_id")).agg(F.min(value).cast("int").alias("class_id"), F.count("*").alias("n_pixels"))
    return own.join(shapes, [*keys, "patch_id"])


def dissolve_rings(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rings) of the union of polygons that do not overlap, ``df(keys, rings)`` as
    ``polygonize`` gives them: edges that two polygons share in opposite directions go,
    the others are linked into rings, holes apart."""
    point = F.explode(F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    edges = df.select(*keys, F.explode("rings").alias("ring")).select(*keys, point.alias("e"))
    dr, dc = F.col("e.b")[0] - F.col("e.a")[0], F.col("e.b")[1] - F.col("e.a")[1]
    d = F.when(dc == 1, 0).when(dr == 1, 1).when(dc == -1, 2).otherwise(3)
    edges = edges.select(*keys, F.col("e.a")[0].alias("r"), F.col("e.a")[1].alias("c"), d.alias("d"))
    # an edge by its upper left end and whether it lies: of a shared one both directions are there
    r, c = F.col("r") - (F.col("d") == 3).cast("int"), F.col("c") - (F.col("d") == 2).cast("int")
    left = edges.groupBy(*keys, r.alias("_r"), c.alias("_c"), (F.col("d") % 2).alias("_h")).agg(F.count("*").alias("n"), F.min("r").alias("r"), F.min("c").alias("c"), F.min("d").alias("d")).where("n = 1")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, d = (pdf[x].to_numpy(np.int64) for x in ("r", "c", "d"))
        return pdf.iloc[:1][keys].assign(rings=[_rings((r, c, path) for _, r, c, path in _follow(np.zeros(len(r), np.int64), r, c, d))])

    kinds = dict(df.dtypes)
    return left.select(*keys, "r", "c", "d").groupBy(*keys).applyInPandas(link, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", rings array<array<array<int>>>")
