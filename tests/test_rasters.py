"""Raster files against plain NumPy."""

import io
import struct
import zlib

import numpy as np
import pytest
from landcube.operators import spatial as S
from landcube.sources import file_sink
from landcube.sources import raster_files as R
from landcube.sources import tiff as T
from pyspark.sql import functions as F


def make(a, block=16, predictor=1, nodata=0.0, epsg=32719, x0=300000.0, y0=6300000.0, step=30.0):
    """A tiled file's bytes, and its directory."""
    h, w, bands = a.shape
    d = T.Directory(w, h, a.dtype.newbyteorder("<"), [f"n{i}" for i in range(bands)], x0, y0, step, -step, epsg, nodata, block, block, predictor=predictor)
    pad = np.zeros((d.down * block, d.across * block, bands), a.dtype)
    pad[:h, :w] = a
    data = [T.encode_block(pad[i // d.across * block :, i % d.across * block :][:block, :block], d) for i in range(d.across * d.down)]
    d.counts = [len(x) for x in data]
    return T.header(d) + b"".join(data), d


def whole(f):
    d = T.read_directory(f)
    out = np.zeros((d.height, d.width, len(d.names)), d.dtype.newbyteorder("="))
    for i in range(d.across * d.down):
        x = T.read_block(f, d, i)
        r, c = i // d.across * d.block_h, i % d.across * d.block_w
        out[r : r + x.shape[0], c : c + x.shape[1]] = x
    return d, out


@pytest.mark.parametrize("kind", ["u1", "i1", "i2", "u2", "i4", "u4", "f4", "f8"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_blocks_round_trip(kind, predictor):
    rng = np.random.default_rng(1)
    for h, w, bands, block in ((7, 10, 1, 16), (130, 90, 3, 32), (32, 32, 2, 32)):
        a = (rng.random((h, w, bands)) * 250 - (100 if kind[0] != "u" else 0)).astype(kind)
        data, d = make(a, block, predictor, nodata=-9999.0 if kind[0] == "f" else 0.0)
        e, out = whole(io.BytesIO(data))
        assert (out == a).all() and (e.x0, e.y0, e.dx, e.dy, e.epsg, e.nodata, e.names) == (d.x0, d.y0, d.dx, d.dy, d.epsg, d.nodata, d.names)


def classic(a, order, compression, planar=1, predictor=1, rows=5, large=False):
    """A striped file written by hand: another layout than ours."""
    h, w, bands = a.shape
    strips = []
    for b in range(bands if planar == 2 else 1):
        part = a[:, :, b : b + 1] if planar == 2 else a
        for r in range(0, h, rows):
            x = part[r : r + rows].astype(a.dtype.newbyteorder(order))
            if predictor == 2:
                v = part[r : r + rows].view(f"u{a.itemsize}")
                x = np.concatenate([v[:, :1], np.diff(v, axis=1)], axis=1).astype(np.dtype(f"u{a.itemsize}").newbyteorder(order))
            if predictor == 3:
                n = x.shape[0]
                planes = part[r : r + rows].astype(a.dtype.newbyteorder(">")).reshape(n, -1).view(np.uint8).reshape(n, -1, a.itemsize).transpose(0, 2, 1).reshape(n, -1, x.shape[2])
                x = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)
            raw = x.tobytes()
            strips.append(zlib.compress(raw) if compression == 8 else lzw(raw) if compression == 5 else raw)
    word, head, start = ("Q", 20, 16) if large else ("I", 12, 8)
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [a.itemsize * 8] * bands), (259, 3, [compression]), (273, 16 if large else 4, None), (277, 3, [bands]), (278, 3, [rows]),
               (279, 16 if large else 4, [len(s) for s in strips]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * bands), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0, 0, 500.0, 900.0, 0])]
    inline = 8 if large else 4
    extra_at = start + (8 if large else 2) + len(entries) * head + inline
    size = lambda k, n: {3: 2, 4: 4, 12: 8, 16: 8}[k] * n
    total = sum(size(k, len(v or strips)) for _, k, v in entries if size(k, len(v or strips)) > inline)
    at, places = extra_at + total, []
    for s in strips:
        places.append(at)
        at += len(s)
    body = extra = b""
    for tag, k, v in entries:
        v = places if v is None else v
        data = struct.pack(order + str(len(v)) + {3: "H", 4: "I", 12: "d", 16: "Q"}[k], *v)
        if len(data) > inline:
            data, extra = struct.pack(order + word, extra_at + len(extra)), extra + data
        body += struct.pack(order + "HH" + word, tag, k, len(v)) + data.ljust(inline, b"\0")
    mark = b"II" if order == "<" else b"MM"
    begin = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if large else struct.pack(order + "HI", 42, 8))
    return begin + struct.pack(order + ("Q" if large else "H"), len(entries)) + body + b"\0" * inline + extra + b"".join(strips)


def lzw(data):
    """A plain encoder: after entry 511 codes have ten bits, after 4094 all is cleared."""
    out, bits, held = bytearray(), 0, 0
    table, width, word = {}, 9, b""

    def put(code):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    def clear():
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    for b in data:
        both = word + bytes([b])
        if both in table:
            word = both
            continue
        put(table[word])
        table[both] = len(table) + 2
        word = bytes([b])
        if len(table) + 2 == 4095:
            clear()
        elif len(table) + 2 in (512, 1024, 2048):
            width += 1
    put(table[word]) if word else None
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_other_layouts(order, compression):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 60, (23, 117, 2)).astype("u2")
    for planar in (1, 2):
        for predictor in (1, 2):
            for large in (False, True):
                d, out = whole(io.BytesIO(classic(a, order, compression, planar, predictor, large=large)))
                assert (out == a).all() and (d.x0, d.y0, d.dx, d.dy, d.tiled) == (500.0, 900.0, 10.0, -10.0, False)
    f = rng.random((9, 40, 1)).astype("f4")
    assert (whole(io.BytesIO(classic(f, order, compression, predictor=3)))[1] == f).all()


def test_lzw_of_many_codes():
    """Long enough for every width of codes and for cleared tables."""
    rng = np.random.default_rng(9)
    for data in (bytes(rng.integers(0, 256, 60_000, np.uint8)), bytes(rng.integers(0, 3, 60_000, np.uint8)), b"", b"a" * 30_000):
        assert T._lzw(lzw(data)) == data


def test_refused():
    with pytest.raises(ValueError):
        T.read_directory(io.BytesIO(b"GIF89a" + b"\0" * 40))


def plain(df):
    return {(r.name, r.row, r.col): tuple(r[c] for c in df.columns if c.startswith("n") and c != "name") for r in df.collect()}


def test_read_pixel_for_pixel(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for name, kind in (("A_2001", "u2"), ("B_2002", "u2")):
        a = rng.integers(0, 5, (45, 70, 2)).astype(kind)
        (tmp_path / f"{name}.tif").write_bytes(make(a, 16)[0])
        want |= {(name, r, c): tuple(int(v) or None for v in a[r, c]) for r in range(45) for c in range(70)}
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x" / "half.tif").write_bytes(b"II")
    df = R.read(spark, str(tmp_path))
    assert df.columns == ["name", "year", "row", "col", "x", "y", "n0", "n1"] and plain(df) == want
    r = df.where("name = 'B_2002' and row = 3 and col = 5").first()
    assert (r.year, r.x, r.y) == (2002, 300000 + 5.5 * 30, 6300000 - 3.5 * 30)
    assert plain(R.read(spark, str(tmp_path), years=[2001, 1999])) == plain(R.read(spark, str(tmp_path), names=["A_2001"])) == {k: v for k, v in want.items() if k[0] == "A_2001"}
    assert plain(df.where("year = 2001")) == {k: v for k, v in want.items() if k[0] == "A_2001"} and df.count() == len(want)
    assert plain(R.read(spark, str(tmp_path), bands=["n1"])) == {k: v[1:] for k, v in want.items()}
    assert R.read(spark, str(tmp_path), nodata=3).where("n0 is null").count() == sum(v[0] == 3 for v in want.values())
    # a large file is many tasks, small files are one
    split = R.read(spark, str(tmp_path), max_bytes=500)
    assert split.rdd.getNumPartitions() > 4 and df.rdd.getNumPartitions() == 1 and plain(split) == want
    with pytest.raises(Exception, match="no such band"):
        R.read(spark, str(tmp_path), bands=["n7"]).count()


def test_a_window_reads_its_blocks_alone(spark, tmp_path):
    """Every other block is broken, and no one notices."""
    a = np.arange(64 * 64, dtype="i4").reshape(64, 64, 1) + 1
    data, d = make(a, 16)
    e = T.read_directory(io.BytesIO(data))
    broken = bytearray(data)
    for i in range(16):
        if i not in (5, 6):  # rows 16 to 31, columns 16 to 47
            broken[e.offsets[i] : e.offsets[i] + e.counts[i]] = b"\xff" * e.counts[i]
    (tmp_path / "w.tif").write_bytes(bytes(broken))
    path = str(tmp_path / "w.tif")
    got = plain(R.read(spark, path, window=(18, 31, 20, 40)))
    assert got == {("w", r, c): (int(a[r, c, 0]),) for r in range(18, 31) for c in range(20, 40)}
    y, x = 6300000 - 20.5 * 30, 300000
    assert R.read(spark, path, box=(x + 16 * 30, y, x + 48 * 30, y + 1)).count() == 32
    assert R.read(spark, path, names=["other"]).count() == 0
    with pytest.raises(Exception, match="block 0"):
        R.read(spark, path).count()
    lenient = R.read(spark, str(tmp_path / "w.tif"), lenient=True)
    assert lenient.where("error is not null and n0 is null").count() == 64 * 64 - 512 and lenient.where("n0 is not null").count() == 512


def test_nearest_on_another_grid(spark, tmp_path):
    """Degrees onto a UTM grid, and one zone onto the next, against the plain formula."""
    rng = np.random.default_rng(4)
    a = rng.integers(1, 200, (300, 260, 1)).astype("u1")
    degrees = dict(epsg=4326, x0=-71.0, y0=-33.0, step=0.001)
    for name, kw in (("deg", degrees), ("utm", dict(epsg=32719, x0=310000.0, y0=6340000.0, step=90.0))):
        (tmp_path / f"{name}.tif").write_bytes(make(a, 32, **kw)[0])
        grid = R.Grid(32719 if name == "deg" else 32718, 310000.0 if name == "deg" else 870000.0, 6345000.0, 100.0, -100.0, 280, 310)
        df = R.read(spark, str(tmp_path / f"{name}.tif"), target=grid)
        px = df.select("row", "col", "x", "y", "n0")
        x, y = (S.from_utm(F.col("x"), F.col("y"), F.lit(19 if name == "deg" else 18)))
        px = px.withColumns({"a": x, "b": y})
        if name == "utm":
            e, n = S.to_utm(F.col("a"), F.col("b"), F.lit(19))
            px = px.withColumns({"a": e, "b": n})
        rows = px.collect()
        assert len(rows) == 280 * 310 and any(r.n0 is None for r in rows) and any(r.n0 for r in rows)
        wrong = 0
        for r in rows:
            i, j = int(np.floor((kw["y0"] - r.b) / kw["step"])), int(np.floor((r.a - kw["x0"]) / kw["step"]))
            wrong += r.n0 != (int(a[i, j, 0]) if 0 <= i < 300 and 0 <= j < 260 else None)
        assert wrong <= 2  # a centre on a pixel's edge
        assert R.read(spark, str(tmp_path / f"{name}.tif"), target=grid, window=(0, 10, 100, 121)).count() == 210


def test_stack_with_a_lost_scene(spark, tmp_path):
    a = np.arange(12, dtype="u2").reshape(3, 4, 1) + 1
    (tmp_path / "good.tif").write_bytes(make(a, 16, nodata=None)[0])
    (tmp_path / "lost.tif").write_bytes(b"not a raster at all")
    grid = R.Grid(32719, 300000.0, 6300000.0, 30.0, -30.0, 5, 3)
    out = R.stack(spark, [str(tmp_path / "good.tif")], grid, ["n0"]).collect()
    assert {(r.row, r.col): r.n0 for r in out} == {(r, c): int(a[r, c, 0]) if c < 4 else 65535 for r in range(3) for c in range(5)}
    schema = R.read(spark, str(tmp_path / "good.tif"), lenient=True).schema
    px = spark.read.format("landcube_raster").schema(schema).option("path", str(tmp_path / "lost.tif")).option("mode", "PERMISSIVE").load().collect()
    assert len(px) == 1 and px[0].row is None and "not a TIFF" in px[0].error


def pixels(spark, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(n, r, c, int(v), float(v) / 3) for n, h, w in (("one", 40, 50), ("two", 5, 7)) for r in range(h) for c in range(w) if (v := rng.integers(0, 6)) and not (n == "one" and r >= 32 and c < 16)]
    grids = [(n, 32719, 300000.0, 6300000.0, 30.0, -30.0, w, h) for n, w, h in (("one", 50, 40), ("two", 7, 5), ("none", 3, 3))]
    return rows, spark.createDataFrame(rows, "name string, row int, col int, a int, b double"), spark.createDataFrame(grids, "name string, epsg int, x0 double, y0 double, dx double, dy double, width int, height int")


@pytest.mark.parametrize("kind,predictor,nodata", [("f4", 2, float("nan")), ("f8", 1, -9999.0), ("i4", 1, 0)])
def test_write_then_read(spark, tmp_path, kind, predictor, nodata):
    rows, px, grids = pixels(spark)
    off = spark.createDataFrame([("one", 99, 1, 1, 1.0), ("unknown", 0, 0, 1, 1.0), ("two", 0, 0, None, None)], px.schema)
    bands = ["a"] if kind == "i4" else ["a", "b"]
    R.write(px.unionByName(off), str(tmp_path / "o"), grids, bands, kind, nodata, block=16, predictor=predictor)
    back = R.read(spark, str(tmp_path / "o")).where(" or ".join(f"{b} is not null" for b in bands)).collect()
    cast = lambda v: float(np.dtype(kind).type(v))
    assert {(r.name, r.row, r.col, *(r[b] for b in bands)) for r in back} == {(n, r, c, *(cast(v) for v in (a, b)[: len(bands)])) for n, r, c, a, b in rows}
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["none.tif", "one.tif", "two.tif"]
    d = T.read_directory(open(tmp_path / "o" / "one.tif", "rb"))
    assert (d.block_w, d.tiled, d.compression, d.predictor, d.names, d.epsg) == (16, True, 8, predictor, bands, 32719)
    assert (d.nodata == nodata or d.nodata != d.nodata) and d.counts.count(0) == 1  # the empty corner takes no room
    R.write(px.where("name = 'two'"), str(tmp_path / "o"), grids.where("name = 'two'"), ["a"], "u1", 0, overwrite=True)
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["two.tif"] and R.read(spark, str(tmp_path / "o")).count() == 35


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    data, _ = make(np.ones((4, 4, 1), "u1"), 16)
    w = file_sink.FilesWriter({"path": str(tmp_path / "o"), "suffix": ".tif"}, False)

    def rows(fail):
        yield {"name": "x", "place": -1, "data": data[:50]}
        if fail:
            raise OSError("executor lost")
        yield {"name": "x", "place": 0, "data": data[50:]}

    with pytest.raises(OSError):
        w.write(rows(True))
    assert not list((tmp_path / "o").glob("*.tif"))
    w.commit([w.write(rows(False))])
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["x.tif"] and (tmp_path / "o" / "x.tif").read_bytes() == data
    w = file_sink.FilesWriter({"path": str(tmp_path / "o"), "suffix": ".tif"}, False)
    w.write(rows(False))
    w.abort([])
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["x.tif"]
