"""Raster files as tables: a data source for tiled TIFF files, and their sink.

``read`` gives a row for each pixel: (name, year, row, col, x, y, one column a band),
x and y being the pixel's centre and a masked pixel NULL. A task reads the blocks of
a part of one file, or several small files, and of each file its directory first;
the driver lists files and reads one directory, for the columns. ``names`` and
``years`` choose files, ``window`` (rows and columns) and ``box`` (coordinates) choose
blocks, and ``bands`` columns. They are arguments, not pushed filters: with PySpark
4.1 a Python source's pushed filters stay with the DataFrame and would be applied to
later queries of it as well.

With a ``target`` grid, rows are that grid's pixels, each with the value of the
source pixel below its centre (nearest), across UTM zones and degrees: tasks are
windows of the target and read the source blocks below them. Outside the source a
pixel is NULL.

``write`` encodes blocks in parallel, one group of pixels each; their sizes make each
file's header, and header and blocks are streamed to the file (``file_sink``).

Paths are URIs that pyarrow reaches (file, s3, gs, hdfs, abfs), since a task reads
ranges of files.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import spatial as S
from ..operators.rounds import written
from . import tiff
from .file_sink import list_files, open_uri, write_files
from .tiff import Directory

SUFFIXES = (".tif", ".tiff")
#: Column types that hold every value of a sample type.
TYPES = {"u1": "short", "i1": "byte", "i2": "short", "u2": "int", "i4": "int", "u4": "long", "f4": "float", "f8": "double"}
ARROW = {"short": pa.int16(), "byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass(frozen=True)
class Grid:
    """A north-up raster grid: upper left corner, steps (dy below 0) and size."""

    epsg: int
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int


def stem(path: str) -> str:
    return re.sub(r"\.tiff?$", "", path.rsplit("/", 1)[-1], flags=re.I)


def year_of(name: str) -> int | None:
    """The last number of four digits that stands alone in a name."""
    found = re.findall(r"(?<!\d)(\d{4})(?!\d)", name)
    return int(found[-1]) if found else None


def _degrees(x: np.ndarray, y: np.ndarray, epsg: int):
    if epsg == 4326:
        return x, y
    if epsg // 100 in (326, 327):
        return S.from_utm(x, y, epsg % 100, epsg // 100 == 327, np)
    raise ValueError(f"EPSG:{epsg} is neither degrees nor UTM")


def reproject(x: np.ndarray, y: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates from one system in another."""
    if source == target:
        return x, y
    lon, lat = _degrees(x, y, source)
    if target == 4326:
        return lon, lat
    if target // 100 not in (326, 327):
        raise ValueError(f"EPSG:{target} is neither degrees nor UTM")
    return S.to_utm(lon, lat, target % 100, target // 100 == 327, np)


@dataclass
class Part(InputPartition):
    """Share ``k`` of ``n`` of each file's blocks (of the target's, if there is one)."""

    files: list[str]
    k: int = 0
    n: int = 1


class RasterReader(DataSourceReader):
    """Blocks to Arrow batches."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.bytes = int(options.get("maxbytes", 32 << 20))
        self.lenient = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.target = Grid(**json.loads(options["target"])) if "target" in options else None
        self.types = {f.name: f.dataType.simpleString().replace("bigint", "long").replace("smallint", "short").replace("tinyint", "byte") for f in schema}
        self.names, self.years = (set(json.loads(options[k])) if k in options else None for k in ("names", "years"))
        r0, r1, c0, c1 = json.loads(options.get("window", "[-2147483648, 2147483648, -2147483648, 2147483648]"))
        x0, y0, x1, y1 = json.loads(options["box"]) if "box" in options else (-math.inf, -math.inf, math.inf, math.inf)
        self.span = {"row": (r0, r1), "col": (c0, c1), "x": (x0, x1), "y": (y0, y1)}  # from, to before

    def _chosen(self, path: str) -> bool:
        name = stem(path)
        return (self.names is None or name in self.names) and (self.years is None or year_of(name) in self.years)

    def partitions(self) -> list[Part]:
        parts, small, held = [], [], 0
        for path, size in list_files(self.path, SUFFIXES):
            if not self._chosen(path):
                continue
            if self.target is not None:
                windows = -(-self.target.width // 256) * -(-self.target.height // 256)
                n = -(-windows // 16)
            else:
                n = -(-size // self.bytes)
            if n > 1:
                parts += [Part([path], k, n) for k in range(n)]
                continue
            small.append(path)
            held += max(size, 1)
            if held >= self.bytes:
                parts.append(Part(small))
                small, held = [], 0
        return [*parts, *([Part(small)] if small else [])] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = open_uri(self.path)
        for path in partition.files:
            try:
                with store.open_input_file(path) as f:
                    d = tiff.read_directory(f)
                    if self.nodata is not None:
                        d.nodata = self.nodata
                    yield from (self._warped if self.target else self._blocks)(f, d, stem(path), partition.k, partition.n)
            except (ValueError, OSError) as e:
                if not self.lenient:
                    raise ValueError(f"{path}: {e}") from e
                yield self._batch(stem(path), np.zeros(1, np.int64), np.zeros(1, np.int64), None, None, f"{e}", whole=True)

    def _met(self, g, r: int, c: int, h: int, w: int) -> bool:
        """Whether a pixel of a block is in the window and the box."""
        xs, ys = sorted((g.x0 + (c + 0.5) * g.dx, g.x0 + (c + w - 0.5) * g.dx)), sorted((g.y0 + (r + 0.5) * g.dy, g.y0 + (r + h - 0.5) * g.dy))
        block = {"row": (r, r + h - 1), "col": (c, c + w - 1), "x": xs, "y": ys}
        return all(high >= self.span[k][0] and low < self.span[k][1] for k, (low, high) in block.items())

    def _bands(self, d: Directory) -> list[int]:
        return [d.names.index(c) for c in self.columns if c in d.names]

    def _blocks(self, f, d: Directory, name: str, k: int, n: int) -> Iterator[pa.RecordBatch]:
        total = d.across * d.down
        for i in range(total * k // n, total * (k + 1) // n):
            r, c = i // d.across * d.block_h, i % d.across * d.block_w
            h, w = min(d.block_h, d.height - r), min(d.block_w, d.width - c)
            if not self._met(d, r, c, h, w):
                continue
            error = None
            try:
                x = tiff.read_block(f, d, i, self._bands(d))
            except Exception as e:  # a broken block: zlib, lengths, codes
                if not self.lenient:
                    raise ValueError(f"block {i}: {e}") from e
                x, error = None, f"block {i}: {e}"
            rows, cols = np.repeat(np.arange(r, r + h), w), np.tile(np.arange(c, c + w), h)
            yield self._batch(name, rows, cols, None if x is None else x.reshape(h * w, -1), d, error)

    def _warped(self, f, d: Directory, name: str, k: int, n: int) -> Iterator[pa.RecordBatch]:
        g, size = self.target, 256
        across = -(-g.width // size)
        total = across * -(-g.height // size)
        bands = self._bands(d)
        for i in range(total * k // n, total * (k + 1) // n):
            r, c = i // across * size, i % across * size
            h, w = min(size, g.height - r), min(size, g.width - c)
            if not self._met(g, r, c, h, w):
                continue
            rows, cols = np.repeat(np.arange(r, r + h), w), np.tile(np.arange(c, c + w), h)
            x, y = reproject(g.x0 + (cols + 0.5) * g.dx, g.y0 + (rows + 0.5) * g.dy, g.epsg, d.epsg or g.epsg)
            sr, sc = np.floor((y - d.y0) / d.dy).astype(np.int64), np.floor((x - d.x0) / d.dx).astype(np.int64)
            inside = (sr >= 0) & (sr < d.height) & (sc >= 0) & (sc < d.width)
            block = np.where(inside, sr // d.block_h * d.across + sc // d.block_w, -1)
            values, known = np.zeros((h * w, len(bands)), d.dtype), np.zeros(h * w, bool)
            for b in np.unique(block[inside]):
                data = tiff.read_block(f, d, int(b), bands)
                if data is not None:
                    at = block == b
                    values[at], known[at] = data[sr[at] % d.block_h, sc[at] % d.block_w], True
            yield self._batch(name, rows, cols, values, d, None, known=known)

    def _batch(self, name, rows, cols, x, d, error, known=None, whole=False) -> pa.RecordBatch:
        g = self.target or d
        if not whole:
            at = {"row": rows, "col": cols, "x": g.x0 + (cols + 0.5) * g.dx, "y": g.y0 + (rows + 0.5) * g.dy}
            keep = np.logical_and.reduce([(v >= self.span[k][0]) & (v < self.span[k][1]) for k, v in at.items()])
            if not keep.all():
                rows, cols = rows[keep], cols[keep]
                x, known = (None if v is None else v[keep] for v in (x, known))
        n = len(rows)
        out = {"name": pa.array([name] * n, pa.string()), "year": pa.array([year_of(name)] * n, pa.int32())}
        if whole:
            out |= {c: pa.nulls(n, ARROW[self.types[c]]) for c in ("row", "col", "x", "y")}
        else:
            out |= {"row": pa.array(rows.astype(np.int32)), "col": pa.array(cols.astype(np.int32)), "x": pa.array(g.x0 + (cols + 0.5) * g.dx), "y": pa.array(g.y0 + (rows + 0.5) * g.dy)}
        at = {c: i for i, c in enumerate(c for c in self.columns if d is not None and c in d.names)}
        for c in self.columns:
            if c in out:
                continue
            if c == "error":
                out[c] = pa.array([error] * n, pa.string())
            elif x is None or c not in at:
                out[c] = pa.nulls(n, ARROW[self.types[c]])
            else:
                v = x[:, at[c]]
                v = v.astype(v.dtype.newbyteorder("="))
                gone = np.zeros(n, bool) if known is None else ~known
                if v.dtype.kind == "f":
                    gone = gone | np.isnan(v)
                if d.nodata is not None and d.nodata == d.nodata:
                    gone = gone | (v == d.nodata)
                out[c] = pa.array(v, mask=gone).cast(ARROW[self.types[c]])
        return pa.RecordBatch.from_arrays([out[c] for c in self.columns], names=self.columns)


class RasterSource(DataSource):
    """``spark.read.format("landcube_raster")``; options path, bands, names, years, window
    and box (JSON lists), nodata, mode (FAILFAST or PERMISSIVE, which adds ``error``),
    target (a JSON object), maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "landcube_raster"

    def schema(self) -> str:
        files = list_files(self.options["path"], SUFFIXES)
        if not files:
            raise ValueError(f"no raster file in {self.options['path']}")
        store, _ = open_uri(self.options["path"])
        with store.open_input_file(files[0][0]) as f:
            d = tiff.read_directory(f)
        wanted = json.loads(self.options["bands"]) if "bands" in self.options else d.names
        if lost := [b for b in wanted if b not in d.names]:
            raise ValueError(f"no such band: {lost}")
        kind = TYPES[d.dtype.newbyteorder("=").str[1:]]
        more = ", error string" if self.options.get("mode", "").upper() == "PERMISSIVE" else ""
        return "name string, year int, row int, col int, x double, y double, " + ", ".join(f"`{b}` {kind}" for b in wanted) + more

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader({k.lower(): v for k, v in self.options.items()}, schema)


def read(
    spark: SparkSession, path: str, target: Grid | None = None, bands: list[str] | None = None, names: list[str] | None = None, years: list[int] | None = None,
    window: tuple[int, int, int, int] | None = None, box: tuple[float, float, float, float] | None = None, nodata: float | None = None, lenient: bool = False, max_bytes: int = 32 << 20,
) -> DataFrame:
    """Pixels of the files at or below ``path``; see the module. ``window`` is (first
    row, row after the last, first column, column after the last), ``box`` (x0, y0, x1,
    y1) without its upper ends. ``lenient`` leaves what can not be read NULL, with its
    reason in ``error``; a file whose directory is broken is one row without a place."""
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("landcube_raster").option("path", path).option("mode", "PERMISSIVE" if lenient else "FAILFAST").option("maxBytes", max_bytes)
    lists = {"bands": bands, "names": names, "years": years, "window": window, "box": box, "target": asdict(target) if target else None}
    for k, v in lists.items():
        if v is not None:
            reader = reader.option(k, json.dumps(v))
    return (reader if nodata is None else reader.option("nodata", str(nodata))).load()


def stack(spark: SparkSession, paths: list[str], target: Grid, bands: list[str], fill: int = 65535) -> DataFrame:
    """(name, row, col, bands, failed): scenes on one grid; what a scene lacks, and a
    file that can not be read, stays ``fill``, and ``failed`` has the reason."""
    out = None
    for path in paths:
        px = read(spark, path, target, bands, lenient=True)
        out = px if out is None else out.unionByName(px)
    broken = out.where("row is null").select("name", F.explode(F.sequence(F.lit(0), F.lit(target.height - 1))).alias("row"), F.col("error").alias("failed"))
    broken = broken.select("name", "row", F.explode(F.sequence(F.lit(0), F.lit(target.width - 1))).alias("col"), *(F.lit(fill).alias(b) for b in bands), "failed")
    good = out.where("row is not null").select("name", "row", "col", *(F.coalesce(F.col(b).cast("int"), F.lit(fill)).alias(b) for b in bands), F.col("error").alias("failed"))
    return good.unionByName(broken)


def write(pixels: DataFrame, path: str, grids: DataFrame, bands: list[str], dtype: str = "i4", nodata: float | None = 0, block: int = 256, predictor: int = 1, overwrite: bool = False) -> None:
    """One TIFF file for each ``name`` of ``grids(name, epsg, x0, y0, dx, dy, width,
    height)`` from ``pixels(name, row, col, bands)``, in tiles of ``block`` pixels.

    NULL and absent pixels are nodata, as 0 if there is none. Blocks without a value
    are left out. Rows off the grid or of other names are ignored; of two rows for a
    pixel the one with the larger values stays. ``dtype`` is a NumPy code."""
    spark = pixels.sparkSession
    names = list(bands)
    base = Directory(0, 0, np.dtype("<" + dtype), names, nodata=nodata, block_w=block, block_h=block, predictor=predictor)
    fill = 0 if nodata is None else nodata

    def encode(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full((block, block, len(names)), fill, base.dtype)
        pdf = pdf.sort_values(names)
        for i, b in enumerate(names):
            v = pdf[b]
            x[pdf["row"].to_numpy() % block, pdf["col"].to_numpy() % block, i] = v.where(v.notna(), fill).to_numpy(base.dtype)
        return pd.DataFrame({"name": [key[0]], "block": [key[1]], "data": [tiff.encode_block(x, base)]})

    sizes = grids.select("name", "width", "height")
    on = pixels.select("name", "row", "col", *bands).join(sizes, "name").where("row >= 0 and row < height and col >= 0 and col < width")
    on = on.where(F.coalesce(*(F.col(b).cast("double") for b in bands)).isNotNull())
    at = F.floor(F.col("row") / block) * F.ceil(F.col("width") / block) + F.floor(F.col("col") / block)
    blocks = written(on.select("name", at.cast("long").alias("block"), "row", "col", *bands).groupBy("name", "block").applyInPandas(encode, "name string, block long, data binary"))
    have = blocks.groupBy("name").agg(F.collect_list(F.struct("block", F.length("data").alias("n"))).alias("have"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for g in pdf.itertuples():
                d = replace(base, width=g.width, height=g.height, x0=g.x0, y0=g.y0, dx=g.dx, dy=g.dy, epsg=int(g.epsg))
                d.counts = [0] * (d.across * d.down)
                for b in g.have if g.have is not None else ():
                    d.counts[b["block"]] = b["n"]
                data.append(tiff.header(d))
            yield pd.DataFrame({"name": pdf["name"], "block": -1, "data": data})

    wide = grids.select("name", "epsg", "x0", "y0", "dx", "dy", "width", "height").join(have, "name", "left")
    rows = wide.mapInPandas(heads, "name string, block long, data binary").unionByName(blocks)
    write_files(rows.withColumnRenamed("block", "place"), path, ".tif", overwrite=overwrite)
