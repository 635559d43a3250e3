"""Vector files as tables: GeoPackage, GeoJSON, and CSV with a byte-order mark.

A geometry is ``parts``: an array of parts, each an array of rings, each an array of
[x, y]. A polygon's first ring is its outer one; a point is a part of one ring of one
pair, a line a part of one ring. ``single_parts`` gives a row for each part.

A GeoPackage is an SQLite database. A task reads a range of a layer's row numbers; a
``box`` is looked up in the layer's R-tree, where there is one, so that other rows are
not read. A file of a store that SQLite can not open, and one in a ZIP archive, is held
in memory. Written are as many files as the rows need, each of at most about
``max_rows`` rows, with an R-tree (whose triggers for later edits are left out).
"""

from __future__ import annotations

import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.polygons import area, rectangle  # noqa: F401  on the same geometry
from ..operators.views import in_order
from .file_sink import list_files, open_uri, write_files
from .sinks import sanitize

SUFFIXES = (".gpkg", ".zip")
PARTS = "array<array<array<array<double>>>>"
ARROW_PARTS = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
#: Kinds of geometry by their number (fixed values).
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
#: Coordinates of a position by the thousand of a geometry's number.
DIMENSIONS = {0: 2, 1: 3, 2: 3, 3: 4}


def read_wkb(data: bytes, at: int = 0) -> tuple[int, list, int]:
    """(kind, parts, end) of a geometry's well-known binary; only x and y are kept."""
    order = "<" if data[at] else ">"
    number = struct.unpack_from(order + "I", data, at + 1)[0]
    # the flags of another notation for heights and measures, and for a reference system
    wide = number & 0x80000000, number & 0x40000000
    at += 5 + (4 if number & 0x20000000 else 0)
    number &= 0x0FFFFFFF
    kind, dims = number % 1000, DIMENSIONS[number // 1000] + sum(map(bool, wide))

    def ring(n: int) -> list[list[float]]:
        nonlocal at
        xy = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2]
        at += 8 * n * dims
        return xy.tolist()

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    if kind == 1:
        point = ring(1)
        return kind, [] if point[0][0] != point[0][0] else [[point]], at
    if kind == 2:
        n = count()
        return kind, [[ring(n)]] if n else [], at
    if kind == 3:
        rings = [ring(count()) for _ in range(count())]
        return kind, [rings] if rings else [], at
    if kind not in KINDS:
        raise ValueError(f"geometry kind {kind} is not supported")
    parts = []
    for _ in range(count()):
        _, part, at = read_wkb(data, at)
        parts += part
    return kind, parts, at


def write_wkb(parts: list, kind: int | None = None) -> bytes:
    """Well-known binary of a polygon, or of a multipolygon if it has not one part."""
    many = kind == 6 or len(parts) != 1
    out = [struct.pack("<BII", 1, 6, len(parts))] if many else []
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            out += [struct.pack("<I", len(ring)), np.asarray(ring, "<f8").tobytes()]
    return b"".join(out)


def read_geometry(blob: bytes) -> tuple[int, int, list]:
    """(reference system, kind, parts) of a GeoPackage's geometry column."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    system = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0]
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[flags >> 1 & 7]
    kind, parts, _ = read_wkb(blob, 8 + envelope)
    return system, kind, parts


def _box(parts: list) -> tuple[float, float, float, float] | None:
    rings = [np.asarray(r, float) for rings in parts for r in rings if len(r)]
    if not rings:
        return None
    low, high = np.min([r.min(axis=0) for r in rings], axis=0), np.max([r.max(axis=0) for r in rings], axis=0)
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])


def write_geometry(parts: list, system: int) -> bytes:
    box = _box(parts)
    head = struct.pack("<2sBBi", b"GP", 0, 0b11 if box else 0b10001, system)
    return head + (struct.pack("<4d", box[0], box[2], box[1], box[3]) if box else b"") + write_wkb(parts)


# --- GeoPackage, read ---------------------------------------------------------------


def connect(store: pafs.FileSystem, path: str) -> sqlite3.Connection:
    if path.lower().endswith(".zip"):
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            inner = [n for n in z.namelist() if n.lower().endswith(".gpkg")]
            if not inner:
                raise ValueError(f"no GeoPackage in {path}")
            data = z.read(min(inner))
    elif isinstance(store, pafs.LocalFileSystem):
        return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)
    else:
        with store.open_input_file(path) as f:
            data = f.read()
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    return db


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


@dataclass
class Layer:
    table: str
    geometry: str
    system: int
    key: str
    columns: list[tuple[str, str]]  # attributes and their types
    index: str | None


def layer_of(db: sqlite3.Connection, wanted: str | None) -> Layer:
    """The layer of that name, else the first one."""
    found = db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by table_name").fetchall()
    if wanted is not None:
        found = [x for x in found if x[0] == wanted]
    if not found:
        raise ValueError(f"no layer {wanted or ''}")
    table, geometry, system = found[0]
    info = db.execute(f"pragma table_info({_name(table)})").fetchall()
    key = next((c[1] for c in info if c[5]), "rowid")
    index = f"rtree_{table}_{geometry}"
    has = db.execute("select 1 from sqlite_master where type = 'table' and name = ?", (index,)).fetchone()
    kinds = {"INT": "long", "REAL": "double", "DOUB": "double", "FLOA": "double", "BOOL": "boolean", "BLOB": "binary"}
    kind = lambda t: next((k for part, k in kinds.items() if part in t.upper()), "string")
    return Layer(table, geometry, system, key, [(c[1], kind(c[2])) for c in info if c[1] not in (geometry, key)], index if has else None)


ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    after: int


class GpkgReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layer = options["path"], options.get("layer")
        self.step = int(options.get("rowspertask", 100_000))
        self.box = json.loads(options["box"]) if "box" in options else None

    def partitions(self) -> list[Rows]:
        store, _ = open_uri(self.path)
        out = []
        for path, _ in list_files(self.path, SUFFIXES):
            with closing(connect(store, path)) as db:
                low, high = db.execute(f"select min(rowid), max(rowid) from {_name(layer_of(db, self.layer).table)}").fetchone()
            out += [Rows(path, i, i + self.step) for i in range(low, high + 1, self.step)] if low is not None else []
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_uri(self.path)
        with closing(connect(store, partition.path)) as db:
            layer = layer_of(db, self.layer)
            names = [c for c, _ in layer.columns]
            sql = f"select rowid, {_name(layer.geometry)}{''.join(', ' + _name(c) for c in names)} from {_name(layer.table)} where rowid >= ? and rowid < ?"
            values = [partition.first, partition.after]
            if self.box is not None and layer.index:
                sql += f" and rowid in (select id from {_name(layer.index)} where maxx >= ? and minx <= ? and maxy >= ? and miny <= ?)"
                values += [self.box[0], self.box[2], self.box[1], self.box[3]]
            rows = db.execute(sql + " order by rowid", values)
            while some := rows.fetchmany(2_000):
                if batch := self._batch(some, layer):
                    yield batch

    def _batch(self, rows: list, layer: Layer) -> pa.RecordBatch | None:
        out = []
        for fid, blob, *attributes in rows:
            system, kind, parts = read_geometry(blob) if blob is not None else (layer.system, None, None)
            box = _box(parts) if parts else None
            if self.box is not None and (box is None or box[2] < self.box[0] or box[0] > self.box[2] or box[3] < self.box[1] or box[1] > self.box[3]):
                continue
            out.append((fid, *attributes, KINDS.get(kind), system, *(box or (None,) * 4), parts))
        if not out:
            return None
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], pa.int64())]
        for v, (_, kind) in zip(columns[1:], layer.columns):
            if kind == "boolean":
                v = [None if x is None else bool(x) for x in v]
            elif kind == "string":
                v = [None if x is None else str(x) for x in v]
            arrays.append(pa.array(v, ARROW[kind]))
        k = 1 + len(layer.columns)
        arrays += [pa.array(columns[k], pa.string()), pa.array(columns[k + 1], pa.int32()), *(pa.array(columns[k + 2 + i], pa.float64()) for i in range(4)), pa.array(columns[k + 6], ARROW_PARTS)]
        return pa.RecordBatch.from_arrays(arrays, names=["fid", *(c for c, _ in layer.columns), "kind", "epsg", "x0", "y0", "x1", "y1", "parts"])


class GpkgSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landcube_gpkg"

    def schema(self) -> str:
        files = list_files(self.options["path"], SUFFIXES)
        if not files:
            raise ValueError(f"no GeoPackage in {self.options['path']}")
        with closing(connect(open_uri(self.options["path"])[0], files[0][0])) as db:
            columns = layer_of(db, self.options.get("layer")).columns
        return "fid long, " + "".join(f"`{c}` {k}, " for c, k in columns) + f"kind string, epsg int, x0 double, y0 double, x1 double, y1 double, parts {PARTS}"

    def reader(self, schema: StructType) -> GpkgReader:
        return GpkgReader({k.lower(): v for k, v in self.options.items()})


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, box: tuple[float, float, float, float] | None = None, rows_per_task: int = 100_000) -> DataFrame:
    """(fid, attributes, kind, epsg, x0, y0, x1, y1, parts) of a layer in the files at
    or below ``path``, those that meet ``box`` (x0, y0, x1, y1) if it is given."""
    spark.dataSource.register(GpkgSource)
    reader = spark.read.format("landcube_gpkg").option("path", path).option("rowsPerTask", rows_per_task)
    if layer is not None:
        reader = reader.option("layer", layer)
    if box is not None:
        reader = reader.option("box", json.dumps(box))
    return reader.load()


# --- geometry columns ---------------------------------------------------------------


def single_parts(df: DataFrame) -> DataFrame:
    """A row for each part, numbered from 0 in ``part``; rows without one go."""
    return df.select("*", F.posexplode("parts").alias("part", "_one")).withColumn("parts", F.array("_one")).drop("_one")


# --- sinks --------------------------------------------------------------------------

SQL_TYPES = {"boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB"}


def database(rows: list[tuple], columns: list[tuple[str, str]], layer: str, epsg: int) -> bytes:
    """A GeoPackage of ``rows`` (parts, then ``columns``), as bytes."""
    with closing(sqlite3.connect(":memory:")) as db:
        t, index = _name(layer), _name(f"rtree_{layer}_geom")
        db.execute(f"pragma application_id = {0x47504B47}")
        db.execute("pragma user_version = 10300")
        db.executescript(f"""
            create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
            create table gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
            create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
            create table gpkg_extensions (table_name text, column_name text, extension_name text not null, definition text not null, scope text not null);
            create table {t} (fid integer primary key autoincrement not null, geom geometry{"".join(f", {_name(c)} {k}" for c, k in columns)});
            create virtual table {index} using rtree(id, minx, maxx, miny, maxy);""")
        systems = [("undefined cartesian", -1, "NONE", -1, "undefined", None), ("undefined geographic", 0, "NONE", 0, "undefined", None), ("WGS 84", 4326, "EPSG", 4326, "undefined", None)]
        if epsg not in (-1, 0, 4326):
            systems.append((f"EPSG:{epsg}", epsg, "EPSG", epsg, "undefined", None))
        db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, ?, ?)", systems)
        boxes = [_box(r[0]) if r[0] else None for r in rows]
        some = np.array([b for b in boxes if b])
        whole = (*some[:, :2].min(axis=0).tolist(), *some[:, 2:].max(axis=0).tolist()) if len(some) else (None,) * 4
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *whole, epsg))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, epsg))
        db.execute("insert into gpkg_extensions values (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (layer,))
        db.executemany(f"insert into {t} values ({', '.join('?' * (len(columns) + 2))})", [(i, None if r[0] is None else write_geometry(r[0], epsg), *r[1:]) for i, r in enumerate(rows, 1)])
        db.executemany(f"insert into {index} values (?, ?, ?, ?, ?)", [(i, b[0], b[2], b[1], b[3]) for i, b in enumerate(boxes, 1) if b])
        db.commit()
        return db.serialize()


def write_gpkg(df: DataFrame, path: str, layer: str, epsg: int, name: str | None = None, max_rows: int = 200_000, overwrite: bool = False) -> None:
    """``df(parts, attributes)`` as GeoPackages: a file for each value of the column
    ``name``, which is no attribute then, or one named after the layer. Files of more
    than ``max_rows`` rows are dealt over several, ``{name}-0`` and so on. ``fid``,
    ``kind``, ``epsg`` and box columns, which a reader makes, are not written."""
    skip = {"parts", "fid", "kind", "epsg", "x0", "y0", "x1", "y1", name}
    attributes = [c for c in df.columns if c not in skip]
    columns = [(c, SQL_TYPES.get(dict(df.dtypes)[c], "TEXT")) for c in attributes]
    clean = sanitize(df.select(*attributes, "parts", (F.lit(layer) if name is None else F.col(name).cast("string")).alias("_name")), skip=("parts", "_name"))
    sizes = clean.groupBy("_name").agg(F.ceil(F.count("*") / max_rows).alias("_files"))
    dealt = F.concat("_name", F.lit("-"), F.pmod(F.xxhash64(*attributes, "parts"), F.col("_files")).cast("string"))
    rows = clean.join(sizes, "_name").select(F.when(F.col("_files") == 1, F.col("_name")).otherwise(dealt).alias("_file"), "parts", *attributes)

    def build(table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table.column(c).to_pylist() for c in ["parts", *attributes])), key=repr)
        return pa.table({"name": table.column("_file")[:1], "place": pa.array([0], pa.int64()), "data": pa.array([database(found, columns, layer, epsg)], pa.binary())})

    write_files(rows.groupBy("_file").applyInArrow(build, "name string, place long, data binary"), path, ".gpkg", overwrite=overwrite)


def write_geojson(df: DataFrame, path: str, name: str | None = None, file: str = "features", overwrite: bool = False) -> None:
    """``df(parts, attributes)`` as GeoJSON collections, a file for each value of
    ``name``, or ``file``. NULL geometries are null, one part is a polygon."""
    properties = [c for c in df.columns if c not in ("parts", name)]
    body = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    shape = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    geometry = F.when(F.col("parts").isNull(), F.lit("null")).when(F.size("parts") == 1, shape("Polygon", F.col("parts")[0])).otherwise(shape("MultiPolygon", F.col("parts")))
    line = F.concat(F.lit('{"type":"Feature","properties":'), body, F.lit(',"geometry":'), geometry, F.lit("}"))
    rows = df.select((F.lit(file) if name is None else F.col(name).cast("string")).alias("name"), line.alias("line"))
    chunks = rows.select("name", F.xxhash64("line").alias("place"), F.encode("line", "UTF-8").alias("data"))
    if name is None:
        chunks = chunks.unionByName(df.sparkSession.createDataFrame([(file, 0, None)], "name string, place long, data binary"))
    write_files(chunks, path, ".geojson", '{"type":"FeatureCollection","features":[\n', ",\n", "\n]}\n", overwrite)


def write_csv(df: DataFrame, path: str, file: str, order: list, overwrite: bool = False) -> None:
    """A table as one CSV file with a byte-order mark and a header, in ``order``; none
    of its rows, and the file is empty. For tables that a person opens."""
    placed = in_order(df, order, "_place")
    text = F.to_csv(F.struct(*df.columns))
    lines = placed.select(F.lit(file).alias("name"), F.col("_place").alias("place"), F.encode(text, "UTF-8").alias("data"))
    spark = df.sparkSession
    head = lines.limit(1).select("name", F.lit(0).cast("long").alias("place"), F.encode(F.lit("﻿" + ",".join(df.columns)), "UTF-8").alias("data"))
    there = spark.createDataFrame([(file, -1, None)], "name string, place long, data binary")
    write_files(lines.unionByName(head).unionByName(there), path, ".csv", between="\n", overwrite=overwrite)
