"""The parts of the TIFF format that rasters here use: a directory with its
georeference, and blocks (tiles or strips), each read and written by itself.

Read: little- and big-endian, classic and large files, pixels or bands next to each
other, no compression, LZW or deflate, no predictor or predictors 2 and 3. Written:
little-endian tiles, pixel by pixel, deflate, with predictor 2 on request.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from html import escape, unescape

import numpy as np

#: Bytes of a field's value by its type number (fixed values).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {"u": 1, "i": 2, "f": 3}
NO_COMPRESSION, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


@dataclass
class Directory:
    """One raster: x0, y0 are the upper left corner of its first pixel."""

    width: int
    height: int
    dtype: np.dtype
    names: list[str]
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    epsg: int | None = None
    nodata: float | None = None
    block_w: int = 256
    block_h: int = 256
    compression: int = DEFLATE
    predictor: int = 1
    tiled: bool = True
    planar: int = 1
    offsets: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_h)


def read_directory(f) -> Directory:
    """The first directory of an open file (``seek`` and ``read``)."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    large = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if large else "I"), head[8:16] if large else head[4:8])[0]
    f.seek(at)
    n = struct.unpack(order + ("Q" if large else "H"), f.read(8 if large else 2))[0]
    width = 20 if large else 12
    raw, tags = f.read(n * width), {}
    for i in range(n):
        e = raw[i * width : (i + 1) * width]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if large else "I"), e[4 : 12 if large else 8])[0]
        value = e[12 if large else 8 :]
        size = SIZES.get(kind, 1) * count
        if size > len(value):
            f.seek(struct.unpack(order + ("Q" if large else "I"), value)[0])
            value = f.read(size)
        if kind == 2:
            tags[tag] = value[:size].rstrip(b"\0").decode("utf-8", "replace")
        elif kind in CODES:
            tags[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", value[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bands, bits = one(277, 1), tags.get(258, (1,))
    if len(set(bits)) > 1 or bits[0] % 8:
        raise ValueError("bands of unequal or odd width are not supported")
    kind = {v: k for k, v in KINDS.items()}[one(339, 1)]
    described = dict(re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', tags.get(42112, "")))
    geo = tags.get(34735, ())
    keys = {geo[i]: geo[i + 3] for i in range(4, len(geo), 4) if geo[i + 1] == 0}
    d = Directory(
        one(256, 0), one(257, 0), np.dtype(f"{order}{kind}{bits[0] // 8}"), [unescape(described.get(str(i), f"b{i + 1}")) for i in range(bands)],
        epsg=keys.get(3072) or keys.get(2048), compression=one(259, 1), predictor=one(317, 1), planar=one(284, 1), tiled=322 in tags)
    d.block_w, d.block_h = (one(322, 0), one(323, 0)) if d.tiled else (d.width, min(one(278, d.height), d.height))
    d.offsets, d.counts = list(tags[324 if d.tiled else 273]), list(tags[325 if d.tiled else 279])
    if 33550 in tags and 33922 in tags:
        (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
        d.dx, d.dy, d.x0, d.y0 = sx, -sy, x - i * sx, y + j * sy
    elif 34264 in tags:
        m = tags[34264]
        if m[1] or m[4]:
            raise ValueError("rotated rasters are not supported")
        d.dx, d.x0, d.dy, d.y0 = m[0], m[3], m[5], m[7]
    text = tags.get(42113, "").strip()
    d.nodata = float(text) if text else None
    return d


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    out, table, last = [], [], None
    bits = held = 0
    width = 9
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpredict(x: np.ndarray, d: Directory) -> np.ndarray:
    """``x(rows, width, samples)`` as stored, to values."""
    if d.predictor == 2:
        whole = np.dtype(f"u{d.dtype.itemsize}")
        x = x.astype(x.dtype.newbyteorder("="))
        return np.cumsum(x.view(whole), axis=1, dtype=whole).view(x.dtype)
    if d.predictor == 3:
        rows, width, samples = x.shape
        planes = x.view(np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, d.dtype.itemsize, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(d.dtype.newbyteorder(">")).reshape(rows, width, samples)
    return x


def read_block(f, d: Directory, i: int, wanted: list[int] | None = None) -> np.ndarray | None:
    """Block ``i`` as (rows, width, wanted bands), cut at the raster's edges; None if
    the file has none there (all nodata)."""
    wanted = list(range(len(d.names))) if wanted is None else wanted
    if d.planar == 2:
        parts = [_stored(f, d, b * d.across * d.down + i, i, 1) for b in wanted]
        if all(p is None for p in parts):
            return None
        shape = next(p.shape for p in parts if p is not None)
        return np.concatenate([np.full(shape, 0 if d.nodata is None else d.nodata, d.dtype) if p is None else p for p in parts], axis=2)
    x = _stored(f, d, i, i, len(d.names))
    return None if x is None else x[:, :, wanted]


def _stored(f, d: Directory, at: int, i: int, samples: int) -> np.ndarray | None:
    if not d.counts[at]:
        return None
    f.seek(d.offsets[at])
    data = f.read(d.counts[at])
    rows = min(d.block_h, d.height - i // d.across * d.block_h)
    if d.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif d.compression == LZW:
        data = _lzw(data)
    elif d.compression != NO_COMPRESSION:
        raise ValueError(f"compression {d.compression} is not supported")
    stored = d.block_h if d.tiled else rows
    x = np.frombuffer(data, d.dtype, stored * d.block_w * samples).reshape(stored, d.block_w, samples)
    return _unpredict(x, d)[:rows, : min(d.block_w, d.width - i % d.across * d.block_w)]


def encode_block(x: np.ndarray, d: Directory) -> bytes:
    """A whole block (block_h, block_w, bands) as it is stored."""
    x = np.ascontiguousarray(x, d.dtype)
    if d.predictor == 2:
        whole = np.dtype(f"u{d.dtype.itemsize}")
        v = x.view(whole)
        x = np.concatenate([v[:, :1], np.diff(v, axis=1)], axis=1)
    return zlib.compress(x.tobytes(), 6)


def header(d: Directory) -> bytes:
    """What stands before the blocks, which follow in order; ``d.counts`` has their
    bytes, 0 for blocks that are left out."""
    large = sum(d.counts) > 3 << 30
    word, offset = ("Q", 16) if large else ("I", 4)
    n, bands = len(d.counts), len(d.names)
    geo = [1, 1, 0, 1, 1025, 0, 1, 1]
    if d.epsg is not None:
        degrees = d.epsg == 4326
        geo = [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, d.epsg]
    described = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(b)}</Item>' for i, b in enumerate(d.names))
    entries: list[tuple[int, int, tuple | bytes]] = [
        (256, 4, (d.width,)), (257, 4, (d.height,)), (258, 3, (d.dtype.itemsize * 8,) * bands), (259, 3, (DEFLATE,)), (262, 3, (1,)), (277, 3, (bands,)), (284, 3, (1,)), (317, 3, (d.predictor,)),
        (322, 4, (d.block_w,)), (323, 4, (d.block_h,)), (324, offset, (0,) * n), (325, offset, tuple(d.counts))]
    if bands > 1:
        entries.append((338, 3, (0,) * (bands - 1)))
    entries += [(339, 3, (KINDS[d.dtype.kind],) * bands), (33550, 12, (d.dx, -d.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, d.x0, d.y0, 0.0)), (34735, 3, tuple(geo)),
                (42112, 2, f"<GDALMetadata>{described}</GDALMetadata>\0".encode())]
    if d.nodata is not None:
        text = "nan" if d.nodata != d.nodata else str(int(d.nodata)) if float(d.nodata).is_integer() else repr(float(d.nodata))
        entries.append((42113, 2, text.encode() + b"\0"))
    entries.sort(key=lambda e: e[0])
    inline, start = (8, 16) if large else (4, 8)
    after = start + (8 if large else 2) + len(entries) * (20 if large else 12) + inline
    extra = sum(-(-SIZES[k] * len(v) // 8) * 8 for _, k, v in entries if SIZES[k] * len(v) > inline)
    first = after + extra
    places, at = [], first
    for c in d.counts:
        places.append(at if c else 0)
        at += c
    body, tail = b"", b""
    for tag, kind, value in entries:
        if tag == 324:
            value = tuple(places)
        data = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{CODES[kind]}", *value)
        if len(data) <= inline:
            data = data.ljust(inline, b"\0")
        else:
            data, tail = struct.pack("<" + word, after + len(tail)), tail + data.ljust(-(-len(data) // 8) * 8, b"\0")
        body += struct.pack("<HH" + word, tag, kind, len(value)) + data
    begin = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if large else struct.pack("<2sHI", b"II", 42, 8)
    return begin + struct.pack("<Q" if large else "<H", len(entries)) + body + b"\0" * inline + tail
