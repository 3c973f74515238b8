"""GeoTIFF files of one numeric band or several, in strips, without a raster library.

Reads classic TIFF: strips, uncompressed, deflate or LZW, with or without the horizontal predictor for integers;
writes 32-bit floats in deflated strips. Georeference is a tie point and a pixel scale.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Numbers of tags, and sizes and letters of field types, as the format has them.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR, TILE_WIDTH, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 339
PLANAR, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 284, 33550, 33922, 34735, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC_CRS, PROJECTED_CRS = 1024, 1025, 2048, 3072


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    bands: int
    dtype: str
    gt: tuple[float, float, float, float, float, float]
    crs: str
    nodata: float | None
    strip_rows: int
    strips: tuple[tuple[int, int], ...]
    compression: int
    predictor: int


def header(path: str) -> Header:
    """What a file says about itself; no cell is read."""
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF file")
        f.seek(struct.unpack(order + "I", head[4:])[0])
        (n,) = struct.unpack(order + "H", f.read(2))
        tags = {}
        for tag, kind, count, raw in (struct.unpack(order + "HHI4s", f.read(12)) for _ in range(n)):
            if kind not in TYPES:
                continue
            size, letter = TYPES[kind]
            if size * count > 4:
                back = f.tell()
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size * count)
                f.seek(back)
            tags[tag] = raw[:count] if letter == "s" else struct.unpack(order + f"{count}{letter}", raw[: size * count])
    if TILE_WIDTH in tags or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError(f"{path}: only strips with bands side by side can be read")
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, kind = one(BITS, 1), {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)]
    scale, tie = tags.get(PIXEL_SCALE, (1.0, -1.0, 0.0)), tags.get(TIE_POINT, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED_CRS) or codes.get(GEOGRAPHIC_CRS)
    nodata = tags[NODATA].rstrip(b"\0 ").decode() if NODATA in tags else ""
    px_h = -scale[1]
    gt = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] - tie[1] * px_h, 0.0, px_h)
    height = one(HEIGHT, 0)
    strips = tuple(zip(tags[STRIP_OFFSETS], tags[STRIP_BYTES], strict=True))
    return Header(one(WIDTH, 0), height, one(SAMPLES, 1), f"{order}{kind}{bits // 8}", gt, f"EPSG:{code}" if code else "", float(nodata) if nodata else None, min(one(ROWS_PER_STRIP, height), height), strips, one(COMPRESSION, 1), one(PREDICTOR, 1))


def _lzw(data: bytes) -> bytes:
    """The variant of TIFF: codes of 9 to 12 bits, most significant first, wider one code early."""
    out, table, bits, last = [], [], 9, None
    held = n = 0
    for byte in data:
        held, n = (held << 8 | byte) & 0xFFFFFF, n + 8
        if n < bits:
            continue
        n -= bits
        code = held >> n & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            text = table[code]
        else:
            text = table[code] if code < len(table) else last + last[:1]
            table.append(last + text[:1])
        out.append(text)
        last = text
        if len(table) >= (1 << bits) - 1 and bits < 12:
            bits += 1
    return b"".join(out)


def rows(path: str, h: Header, first: int, last: int) -> np.ndarray:
    """Cells of rows first to last (without it), as (rows, width, bands)."""
    a, b = first // h.strip_rows, -(-last // h.strip_rows)
    parts = []
    with open(path, "rb") as f:
        for offset, size in h.strips[a:b]:
            f.seek(offset)
            raw = f.read(size)
            if h.compression in (8, 32946):
                raw = zlib.decompress(raw)
            elif h.compression == 5:
                raw = _lzw(raw)
            elif h.compression != 1:
                raise ValueError(f"{path}: compression {h.compression} can't be read")
            part = np.frombuffer(raw, h.dtype).reshape(-1, h.width, h.bands)
            if h.predictor == 2:
                part = np.cumsum(part, axis=1, dtype=part.dtype)
            elif h.predictor != 1:
                raise ValueError(f"{path}: predictor {h.predictor} can't be read")
            parts.append(part)
    return np.concatenate(parts)[first - a * h.strip_rows : last - a * h.strip_rows]


def encoded(data: np.ndarray, gt: tuple, crs: str = "", nodata: float | None = None, strip_rows: int = 64) -> bytes:
    """A file of (rows, width, bands) of 32-bit floats."""
    height, width, bands = data.shape
    strips = [zlib.compress(np.ascontiguousarray(data[i : i + strip_rows], "<f4").tobytes(), 6) for i in range(0, height, strip_rows)]
    offsets = np.cumsum([8, *map(len, strips)])[:-1].tolist()
    code = int(crs.removeprefix("EPSG:")) if crs.startswith("EPSG:") else 0
    geographic = code and 4000 <= code < 5000
    keys = [1, 1, 0, 2 + bool(code), MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1]
    keys += [GEOGRAPHIC_CRS if geographic else PROJECTED_CRS, 0, 1, code] if code else []
    tags = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * bands), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [bands]),
        (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, [*map(len, strips)]), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [3] * bands), (PIXEL_SCALE, 12, [gt[1], -gt[5], 0.0]),
        (TIE_POINT, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0]), (GEO_KEYS, 3, keys),
    ]
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:g}".encode() + b"\0"))
    begin = 8 + sum(map(len, strips))
    begin += begin % 2
    table, far, at = b"", b"", begin + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
        count = len(values)
        if len(raw) > 4:
            here, far = struct.pack("<I", at + len(far)), far + raw + b"\0" * (len(raw) % 2)
        else:
            here = raw.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, count) + here
    body = b"".join(strips)
    return b"II" + struct.pack("<HI", 42, begin) + body + b"\0" * (begin - 8 - len(body)) + struct.pack("<H", len(tags)) + table + bytes(4) + far
