"""Raster, cube and point files as Python data sources. Libraries that a format needs are imported where it is read."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources import tiff


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def paths_of(option: str) -> list[str]:
    """The files of a path option: files and folders, by comma; of a folder every raster below it, by name."""
    out = []
    for path in filter(None, map(str.strip, option.split(","))):
        if os.path.isdir(path):
            out += sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith((".tif", ".tiff")))
        else:
            out.append(path)
    return out


class GeoTiffSource(DataSource):
    """A band of rasters as (path, row, col, value): a partition for each run of rows of each file, in Arrow batches.

    Options: path (files and folders, by comma), band (1), rows (in a partition, 512), nodata (the file's). Sentinel
    and NaN become NULL; a file that can't be read is an error. By rasterio where it is installed, else by tiff.py."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, row int, col int, value float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GeoTiffReader(self.options)


def _lines(path: str, band: int, first: int, last: int) -> tuple[np.ndarray, float | None]:
    try:
        import rasterio
        from rasterio.windows import Window
    except ImportError:
        h = tiff.header(path)
        return tiff.rows(path, h, first, last)[:, :, band - 1].astype(np.float32), h.nodata
    with rasterio.open(path) as f:
        return f.read(band, window=Window(0, first, f.width, last - first)).astype(np.float32), f.nodata


def head(path: str) -> dict:
    """path, width, height, gt, crs, nodata of a file, from its header alone."""
    try:
        import rasterio
    except ImportError:
        h = tiff.header(path)
        return {"path": path, "width": h.width, "height": h.height, "gt": h.gt, "crs": h.crs, "nodata": h.nodata}
    with rasterio.open(path) as f:
        t = f.transform
        return {"path": path, "width": f.width, "height": f.height, "gt": (t.c, t.a, t.b, t.f, t.d, t.e), "crs": str(f.crs or ""), "nodata": f.nodata}


class _GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.rows, self.band = paths_of(options["path"]), int(options.get("rows", 512)), int(options.get("band", 1))
        self.nodata = float(options["nodata"]) if "nodata" in options else None

    def partitions(self) -> list[InputPartition]:
        heights = ((p, head(p)["height"]) for p in self.paths)
        return [_Rows(p, a, min(a + self.rows, n)) for p, n in heights for a in range(0, n, self.rows)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        data, nodata = _lines(part.path, self.band, part.first, part.last)
        nodata = self.nodata if self.nodata is not None else nodata
        n, width = data.shape
        flat = data.reshape(-1)
        none = np.isnan(flat) if nodata is None else np.isnan(flat) | (flat == np.float32(nodata))
        row, col = np.repeat(np.arange(part.first, part.first + n, dtype=np.int32), width), np.tile(np.arange(width, dtype=np.int32), n)
        yield pa.record_batch([pa.repeat(pa.scalar(part.path), len(flat)), pa.array(row), pa.array(col), pa.array(flat, mask=none)], ["path", "row", "col", "value"])


class GeoTiffHeads(DataSource):
    """Headers alone: a row a file, with its geotransform, reference system and sentinel. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "geotiffheads"

    def schema(self) -> str:
        return "path string, width int, height int, gt struct<origin_x: double, px_w: double, rot_x: double, origin_y: double, rot_y: double, px_h: double>, crs string, nodata double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeadReader(self.options)


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = paths_of(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_Rows(p, 0, 0) for p in self.paths]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        h = head(part.path)
        yield h["path"], h["width"], h["height"], h["gt"], h["crs"], h["nodata"]


class CubeSource(DataSource):
    """A data set [slot, row, col] of an HDF5 file as (slot, row, col, value): a partition for each run of rows.
    Needs h5py. Options: path, dataset (data by default), rows (64)."""

    @classmethod
    def name(cls) -> str:
        return "hdf5cube"

    def schema(self) -> str:
        return "slot int, row int, col int, value float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CubeReader(self.options)


class _CubeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dataset, self.rows = options["path"], options.get("dataset", "data"), int(options.get("rows", 64))

    def partitions(self) -> list[InputPartition]:
        import h5py

        with h5py.File(self.path) as f:
            height = f[self.dataset].shape[1]
        return [_Rows(self.path, a, min(a + self.rows, height)) for a in range(0, height, self.rows)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(part.path) as f:
            data = f[self.dataset][:, part.first : part.last]
        yield cube_batch(data, part.first)


def cube_batch(data: np.ndarray, first: int) -> pa.RecordBatch:
    """Cells of [slot, row, col], whose rows begin at first."""
    slot, row, col = (x.reshape(-1).astype(np.int32) for x in np.indices(data.shape))
    flat = data.astype(np.float32).reshape(-1)
    return pa.record_batch([pa.array(slot), pa.array(row + np.int32(first)), pa.array(col), pa.array(flat, mask=np.isnan(flat))], ["slot", "row", "col", "value"])


class PointSource(DataSource):
    """Points of a shapefile (.shp with .dbf beside it) as (point_id, x, y, label). Null shapes are left out; a
    missing label field is an error. Options: path, label (the field, "id" by default)."""

    @classmethod
    def name(cls) -> str:
        return "shapepoints"

    def schema(self) -> str:
        return "point_id long, x double, y double, label int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PointReader(self.options)


class _PointReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.label = options["path"], options.get("label", "id")

    def read(self, part: InputPartition) -> Iterator[tuple]:
        labels = self._labels(self.path.removesuffix(".shp") + ".dbf")
        with open(self.path, "rb") as f:
            data = f.read()
        at, i = 100, 0
        while at + 12 <= len(data):
            (words,) = struct.unpack_from(">i", data, at + 4)
            (kind,) = struct.unpack_from("<i", data, at + 8)
            if kind in (1, 11, 21):
                x, y = struct.unpack_from("<2d", data, at + 12)
                yield i, x, y, labels[i]
            at, i = at + 8 + 2 * words, i + 1

    def _labels(self, path: str) -> list[int | None]:
        with open(path, "rb") as f:
            data = f.read()
        rows, head, size = struct.unpack_from("<IHH", data, 4)
        place, field = 1, None
        for at in range(32, head - 1, 32):
            if data[at] == 13:
                break
            name, width = data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]
            if name == self.label:
                field = (place, width)
            place += width
        if field is None:
            raise ValueError(f"{path} has no field {self.label}")
        a, n = field
        cells = (data[head + i * size + a : head + i * size + a + n].decode("latin-1").strip() for i in range(rows))
        return [int(float(c)) if c and c.strip("*") else None for c in cells]


def register(spark: SparkSession) -> None:
    """Make the formats geotiff, geotiffheads, hdf5cube and shapepoints known to a session."""
    for source in (GeoTiffSource, GeoTiffHeads, CubeSource, PointSource):
        spark.dataSource.register(source)
