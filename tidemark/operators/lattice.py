"""Rasters of unlike origins, pixel sizes and reference systems on one lattice.

A raster's cells are rows (row, col, values); where it lies is a Profile, or, of many rasters, a row of a table of
headers (width, height, gt). Headers are few and small: they meet cells in a broadcast join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import raster

#: Fixed value: half the extent of the spherical Mercator plane, in metres.
MERCATOR = 20037508.342789244
GEOGRAPHIC = ("EPSG:4326", "OGC:CRS84")


@dataclass(frozen=True)
class Profile:
    """Shape, geotransform without rotation, and reference system of one raster."""

    width: int
    height: int
    origin_x: float
    origin_y: float
    px_w: float
    px_h: float
    crs: str = ""

    @property
    def x_max(self) -> float:
        return self.origin_x + self.width * self.px_w

    @property
    def y_min(self) -> float:
        return self.origin_y + self.height * self.px_h

    def in_metres(self, metres: float) -> Profile:
        """The same extent with pixels of about so many metres: sizes are rounded half-even, one at least. In a
        geographic system a degree counts as 111,320 m."""
        size = metres / 111320.0 if self.crs in GEOGRAPHIC else metres
        width, height = max(1, round(abs(self.x_max - self.origin_x) / size)), max(1, round(abs(self.y_min - self.origin_y) / size))
        return replace(self, width=width, height=height, px_w=(self.x_max - self.origin_x) / width, px_h=(self.y_min - self.origin_y) / height)

    def cells(self, spark: SparkSession) -> DataFrame:
        """row and col of every cell, made where it is used."""
        return spark.range(self.width * self.height).select(F.expr(f"id div {self.width}").alias("row"), (F.col("id") % self.width).alias("col"))


# ------------------------------------------------------------------ one lattice for many tiles


def common(tiles: DataFrame, by: list[str], mode: str = "round", order: str = "ord") -> DataFrame:
    """One row a group of tiles(width, height, gt): the union of extents, pixel size of its first tile, and the shape:
    sizes rounded half-even, or (trunc) rounded up."""
    out = raster.union_extent(tiles, by, order)
    cut = F.rint if mode == "round" else F.ceil
    size = lambda a, b, px: cut((F.col(b) - F.col(a)) / F.abs(F.col(px))).cast("int")
    return out.select(*by, "x_min", "x_max", "y_min", "y_max", "px_w", "px_h", size("x_min", "x_max", "px_w").alias("width"), size("y_min", "y_max", "px_h").alias("height"))


def placed(tiles: DataFrame, by: list[str], mode: str = "round", order: str = "ord") -> DataFrame:
    """tiles with row_off and col_off on their group's common lattice, and its shape (rows, cols)."""
    whole = common(tiles, by, mode, order).withColumnsRenamed({"width": "cols", "height": "rows"}).select(*by, "x_min", "y_max", "px_w", "px_h", "rows", "cols")
    here = tiles.withColumns({"origin_x": F.col("gt.origin_x"), "origin_y": F.col("gt.origin_y")})
    here = here.join(F.broadcast(whole), by) if by else here.crossJoin(F.broadcast(whole))  # one row a group
    return raster.offsets(here, mode)


def on_lattice(cells: DataFrame, tiles: DataFrame, key: list[str], by: list[str], mode: str = "round", order: str = "ord") -> DataFrame:
    """cells with row and col on the lattice that their tile (key) shares with its group (by); the tile's place in
    the order comes along. Cells that rounding puts outside the lattice are left out."""
    at = placed(tiles, by, mode, order).select(*dict.fromkeys([*key, *by, order]), "row_off", "col_off", "rows", "cols")
    both = [c for c in at.columns if c in cells.columns]
    out = cells.join(F.broadcast(at), both)
    out = out.withColumns({"row": F.col("row") + F.col("row_off"), "col": F.col("col") + F.col("col_off")})
    inside = F.col("row").between(0, F.col("rows") - 1) & F.col("col").between(0, F.col("cols") - 1)
    return out.filter(inside).drop("row_off", "col_off", "rows", "cols")


def mosaic(cells: DataFrame, tiles: DataFrame, key: list[str], by: list[str], values: list[str], method: str = "mean", mode: str = "round", order: str = "ord") -> DataFrame:
    """One row a cell of the common lattice, with values combined over the tiles that cover it."""
    on = on_lattice(cells, tiles, key, by, mode, order)
    return on.groupBy(*by, "row", "col").agg(*(raster.combined(F.col(v), F.col(order), method).alias(v) for v in values))


def canvas(cells: DataFrame, tiles: DataFrame, key: list[str], channels: list[str], order: str = "ord") -> DataFrame:
    """All channels of each cell of the common lattice from the first tile in which any is present; extents are
    snapped to the lattice of the first tile."""
    return raster.canvas(on_lattice(cells, snapped(tiles, order), key, [], "round", order), ["row", "col"], channels, order)


def snapped(tiles: DataFrame, order: str = "ord") -> DataFrame:
    """tiles whose origins are drawn to the nearest node of the first tile's lattice."""
    first = tiles.agg(F.min_by("gt", order).alias("base"))
    out = tiles.crossJoin(F.broadcast(first))  # one row
    gt, base = F.col("gt"), F.col("base")
    moved = gt.withField("origin_x", N.snapped(gt["origin_x"], base["origin_x"], base["px_w"])).withField("origin_y", N.snapped(gt["origin_y"], base["origin_y"], base["px_h"]))
    return out.withColumn("gt", moved).drop("base")


# ------------------------------------------------------------------ reference systems

Transform = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """x and y in another reference system. The same system: as they are. Longitude and latitude from and to
    spherical Mercator: in the JVM. Any other pair: by the library pyproj, in Arrow batches."""
    if source == target:
        return x, y
    if source in GEOGRAPHIC and target == "EPSG:3857":
        return x * (MERCATOR / 180), F.log(F.tan((y + 90) * (math.pi / 360))) * (MERCATOR / math.pi)
    if source == "EPSG:3857" and target in GEOGRAPHIC:
        return x * (180 / MERCATOR), F.atan(F.exp(y * (math.pi / MERCATOR))) * (360 / math.pi) - 90
    both = by_library(source, target)(x, y)
    return both["x"], both["y"]


def by_library(source: str, target: str, make: Callable[[str, str], Transform] | None = None):
    """A pandas UDF (x, y) -> struct(x, y); make builds the transform where it runs."""

    @F.pandas_udf("x double, y double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        f = (make or _pyproj)(source, target)
        for x, y in batches:
            a, b = f(x.to_numpy(), y.to_numpy())
            yield pd.DataFrame({"x": a, "y": b})

    return run


def _pyproj(source: str, target: str) -> Transform:
    from pyproj import Transformer

    return Transformer.from_crs(source, target, always_xy=True).transform


# ------------------------------------------------------------------ warps


def centres(targets: DataFrame, source: Profile, target: Profile) -> DataFrame:
    """targets(row, col) with sr and sc: where their centres lie on source's lattice (0 is the first centre)."""
    x = target.origin_x + (F.col("col") + 0.5) * target.px_w
    y = target.origin_y + (F.col("row") + 0.5) * target.px_h
    x, y = transform(x, y, target.crs, source.crs)
    return targets.withColumn("sr", (y - source.origin_y) / source.px_h - 0.5).withColumn("sc", (x - source.origin_x) / source.px_w - 0.5)


def warp(cells: DataFrame, values: list[str], source: Profile, target: Profile, method: str = "bilinear", outside: float | None = None, key: list[str] | None = None) -> DataFrame:
    """cells(key, row, col, values) of source on target's lattice: row, col and values of every target cell (and key that
    has cells). Equal profiles: the cells as they are. bilinear: the four cells about a centre, weighted by nearness
    over those that are present. nearest: the cell that holds the centre. outside: for what has no value."""
    key = key or []
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method {method}: bilinear or nearest")
    filled = lambda df: df if outside is None else df.withColumns({v: F.coalesce(F.col(v), F.lit(outside)) for v in values})
    if source == target:
        return filled(cells.select(*key, "row", "col", *values))
    wanted = target.cells(cells.sparkSession)
    if key:
        wanted = wanted.crossJoin(F.broadcast(cells.select(*key).distinct()))  # a few scenes of one profile
    at = centres(wanted, source, target)
    if method == "bilinear":
        return filled(raster.weighted_corners(at, cells, values, key))
    at = at.withColumn("r", F.floor(F.col("sr") + 0.5)).withColumn("c", F.floor(F.col("sc") + 0.5))
    there = cells.select(*key, F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), *values)
    return filled(at.join(there, [*key, "r", "c"], "left").select(*key, "row", "col", *values))


def masked(cells: DataFrame, value: str, at: Profile, mask: DataFrame, mask_at: Profile, compat: bool = False) -> DataFrame:
    """cells(row, col, value) times a mask of any lattice, which is drawn to that of the cells by the nearest cell; where
    the mask has none, 0."""
    return raster.apply_mask(cells, warp(mask.select("row", "col", "mask"), ["mask"], mask_at, at, "nearest", 0.0), ["row", "col"], value, compat)
