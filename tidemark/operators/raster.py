"""Extents, mosaics, masks and alignment of rasters whose cells are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N

METHODS = ("mean", "max", "min", "first", "last")


def extents(scenes: DataFrame) -> DataFrame:
    """scenes(width, height, gt) with x_min, x_max, y_min, y_max."""
    gt = F.col("gt")
    x1, y1 = gt["origin_x"] + F.col("width") * gt["px_w"], gt["origin_y"] + F.col("height") * gt["px_h"]
    return scenes.withColumns({"x_min": F.least(gt["origin_x"], x1), "x_max": F.greatest(gt["origin_x"], x1), "y_min": F.least(gt["origin_y"], y1), "y_max": F.greatest(gt["origin_y"], y1)})


def union_extent(scenes: DataFrame, key: list[str], order: str = "path") -> DataFrame:
    """Of each group the union of extents, the pixel size of its first scene, and the largest width and height."""
    aggs = [F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")]
    aggs += [F.min_by("gt.px_w", order).alias("px_w"), F.min_by("gt.px_h", order).alias("px_h"), F.max("width").alias("max_width"), F.max("height").alias("max_height"), F.count(F.lit(1)).alias("scenes")]
    return extents(scenes).groupBy(*key).agg(*aggs)


def offsets(tiles: DataFrame, mode: str = "round") -> DataFrame:
    """tiles(origin_x, origin_y, x_min, y_max, px_w, px_h) with row_off and col_off on the common lattice:
    rounded half-even, or cut toward zero."""
    if mode not in ("round", "trunc"):
        raise ValueError(f"unknown offset mode {mode}")
    cut = (lambda c: F.rint(c).cast("int")) if mode == "round" else (lambda c: c.cast("int"))
    return tiles.withColumn("col_off", cut(F.try_divide(F.col("origin_x") - F.col("x_min"), F.col("px_w")))).withColumn("row_off", cut(F.try_divide(F.col("origin_y") - F.col("y_max"), F.col("px_h"))))


def combined(value: Column, order: Column, method: str) -> Column:
    """Aggregate of the present values of a cell; first and last by order."""
    there = F.when(value.isNotNull(), order)
    if method == "mean":
        return F.avg(value.cast("double"))
    if method in ("max", "min"):
        return getattr(F, method)(value)
    if method in ("first", "last"):
        return (F.min_by if method == "first" else F.max_by)(value, there)
    raise ValueError(f"unknown mosaic method {method}: one of {', '.join(METHODS)}")


def mosaic(cells: DataFrame, key: list[str], value: str = "value", order: str = "ord", method: str = "mean") -> DataFrame:
    """One value a cell and key from the tiles that cover it; NULL where none has one. Partial sums go before
    the only exchange."""
    return cells.groupBy(*key).agg(combined(F.col(value), F.col(order), method).alias(value))


def canvas(cells: DataFrame, key: list[str], channels: list[str], order: str = "ord") -> DataFrame:
    """All channels of a cell from the first tile in which any of them is present."""
    there = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(1)) for c in channels)).isNotNull()
    first = F.min_by(F.struct(*channels), F.when(there, F.col(order)))
    return cells.groupBy(*key).agg(first.alias("cell")).select(*key, *(F.col(f"cell.{c}").alias(c) for c in channels))


def apply_mask(cells: DataFrame, mask: DataFrame, key: list[str], value: str = "fx", compat: bool = False) -> DataFrame:
    """value times the mask; where the mask has no cell, 0. compat: sentinels are multiplied like numbers."""
    by = F.coalesce(F.col("mask"), F.lit(0.0))
    v = F.coalesce(F.col(value), F.lit(-9999.0)) if compat else F.col(value)
    return cells.join(mask.select(*key, F.col("mask").cast("double").alias("mask")), key, "left").withColumn(value, v * by).drop("mask")


def _sources(targets: DataFrame, scale_row: float, scale_col: float) -> DataFrame:
    """targets(row, col) with the place of their centres on the source lattice."""
    return targets.withColumn("sr", (F.col("row") + 0.5) * scale_row - 0.5).withColumn("sc", (F.col("col") + 0.5) * scale_col - 0.5)


def resample_bilinear(cells: DataFrame, targets: DataFrame, values: list[str], scale_row: float, scale_col: float, key: list[str] | None = None) -> DataFrame:
    """targets(key, row, col) with values from the four cells about each centre; scale: source cells in a target cell.
    lattice.warp() does the same between any two geotransforms."""
    return weighted_corners(_sources(targets, scale_row, scale_col), cells, values, key)


def weighted_corners(targets: DataFrame, cells: DataFrame, values: list[str], key: list[str] | None = None) -> DataFrame:
    """targets(key, row, col, sr, sc) with values from the four cells about (sr, sc), weighted by nearness over those that
    are present; NULL if none is. An equi-join on four rows a target."""
    key = key or []
    corner = [F.struct((F.floor("sr") + i).alias("r"), (F.floor("sc") + j).alias("c"), (F.abs(F.lit(float(1 - i)) - (F.col("sr") - F.floor("sr"))) * F.abs(F.lit(float(1 - j)) - (F.col("sc") - F.floor("sc")))).alias("w")) for i in (0, 1) for j in (0, 1)]
    out = targets.select(*key, "row", "col", F.explode(F.array(*corner)).alias("k")).select(*key, "row", "col", "k.*")
    src = cells.select(*key, F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), *values)
    out = out.join(src, [*key, "r", "c"], "left")
    mean = lambda v: F.try_divide(F.sum(F.col(v) * F.col("w")), F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))), F.lit(0.0)))
    return out.groupBy(*key, "row", "col").agg(*(mean(v).alias(v) for v in values))


def lookup(cells: DataFrame, points: DataFrame, value: str, nodata: float, tolerance: float = 1e-3) -> DataFrame:
    """points(row, col) with the value there; NULL outside and at the sentinel."""
    there = cells.withColumn(value, N.present(F.col(value), nodata, tolerance))
    return points.join(there.select("row", "col", value), ["row", "col"], "left")


def all_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
