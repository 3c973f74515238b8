"""Inputs of the classifiers: nine features of a pixel, five channels of its curve, labelled points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.schema import FEATURES, SERIES


def extra_features(stats: DataFrame, key: list[str] = SERIES) -> DataFrame:
    """db_range: largest less smallest value, NULL under two; top10_mean: mean of the sorted values from place
    int(0.9 n) on."""
    x = F.col("x").cast("double")
    top = F.avg(F.when(F.col("k") - 1 >= F.floor(F.col("n") * 0.9), x))
    return stats.groupBy(*key).agg(F.when(F.count("x") >= 2, F.max(x) - F.min(x)).alias("db_range"), top.alias("top10_mean"))


def features9(layers: DataFrame, extra: DataFrame, key: list[str] = SERIES) -> DataFrame:
    """Both sides' features of the pixels that both have."""
    return layers.join(extra, key).select(*key, *FEATURES)


def _side_slope(side: Column, least: int) -> Column:
    x, y = F.when(side, F.col("x")), F.when(side, F.col("y"))
    return F.when((F.count(x) >= least) & (F.regr_sxx(y, x) >= 1e-12), F.regr_slope(y, x))


def curve_points(stats: DataFrame, layers: DataFrame, least: int = 4, key: list[str] = SERIES) -> DataFrame:
    """Points of series with a breakpoint and at least `least` points: x, f and the clipped reduced variate y."""
    points = stats.filter((F.col("f") > 0) & (F.col("f") < 1)).join(layers.filter("breakpoint_DB IS NOT NULL").select(*key, F.col("breakpoint_DB").alias("bp")), key)
    points = points.select(*key, "k", F.col("x").cast("double").alias("x"), F.col("f").cast("double").alias("f"), "bp").withColumn("y", N.gumbel(F.col("f"), 1e-6).cast("float").cast("double"))
    return points.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter(F.col("m") >= least)


def slope_ratio(points: DataFrame, least: int = 2, key: list[str] = SERIES) -> DataFrame:
    """Slope above the breakpoint over that up to it; NULL where either is missing or the lower is flat."""
    low, high = _side_slope(F.col("x") <= F.col("bp"), least), _side_slope(F.col("x") > F.col("bp"), least)
    return points.groupBy(*key).agg(low.alias("low"), high.alias("high")).select(*key, F.when(F.abs("low") >= 1e-12, F.try_divide("high", "low")).alias("slope_ratio"))


def curves(points: DataFrame, length: int = 16, key: list[str] = SERIES) -> DataFrame:
    """Five channels: values, reduced variates and frequencies, each brought to length items, slope ratio, breakpoint."""
    low, high = _side_slope(F.col("x") <= F.col("bp"), 2), _side_slope(F.col("x") > F.col("bp"), 2)
    rows = F.sort_array(F.collect_list(F.struct("k", "x", "y", "f")))
    out = points.groupBy(*key).agg(rows.alias("rows"), F.max("bp").alias("bp_db"), low.alias("low"), high.alias("high"))
    out = out.withColumn("slope_ratio", F.when(F.abs("low") >= 1e-12, F.try_divide("high", "low")))
    channel = lambda c: N.resampled(F.col(f"rows.{c}"), length)
    return out.select(*key, channel("x").alias("raw_db"), channel("y").alias("gumbel"), channel("f").alias("fx"), "slope_ratio", "bp_db")


def recoded(points: DataFrame, label: str = "label", codes: dict[int, int] | None = None) -> DataFrame:
    """Labels by the map (1 to 0 and 2 to 1 by default); other rows go."""
    codes = codes or {1: 0, 2: 1}
    to = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return points.withColumn(label, F.try_element_at(to, F.col(label).cast("int"))).filter(F.col(label).isNotNull())


def sample_points(points: DataFrame, boxes: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
    """points(point_id, x, y) with values of the cell they lie in. The first box (least grid_id) that holds a point
    takes it, even if its cell there is missing.

    Boxes are one row a grid; Spark broadcasts them while they are small."""
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    hit = points.join(boxes, inside)
    hit = hit.withColumn("col", N.pixel_index(F.col("x"), F.col("x_min"), F.col("px_w"))).withColumn("row", N.pixel_index(F.col("y_max") - F.col("y"), F.lit(0.0), F.col("px_h")))
    hit = hit.filter("col >= 0 AND row >= 0 AND col < width AND row < height")
    first = hit.groupBy("point_id").agg(F.min_by(F.struct("grid_id", "row", "col", "x", "y"), "grid_id").alias("p")).select("point_id", "p.*")
    return first.join(cells.select("grid_id", "row", "col", *values), ["grid_id", "row", "col"], "left")


def training_samples(sampled: DataFrame, labels: DataFrame, values: list[str]) -> DataFrame:
    """Complete rows with their label; check_samples() tells whether they are enough."""
    return sampled.join(labels, "point_id").dropna("any", subset=[*values, "label"])


def check_samples(samples: DataFrame, least: int = 6) -> None:
    """Both classes and enough rows, else an error."""
    n, kinds = samples.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n < least or kinds < 2:
        raise ValueError(f"{n} samples of {kinds} classes: at least {least} of both are needed")
