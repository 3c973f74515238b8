"""From scenes to order statistics: one row a pixel and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.schema import SERIES


def observations(pixels: DataFrame, db: str = "db", ceiling: float = 30.0) -> DataFrame:
    """pixels with x = -db, NULL above the ceiling."""
    return pixels.withColumn("x", N.masked(N.negated(F.col(db)), ceiling))


def order_statistics(obs: DataFrame, ties: list[str], key: list[str] = SERIES) -> DataFrame:
    """Present observations with rank k in their series, its length n, and the plotting position f = k / (n + 1).

    ties orders equal x and must be unique in a series. One exchange on the key."""
    series = Window.partitionBy(*key)
    out = obs.filter(F.col("x").isNotNull()).withColumn("k", F.row_number().over(series.orderBy("x", *ties)))
    out = out.withColumn("n", F.count(F.lit(1)).over(series))
    return out.withColumn("f", N.plotting_position(F.col("k"), F.col("n")))


def sort_order(obs: DataFrame, ties: list[str], slots: list[str], key: list[str] = SERIES) -> DataFrame:
    """The k-th smallest value stands in the k-th slot that holds one: slot, src_slot (where the value came from).

    Slots are numbered from 0 in the order of the columns slots; slots without a value have src_slot -1. A series is
    put in order once, as one array of its scenes, on the exchange that numbered its slots."""
    series = Window.partitionBy(*key)
    out = obs.withColumn("slot", F.row_number().over(series.orderBy(*slots)) - 1)
    has = F.col("x").isNotNull()
    values = F.sort_array(F.collect_list(F.when(has, F.struct("x", *ties, "slot"))))
    places = F.sort_array(F.collect_list(F.when(has, F.col("slot"))))
    out = out.groupBy(*key).agg(values.alias("values"), places.alias("places"), F.collect_list(F.when(~has, F.col("slot"))).alias("gaps"))
    filled = F.zip_with("places", "values", lambda p, v: F.struct(p.alias("slot"), v["x"].alias("x"), v["slot"].alias("src_slot")))
    empty = F.transform("gaps", lambda p: F.struct(p.alias("slot"), F.lit(None).cast(obs.schema["x"].dataType).alias("x"), F.lit(-1).alias("src_slot")))
    return out.select(*key, F.explode(F.concat(filled, empty)).alias("s")).select(*key, "s.*")


def normalised(obs: DataFrame, key: list[str] = SERIES) -> DataFrame:
    """x_norm in [0, 1] by series; NULL, with its bounds, where the series is constant or empty."""
    series = Window.partitionBy(*key)
    out = obs.withColumn("lo", F.min("x").over(series)).withColumn("hi", F.max("x").over(series))
    varies = F.col("hi") > F.col("lo")
    span = F.col("hi").cast("double") - F.col("lo").cast("double")
    out = out.withColumn("x_norm", F.when(varies, (F.col("x").cast("double") - F.col("lo").cast("double")) / F.when(varies, span)))
    return out.withColumn("pixel_min", F.when(varies, F.col("lo"))).withColumn("pixel_max", F.when(varies, F.col("hi"))).drop("lo", "hi")


def slots(scenes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Scenes with their place in time, from 0."""
    return scenes.withColumn("slot", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
