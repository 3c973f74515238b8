"""Rasters read out of the benchmark tables: every view is a projection, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import cube

TIES = ["l_orderkey", "l_linenumber", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel series: a pixel a supplier, a value a line of an order."""
    t = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    return t.select(
        (F.col("l_suppkey") % 12 + 1).alias("grid_id"),
        F.expr("l_suppkey div 10").alias("row"),
        (F.col("l_suppkey") % 10).alias("col"),
        day.alias("scene_date"),
        names.season_of(F.month(day)).alias("season"),
        (-F.col("l_extendedprice") / 3000.0).alias("db"),
        "l_returnflag",
        *TIES,
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.observations(pixels(spark, sf_dir))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.order_statistics(observations(spark, sf_dir), TIES)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue: a scene a grid and day."""
    p = pixels(spark, sf_dir).select("grid_id", "scene_date", "season").distinct()
    name = F.concat(F.lit("Image_"), F.date_format("scene_date", "yyyyMMdd"), F.lit("_VH_"), F.col("grid_id").cast("string"), F.lit(".tif"))
    return p.withColumn("file_name", name).withColumn("path", F.concat(names.month_label(F.month("scene_date")), F.lit("/"), names.grid_label(F.col("grid_id")), F.lit("/"), F.col("file_name"))).withColumn("month", F.month("scene_date"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles: a tile a return flag; cells with a mean over 16 are missing."""
    t = observations(spark, sf_dir).groupBy("row", "col", F.col("l_returnflag").alias("ord")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))
    return t.withColumn("value", F.when(F.col("value") <= 16, F.col("value")))


def headers(spark: SparkSession) -> DataFrame:
    """Headers of the tiles: origins that aren't whole pixels apart, one of them half a pixel."""
    rows = [(flag, k, 10, 101, (10.0 + 1.25 * k, 0.5, 0.0, 50.0 - 0.74 * k, 0.0, -0.5)) for k, flag in enumerate("ANR")]
    return spark.createDataFrame(rows, "tile string, ord int, width int, height int, gt struct<origin_x: double, px_w: double, rot_x: double, origin_y: double, rot_y: double, px_h: double>")


def placed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tiles(), by the names that headers() has."""
    return tiles(spark, sf_dir).withColumnRenamed("ord", "tile")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 7 <> 3").select(F.expr("s_suppkey div 10").alias("row"), (F.col("s_suppkey") % 10).alias("col"), (F.col("s_acctbal") > 5000).cast("int").alias("mask"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a logit and a score of text length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    logit = F.round((F.col("n_chars") - 1500) / 1000.0, 6)
    return d.select("doc_id", "label", logit.alias("logit"), F.round(1 / (1 + F.exp(-logit)), 6).alias("score"))
