"""Scenes from a folder of files, and the tables they become."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators.lattice import Profile
from tidemark.sources import tiff

SUFFIXES = ("tif", "tiff", "img")


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("tif",), recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, file_name, folder of the files below a folder, by suffix in any case and by a pattern of names. Contents
    aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.element_at(F.split("path", "/"), -2)
    return found.select("path", name.alias("file_name"), parent.alias("folder")).filter(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*suffixes))


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Dated scenes below month_MM/grid_NN or grid_NN; names without a date go, a path counts once."""
    found = files(spark, folder).dropDuplicates(["path"])
    n = F.col("file_name")
    out = found.select(
        "path", "file_name", names.grid_number(F.col("folder")).alias("grid_id"), names.strict_date(n).alias("scene_date"), names.orbit(n).alias("orbit"), F.try_element_at(F.split(names.stem(n), "_"), F.lit(3)).alias("polarization"),
    )
    out = out.filter("scene_date IS NOT NULL").withColumn("month", F.month("scene_date"))
    return out.withColumn("season", names.season_of(F.col("month")))


def by_key(rows: DataFrame, keys: list[str], folder: str, dry_run: bool = False) -> DataFrame:
    """Write rows below a folder by key, or (dry run) return what would be written where."""
    if not dry_run:
        rows.write.mode("overwrite").partitionBy(*keys).parquet(folder)
    return rows.groupBy(*keys).count()


def write_cube(rows: DataFrame, folder: str, attributes: dict | None = None) -> None:
    """Parquet by season and grid, so that both prune; attributes (of any JSON kind) go into a table beside it."""
    rows.repartition("season", "grid_id", "row").write.mode("overwrite").partitionBy("season", "grid_id").parquet(folder)
    if attributes is not None:
        _write_attributes(rows.sparkSession, attributes, folder)


def _write_attributes(spark: SparkSession, attributes: dict, folder: str) -> None:
    rows = [(str(k), json.dumps(v)) for k, v in attributes.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}.attributes")


def read_attributes(spark: SparkSession, folder: str, channels: int | None = None) -> dict:
    """The attributes of a cube; with channels, an error unless its in_channels are as many."""
    out = {r.name: json.loads(r.value) for r in spark.read.parquet(f"{folder.rstrip('/')}.attributes").collect()}
    if channels is not None and out.get("in_channels") != channels:
        raise ValueError(f"{folder} has {out.get('in_channels')} channels, not {channels}")
    return out


def write_label_map(labels: DataFrame, folder: str, attributes: dict | None = None) -> None:
    """Cells with label 1, 0 or -1 (no label) as bytes, in rows' order, and what describes them."""
    cells = labels.withColumn("label", F.coalesce("label", F.lit(-1)).cast("byte"))
    cells.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(folder)
    _write_attributes(labels.sparkSession, attributes or {}, folder)


def write_samples_of(pixel: DataFrame, series: DataFrame, folder: str) -> None:
    """A fitted pixel as two CSV tables: its series, and its parameters one a row."""
    key = [c for c in ("grid_id", "row", "col", "season") if c in pixel.columns]
    of = series.join(F.broadcast(pixel.select(*key)), key).select("k", "x", "f").orderBy("k")  # one row
    of.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/series")
    layers = [c for c in pixel.columns if c not in key]
    rows = pixel.select(F.explode(F.array(*(F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("value")) for c in layers))).alias("p")).select("p.*")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/parameters")


def write_raster(cells: DataFrame, value: str, folder: str, nodata: float = -9999.0) -> None:
    """Cells with the sentinel where the value is missing: the only place where it exists."""
    cells.withColumn(value, F.coalesce(F.col(value).cast("float"), F.lit(nodata).cast("float"))).write.mode("overwrite").parquet(folder)


def write_samples(samples: DataFrame, folder: str) -> None:
    samples.write.mode("overwrite").option("header", True).csv(folder)


def write_geotiffs(cells: DataFrame, values: list[str], folder: str, profile: Profile, key: list[str] | None = None, nodata: float | None = -9999.0, block: int = 2048) -> DataFrame:
    """Cells as GeoTIFF files in folder (one that all machines share): key, path, rows of what was written.

    A file holds block rows of one key, has the georeference of its first row, and bands in the order of values;
    so no task holds a whole raster. A missing value is the sentinel, or NaN with nodata None."""
    key = key or []
    gt = (profile.origin_x, profile.px_w, 0.0, profile.origin_y, 0.0, profile.px_h)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["block"].iloc[0]) * block
        n = min(block, profile.height - first)
        data = np.full((n, profile.width, len(values)), np.nan if nodata is None else nodata, np.float32)
        given = rows[values].to_numpy(np.float64)
        at, col = rows["row"].to_numpy() - first, rows["col"].to_numpy()
        data[at, col] = given if nodata is None else np.where(np.isnan(given), nodata, given)
        os.makedirs(folder, exist_ok=True)
        names = [str(rows[k].iloc[0]) for k in key]
        path = f"{folder}/{'_'.join([*names, f'{first:08d}'])}.tif"
        with open(f"{path}.{uuid.uuid4().hex}.part", "wb") as f:
            f.write(tiff.encoded(data, (*gt[:3], gt[3] + first * gt[5], *gt[4:]), profile.crs, nodata))
        os.replace(f.name, path)  # a task that runs twice leaves one whole file
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in key}, "path": [path], "rows": [n]})

    inside = cells.filter(F.col("row").between(0, profile.height - 1) & F.col("col").between(0, profile.width - 1))
    of = inside.select(*key, "row", "col", F.floor(F.col("row") / block).cast("long").alias("block"), *(F.col(v).cast("double").alias(v) for v in values))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.select(*key).schema)
    return of.groupBy(*key, "block").applyInPandas(write, f"{kinds}path string, rows int")
