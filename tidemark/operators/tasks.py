"""What there is to do: scenes, grids and seasons, and what of it is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.schema import SEASONS


def checked_seasons(wanted: str | list[str] | None) -> list[str]:
    """Known seasons in their order; an unknown one is an error."""
    wanted = list(SEASONS) if wanted is None else [wanted] if isinstance(wanted, str) else list(wanted)
    if unknown := sorted(set(wanted) - set(SEASONS)):
        raise ValueError(f"unknown seasons {unknown}: known are {list(SEASONS)}")
    return [s for s in SEASONS if s in wanted]


def task_list(scenes: DataFrame, seasons: str | list[str] | None = None, grids: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """season, grid_id, place: by season's order, then grid number."""
    out = scenes.filter(F.col("season").isin(checked_seasons(seasons))).select("season", "grid_id").distinct()
    if grids is not None:
        out = out.filter(F.col("grid_id").isin(grids))
    if first is not None or last is not None:
        out = out.filter(F.col("grid_id").between(first if first is not None else -(1 << 31), last if last is not None else 1 << 31))
    return out.withColumn("place", names.season_place(F.col("season"))).orderBy("place", "grid_id")


def complete(files: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """Keys that have every required kind of file."""
    return files.filter(F.col("kind").isin(required)).groupBy(*key).agg(F.count_distinct("kind").alias("kinds")).filter(F.col("kinds") == len(required)).select(*key)


def prefix_of(folders: DataFrame, manual: str | None = None) -> DataFrame:
    """Numbered folders with the commonest prefix (ties by name), or a given one, in numeric order."""
    found = folders.select("folder", names.grid_prefix(F.col("folder")).alias("prefix")).filter("prefix IS NOT NULL")
    if manual is None:
        best = found.groupBy("prefix").count().orderBy(F.desc("count"), "prefix").limit(1)
        found = found.join(F.broadcast(best.select("prefix")), "prefix", "left_semi")  # one row
    else:
        found = found.filter(F.col("prefix") == manual)
    return found.withColumn("number", F.expr("cast(substring(folder, length(prefix) + 1) AS int)")).orderBy("number", "folder")


def prefix_or_error(folders: DataFrame, manual: str | None = None, shown: int = 20) -> DataFrame:
    """prefix_of(), or an error that names the folders that are there, if none of them has a number."""
    out = prefix_of(folders, manual)
    if out.isEmpty():
        there = sorted(r.folder for r in folders.select("folder").limit(shown).collect())
        raise ValueError(f"no numbered folders{f' of {manual}' if manual else ''} among: {', '.join(there) or 'nothing'}")
    return out


def grid_names(folders: DataFrame) -> DataFrame:
    """Names of grids, in the order of their letters: grid_10 comes before grid_9."""
    return folders.select("folder").filter(F.col("folder").rlike(r"^grid_\d+$")).distinct().orderBy("folder")


def on_date(scenes: DataFrame, date: str) -> DataFrame:
    """Of each season and grid the scene of exactly this day, the first by path."""
    there = scenes.filter(F.col("scene_date") == F.to_date(F.lit(date)))
    return there.groupBy("season", "grid_id").agg(F.min("path").alias("path"), F.min("scene_date").alias("scene_date"))


def within(rows: DataFrame, index: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose index is in one of the ranges [start, stop): a filter that reaches the scan."""
    any_of = F.lit(False)
    for start, stop in ranges:
        any_of = any_of | ((F.col(index) >= start) & (F.col(index) < stop))
    return rows.filter(any_of)


def layers_folder(cubes: str, given: str | None, exists) -> str | None:
    """Where the parameter layers of a cube folder are: the given folder, else a sibling for seasons, else a plain one,
    else nowhere. exists(path) tells what is there."""
    parent = cubes.rstrip("/").rpartition("/")[0]
    return next((f for f in (given, *(f"{parent}/{n}" for n in ("tcev_seasonal", "tcev"))) if f and exists(f)), None)


def pending(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks without a completed output."""
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def seasons_complete(expected: DataFrame, done: DataFrame) -> DataFrame:
    """season, expected, finished, complete: whether all of a season's grids are done."""
    both = expected.select("season", "grid_id").distinct().join(done.select("season", "grid_id").distinct().withColumn("is", F.lit(1)), ["season", "grid_id"], "left")
    return both.groupBy("season").agg(F.count(F.lit(1)).alias("expected"), F.count("is").alias("finished")).withColumn("complete", F.col("expected") == F.col("finished"))


def reference_scenes(tasks: DataFrame, scenes: DataFrame) -> DataFrame:
    """tasks(season, grid_id) with the earliest scene, undated ones last, ties by path."""
    rank = F.struct(F.coalesce("scene_date", F.to_date(F.lit("9999-12-31"))), F.col("path"))
    first = scenes.groupBy("season", "grid_id").agg(F.min_by("path", rank).alias("path"), F.min("scene_date").alias("scene_date"))
    return tasks.select("season", "grid_id").distinct().join(first, ["season", "grid_id"])


def in_range(date: Column, start: str | None = None, end: str | None = None) -> Column:
    """Both ends count, either may be open; no date, no match."""
    out = date.isNotNull()
    if start is not None:
        out = out & (date >= F.to_date(F.lit(start)))
    if end is not None:
        out = out & (date <= F.to_date(F.lit(end)))
    return out


def distinct_scenes(*scans: DataFrame) -> DataFrame:
    """Scans of several layouts as one, a path once, in time order with a slot from 0."""
    out = scans[0]
    for other in scans[1:]:
        out = out.unionByName(other)
    out = out.filter("scene_date IS NOT NULL").dropDuplicates(["path"])
    return out.withColumn("slot", F.row_number().over(Window.partitionBy("grid_id", "season").orderBy("scene_date", "path")) - 1)


def run_matrix(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Enabled sources with the targets and the seasons that both name: two small configuration tables."""
    pairs = sources.filter("enabled").select("source", F.explode("seasons").alias("season"))
    return pairs.join(targets.select("target", F.explode("seasons").alias("season")), "season")


def totals(files: DataFrame, outer: str, inner: str) -> DataFrame:
    """Files by (outer, inner), by outer, and in all."""
    return files.rollup(outer, inner).agg(F.count(F.lit(1)).alias("files"))


def grid_split(grids: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """grid_id, part: max(1, int(n * ratio)) grids, first by a seeded hash, are for validation; with under two
    grids there is none."""
    w = Window.orderBy(F.md5(F.concat(F.col("grid_id").cast("string"), F.lit(f":{seed}"))), "grid_id")  # a row a grid
    out = grids.select("grid_id").distinct().withColumn("place", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    held = F.when(F.col("n") >= 2, F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).otherwise(F.lit(0))
    return out.select("grid_id", F.when(F.col("place") <= held, "validation").otherwise("training").alias("part"))


def row_split(rows: DataFrame, key: list[str], ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with part: by a seeded hash of key a share of about ratio is for validation, the same on every run and for any
    partitioning."""
    text = F.concat_ws(":", *(F.col(k).cast("string") for k in key), F.lit(str(seed)))
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return rows.withColumn("part", F.when(place < ratio, "validation").otherwise("training"))


def boundaries(rows: DataFrame, key: str, index: str) -> DataFrame:
    """First row of each key and the one after its last."""
    return rows.groupBy(key).agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"))
