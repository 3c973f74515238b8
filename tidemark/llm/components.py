"""Connected components by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of it) of every node in edges(u, v); loops, repeats and nulls don't matter.

    In each round every node joins the neighbour (or itself) of least hash, and edges are redrawn between those:
    the number of nodes with edges falls by a constant factor at least, as hashes are random, so the rounds grow
    with the logarithm of the input. Nothing but whether edges remain reaches the driver. Hubs are looked up by
    broadcast (see base.looked_up), and minima are combined before each shuffle.
    """
    e = edges.filter(F.col("u") != F.col("v")).select("u", "v")
    e = base.saved(e.union(e.select("v", "u")).distinct(), "edges")
    levels: list[DataFrame] = []
    while rows := e.count():
        least = e.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("near"), F.count(F.lit(1)).alias("degree"))
        up = F.when(F.xxhash64("near") < F.xxhash64("u"), F.col("near")).otherwise(F.col("u"))
        level = base.saved(least.select("u", up.alias("up"), "degree"), "level")
        levels.append(level)
        ends = base.looked_up(e, level, "u", "degree", rows).select(F.col("up").alias("a"), F.col("v").alias("u"))
        ends = base.looked_up(ends, level, "u", "degree", rows).select(F.col("a").alias("u"), F.col("up").alias("v"))
        after = base.saved(ends.filter(F.col("u") != F.col("v")).distinct(), "edges")
        base.forget(e)
        e = after
    if not levels:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = levels[0].select("u", "up")
    for level in levels[1:]:
        then = level.select(F.col("u").alias("up"), F.col("up").alias("top"))
        root = root.join(then, "up", "left").select("u", F.coalesce("top", "up").alias("up"))
    root = base.saved(root, "roots")
    least = base.saved(root.groupBy("up").agg(F.min("u").alias("component"), F.count(F.lit(1)).alias("size")), "least")
    return base.looked_up(root, least, "up", "size", root.count()).select(F.col("u").alias("node"), "component")
