"""New scenes scored as they arrive, against layers that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import tcev
from tidemark.schema import SERIES


def scored(stream: DataFrame, layers: DataFrame) -> DataFrame:
    """A stream of pixels(grid_id, row, col, season, db) with fx: a stream-static join, without state."""
    return tcev.score(stream.withColumn("x", -F.col("db").cast("float")), layers, SERIES)


def daily(stream: DataFrame, layers: DataFrame, late: str = "2 days") -> DataFrame:
    """Cells, valid cells and least and largest fx by day of arrival time ts; rows later than that are dropped."""
    rows = scored(stream.withWatermark("ts", late), layers)
    return rows.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("cells"), F.count("fx").alias("valid"), F.min("fx").alias("fx_min"), F.max("fx").alias("fx_max"))


def write(stream: DataFrame, layers: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Scores to Parquet by day, each row once; what is there already is scored and the query ends."""
    out = scored(stream, layers).withColumn("day", F.to_date("ts"))
    return out.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
