"""Canonical schemas. A missing value is NULL, never NaN; sentinels exist at sources and sinks only."""

from __future__ import annotations

from pyspark.sql import types as T

#: The months of each season, in the order in which seasons are listed.
SEASONS = {"spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11), "winter": (12, 1, 2)}
SEASON_OF_MONTH = {m: s for s, months in SEASONS.items() for m in months}

#: The parameter layers of a fit, in the order of their bands.
LAYERS = ("R_index", "L1_alpha", "L1_beta", "L2_alpha", "L2_beta", "breakpoint_DB", "breakpoint_FX", "piecewise_residual", "linear_residual", "n_valid")
#: The inputs of the tabular classifier.
FEATURES = ("R_index", "L1_alpha", "L1_beta", "L2_alpha", "L2_beta", "breakpoint_DB", "breakpoint_FX", "db_range", "top10_mean")

NODATA = -9999.0
PIXEL = ["grid_id", "row", "col"]
SERIES = [*PIXEL, "season"]

GEOTRANSFORM = T.StructType([T.StructField(n, T.DoubleType()) for n in ("origin_x", "px_w", "rot_x", "origin_y", "rot_y", "px_h")])

SCENE = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("grid_id", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("scene_date", T.DateType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("season", T.StringType()),
        T.StructField("polarization", T.StringType()),
        T.StructField("orbit", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("gt", GEOTRANSFORM),
        T.StructField("crs", T.StringType()),
        T.StructField("nodata", T.DoubleType()),
    ]
)

LABEL_POINTS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("label", T.ByteType())])
