"""Two-component extreme-value fit of a pixel's history, and the score of new scenes against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.schema import LAYERS, SERIES

LEAST = 8
LEAST_SLOPE = 1e-10


def survivors(stats: DataFrame, threshold: float = 30.0, key: list[str] = SERIES) -> DataFrame:
    """Order statistics with x and y (reduced variate) as doubles where they take part in a fit and NULL elsewhere,
    their place i from 0 among those that do, and their number m."""
    part = (F.col("f") > 0) & (F.col("f") < 1) & (F.col("x") <= threshold)
    series = Window.partitionBy(*key)
    out = stats.select(*key, "k", F.when(part, F.col("x").cast("double")).alias("x"), F.when(part, F.col("f").cast("double")).alias("f"))
    out = out.withColumn("y", N.gumbel(F.col("f")))
    so_far = series.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("i", F.when(F.col("x").isNotNull(), F.count("x").over(so_far) - 1)).withColumn("m", F.count("x").over(series))


def breakpoints(points: DataFrame, key: list[str] = SERIES) -> DataFrame:
    """points with the place b of the breakpoint: of the places from max(m div 2, m - 24) to m - 5, the one where the
    slopes before it and from it on differ most, the largest of equals; without a candidate (m = 8), the middle of
    m div 2 and m - 4. NULL under eight points.

    Both slopes are running aggregates: the one after a place runs down from the end."""
    series = Window.partitionBy(*key)
    before = F.regr_slope("y", "x").over(series.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    after = F.regr_slope("y", "x").over(series.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    half = F.expr("m div 2")
    candidate = F.col("i").between(F.greatest(half, F.col("m") - 24), F.col("m") - 5)
    out = points.withColumn("gap", F.abs(F.coalesce(after, F.lit(0.0)) - F.coalesce(before, F.lit(0.0))))
    best = F.max(F.when(candidate, F.struct("gap", "i"))).over(series)
    out = out.withColumn("best", best).withColumn("b", F.when(F.col("m") >= LEAST, F.coalesce(F.col("best.i"), F.expr("(m div 2 + m - 4) div 2"))))
    return out.withColumn("gap", F.col("best.gap")).drop("best")


def _line(side: Column) -> dict[str, Column]:
    x, y = F.when(side, F.col("x")), F.when(side, F.col("y"))
    return {"slope": F.regr_slope(y, x), "x": F.avg(x), "y": F.avg(y), "n": F.count(x), "syy": F.regr_syy(y, x), "sxy": F.regr_sxy(y, x)}


def fit(stats: DataFrame, threshold: float = 30.0, key: list[str] = SERIES) -> DataFrame:
    """One row a series: the ten layers, and fit_error where there is none (then all layers are NULL).

    A free line left of the breakpoint, a slope right of it, joined at it. A side without variance has slope 0.
    Residuals are closed forms of the same aggregates, so the whole fit is windows and one aggregation on one
    exchange."""
    series = Window.partitionBy(*key)
    points = breakpoints(survivors(stats, threshold, key), key)
    points = points.withColumn("bp", F.max(F.when(F.col("i") == F.col("b"), F.col("x"))).over(series))
    left, right, both = _line(F.col("i") < F.col("b")), _line(F.col("i") >= F.col("b")), _line(F.col("x").isNotNull())
    aggs = [v.alias(f"{side}_{k}") for side, line in (("l", left), ("r", right), ("w", both)) for k, v in line.items()]
    near = F.min_by("f", F.when(F.col("x").isNotNull(), F.struct(F.abs(F.col("x") - F.col("bp")), F.col("i"))))
    got = points.groupBy(*key).agg(F.max("m").alias("m"), F.max("bp").alias("bp"), near.alias("bp_fx"), *aggs)
    zero = F.lit(0.0)
    a1, a2, a = (F.coalesce(F.col(f"{s}_slope"), zero) for s in "lrw")
    c1 = F.col("l_y") - a1 * F.col("l_x")
    c2 = a1 * F.col("bp") + c1 - a2 * F.col("bp")
    got = got.withColumns({"a1": a1, "a2": a2, "c1": c1, "c2": c2})
    a1, a2, c1, c2 = map(F.col, ("a1", "a2", "c1", "c2"))
    sse_left = F.col("l_syy") - a1 * F.col("l_sxy")
    off = F.col("r_y") - a2 * F.col("r_x") - c2
    sse_right = F.col("r_syy") - a2 * F.col("r_sxy") + F.col("r_n") * off * off
    sse = F.col("w_syy") - a * F.col("w_sxy")
    flat = (F.abs(a1) < LEAST_SLOPE) | (F.abs(a2) < LEAST_SLOPE)
    error = F.when(F.col("m") < LEAST, "too few points").when(flat, "slope near zero")
    values = {
        "R_index": F.try_divide(a2, a1),
        "L1_alpha": a1,
        "L1_beta": F.try_divide(-c1, a1),
        "L2_alpha": a2,
        "L2_beta": F.try_divide(-c2, a2),
        "breakpoint_DB": F.col("bp"),
        "breakpoint_FX": F.col("bp_fx"),
        "piecewise_residual": F.sqrt(F.greatest(sse_left + sse_right, zero) / F.col("m")),
        "linear_residual": F.sqrt(F.greatest(sse, zero) / F.col("m")),
        "n_valid": F.col("m").cast("double"),
    }
    got = got.withColumn("fit_error", error)
    return got.select(*key, *(F.when(F.col("fit_error").isNull(), values[c]).alias(c) for c in LAYERS), "fit_error")


def ols(points: DataFrame, key: list[str] = SERIES) -> DataFrame:
    """Slope (0 without variance) and intercept of y on x."""
    slope = F.coalesce(F.regr_slope("y", "x"), F.lit(0.0))
    return points.groupBy(*key).agg(slope.alias("slope"), (F.avg(F.when(F.col("y").isNotNull(), F.col("y"))) - slope * F.avg(F.when(F.col("y").isNotNull(), F.col("x")))).alias("intercept"))


def score(event: DataFrame, layers: DataFrame, key: list[str]) -> DataFrame:
    """event with fx, the non-exceedance probability of x under its pixel's fit; NULL if anything is missing."""
    names = ["L1_alpha", "L1_beta", "L2_alpha", "L2_beta"]
    return event.join(layers.select(*key, *names), key, "left").withColumn("fx", N.tcev(F.col("x").cast("double"), *map(F.col, names))).drop(*names)


def error_histogram(fitted: DataFrame, top: int = 3) -> DataFrame:
    """The commonest errors, ties by name."""
    return fitted.filter("fit_error IS NOT NULL").groupBy("fit_error").count().orderBy(F.desc("count"), "fit_error").limit(top)


def sample_pixel(fitted: DataFrame, row: int, col: int) -> DataFrame:
    """The fitted pixel nearest to (row, col), ties by place and season."""
    away = (F.col("row") - row) * (F.col("row") - row) + (F.col("col") - col) * (F.col("col") - col)
    return fitted.filter("fit_error IS NULL").withColumn("away", away).orderBy("away", "row", "col", "grid_id", "season").limit(1)
