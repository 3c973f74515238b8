"""Labels, losses and measures of a binary classifier, on rows (score, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N


def label_of_logit(logit: Column, threshold: float = 0.5) -> Column:
    """1 where the logit's probability reaches the threshold. A missing logit has a missing label."""
    at = logit >= 0 if threshold == 0.5 else N.sigmoid(logit) >= threshold
    return F.when(~F.isnan(logit), at.cast("int"))


def label_of_probability(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def counts(rows: DataFrame, key: list[str], label: str = "pred") -> DataFrame:
    """Cells, cells with a label, floods, and their share of those."""
    n = F.count(label)
    flood = F.count_if(F.col(label) == 1)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("cells"), n.alias("valid"), flood.alias("flood"), (flood / F.greatest(n, F.lit(1))).alias("flood_ratio"))


def class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Negatives over positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.agg(pos.alias("positives"), neg.alias("negatives"), (neg / (pos + 1e-7)).alias("weight"))


def f1(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = F.col("score") >= threshold
    tp, fp, fn = F.count_if(p & (F.col("label") == 1)), F.count_if(p & (F.col("label") == 0)), F.count_if(~p & (F.col("label") == 1))
    out = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    out = out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp") + 1e-7)).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn") + 1e-7))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-7))


def auc(rows: DataFrame, steps: int = 100) -> DataFrame:
    """Area under the curve through steps + 1 thresholds from 1 to 0 and both corners, by trapezoids; 0.5 where a
    class is missing.

    Scores fall into steps + 1 bins first (the highest threshold that they reach), so no row is compared with
    every threshold and one short row a bin reaches the window."""
    exact = F.floor(F.col("score") * steps).cast("int")
    top = F.greatest(F.least(exact + 1, F.lit(steps)), F.lit(0))  # guards the edge: compare with the threshold itself
    bin_ = F.when(F.col("score") >= top / steps, top).when(F.col("score") >= exact / steps, exact).otherwise(exact - 1)
    binned = rows.filter("score IS NOT NULL AND label IS NOT NULL").groupBy(F.least(bin_, F.lit(steps)).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    levels = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bin"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    curve = levels.join(binned, "bin", "left")  # steps + 1 rows
    curve = curve.select("bin", F.sum(F.coalesce("p", F.lit(0))).over(down).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(down).alias("fp"), F.sum(F.coalesce("p", F.lit(0))).over(every).alias("pos"), F.sum(F.coalesce("n", F.lit(0))).over(every).alias("neg"))
    rate = curve.select("bin", F.try_divide("tp", "pos").alias("y"), F.try_divide("fp", "neg").alias("x"))
    order = Window.orderBy(F.desc("bin"))
    area = rate.select("bin", "x", "y", F.coalesce(F.lag("x").over(order), F.lit(0.0)).alias("x0"), F.coalesce(F.lag("y").over(order), F.lit(0.0)).alias("y0"))
    # from the last threshold to the corner (1, 1)
    last = F.max_by(F.struct("x", "y"), -F.col("bin"))
    got = area.agg(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2).alias("inner"), last.alias("last"))
    return got.select(F.coalesce(F.col("inner") + (1 - F.col("last.x")) * (1 + F.col("last.y")) / 2, F.lit(0.5)).alias("auc"))


def focal_loss(logit: Column, label: Column, gamma: float = 2.0, weight: float = 1.0) -> Column:
    """Cross-entropy times (1 - p of the label) ** gamma, positives times weight; p is kept off 0 and 1 by 1e-7."""
    p = F.least(F.greatest(N.sigmoid(logit), F.lit(1e-7)), F.lit(1 - 1e-7))
    of_label = F.when(label == 1, p).otherwise(1 - p)
    return F.when(label == 1, F.lit(weight)).otherwise(F.lit(1.0)) * F.pow(1 - of_label, F.lit(gamma)) * -F.log(of_label)
