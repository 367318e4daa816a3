"""The tables that figures are drawn from."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import keys


# Pixels of a figure, categories that each step of width holds, the size of groups whose points are shown.
WIDTH, WIDTH_STEP, WIDTH_MOST, STEP_CATEGORIES, POINTS_BELOW = 600, 300, 1800, 6, 100


def plot_width(n_categories: int) -> int:
    """600 pixels for up to six categories, 300 more for each further six, at most 1800."""
    steps = max(0, math.ceil((n_categories - STEP_CATEGORIES) / STEP_CATEGORIES))
    return min(WIDTH_MOST, WIDTH + steps * WIDTH_STEP)


def should_show_points(group_sizes: Iterable[int]) -> bool:
    return 0 < max(group_sizes, default=-1) + 1 <= POINTS_BELOW


def group_order(samples: DataFrame, by: str, declared: list[str] | None = None) -> list[str]:
    """The groups that occur, in the declared order or else sorted; a handful."""
    found = {r[0] for r in samples.select(F.col(by).cast("string")).where(F.col(by).isNotNull()).distinct().collect()}
    return [g for g in declared if g in found] if declared else sorted(found)


def volcano(result: DataFrame, fdr: float = 0.05, log2fc: float = 1.0) -> DataFrame:
    """Adds neg_log10_fdr, label and category: sig_up, sig_down, almost_up, almost_down (one bound met) or ns."""
    strong, large = F.col("fdr") < fdr, F.abs("log2fc") >= log2fc
    side = F.when(F.col("log2fc") > 0, "up").otherwise("down")
    category = F.when(strong & large, F.concat(F.lit("sig_"), side)).when(strong, F.concat(F.lit("almost_"), side)).otherwise("ns")
    return result.withColumn("category", category).withColumn("neg_log10_fdr", -F.log10("fdr")).withColumn("label", keys.site_label(F.col("feature").cast("string")))


def activity_bars(activities: DataFrame, fdr: float = 0.05, top_n: int = 25) -> DataFrame:
    return activities.where(F.col("fdr") < fdr).orderBy(F.abs("score").desc(), "source").limit(top_n)


def enrichment_dots(result: DataFrame, top_n: int = 20) -> DataFrame:
    return result.where("fdr is not null").orderBy("fdr", "p_value", "set_name").limit(top_n)


def intensity_boxes(measure: DataFrame) -> DataFrame:
    """sample, q1, median, q3 and whiskers at 1.5 interquartile ranges, within the data."""
    q = F.percentile("intensity", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    own = measure.where("intensity is not null")
    boxes = own.groupBy("sample").agg(q.alias("q")).select("sample", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = own.join(boxes, "sample").where(F.col("intensity").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy("sample", "q1", "median", "q3").agg(F.min("intensity").alias("low"), F.max("intensity").alias("high"))


def site_abundance(measure: DataFrame, samples: DataFrame, feature: str, by: str = "condition") -> DataFrame:
    return measure.where(F.col("feature") == feature).join(samples.dropDuplicates(["sample"]).select("sample", by), "sample")


def heatmap(measure: DataFrame, max_features: int = 500) -> DataFrame:
    """feature, sample, z of the features of largest variance."""
    top = measure.groupBy("feature").agg(F.var_samp("intensity").alias("v")).where("v is not null").orderBy(F.col("v").desc(), "feature").limit(max_features)
    by = W.partitionBy("feature")
    own = measure.join(top.select("feature"), "feature", "left_semi")
    return own.select("feature", "sample", F.coalesce(F.try_divide(F.col("intensity") - F.avg("intensity").over(by), F.stddev_samp("intensity").over(by)), F.when(F.col("intensity").isNotNull(), 0.0)).alias("z"))


def centroids(scores: DataFrame, samples: DataFrame, by: str = "condition") -> DataFrame:
    return scores.join(samples.dropDuplicates(["sample"]).select("sample", by), "sample").groupBy(by, "pc").agg(F.avg("value").alias("value"))


def retention_curve(features: DataFrame, thresholds: list[float], column: str = "class1_wilson_lb") -> DataFrame:
    grid = F.broadcast(features.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    return grid.join(features, F.col(column) >= F.col("threshold"), "left").groupBy("threshold").agg(F.count(column).alias("n_sites")).orderBy("threshold")
