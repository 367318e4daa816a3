"""Localization masks, completeness and Class-I filters on measure(feature, sample, intensity, loc_prob)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import special

# Cohort sizes below which a threshold range holds, and the ranges.
AUTO_RANGES = ((100, 0.20, 0.40), (300, 0.30, 0.55), (1 << 62, 0.45, 0.65))
AUTO_MIN_N, AUTO_POINTS, AUTO_STRENGTH = 30, 31, 0.02


def class1(cutoff: float = 0.75, loc: str = "loc_prob") -> Column:
    """Null localization is not Class I."""
    return F.coalesce(F.col(loc) >= cutoff, F.lit(False))


def drop_missing_features(measure: DataFrame) -> DataFrame:
    """Features without any value go."""
    return measure.withColumn("_n", F.count("intensity").over(W.partitionBy("feature"))).where("_n > 0").drop("_n")


def mask_per_run(measure: DataFrame, cutoff: float = 0.75) -> DataFrame:
    return measure.withColumn("intensity", F.when(class1(cutoff), F.col("intensity")))


def filter_by_global_max(measure: DataFrame, cutoff: float = 0.75) -> DataFrame:
    return measure.withColumn("_best", F.max("loc_prob").over(W.partitionBy("feature"))).where(F.col("_best") >= cutoff).drop("_best")


def condition_sizes(measure: DataFrame, samples: DataFrame) -> DataFrame:
    """condition, n_samples: of the samples that measure has."""
    present = measure.select("sample").distinct()
    first = samples.groupBy("sample").agg(F.min("condition").alias("condition"))
    return present.join(first, "sample", "left").where("condition is not null").groupBy("condition").agg(F.count("*").alias("n_samples"))


def mask_condition_aware(measure: DataFrame, samples: DataFrame, class1_cutoff: float = 0.75, condition_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The masked measure and the decision table.

    A feature's cells of a condition all stay if the share of Class-I cells among all samples of the condition reaches
    the threshold; else only Class-I cells stay. Samples without a condition follow the per-cell rule.
    """
    labels = samples.groupBy("sample").agg(F.min("condition").alias("condition"))
    sizes = condition_sizes(measure, samples)
    by = W.partitionBy("feature", "condition")
    own = measure.drop("condition").join(labels, "sample", "left").join(sizes, "condition", "left")
    own = own.withColumn("n_class1", F.sum(class1(class1_cutoff).cast("int")).over(by)).withColumn("fraction", F.col("n_class1") / F.col("n_samples"))
    passed = F.coalesce(F.col("fraction") >= condition_threshold, F.lit(False))
    masked = own.withColumn("intensity", F.when(passed | class1(class1_cutoff), F.col("intensity")))
    decisions = own.where("condition is not null").groupBy("feature", "condition").agg(F.max("n_class1").alias("n_class1"), F.max("n_samples").alias("n_samples"))
    decisions = decisions.withColumn("fraction", F.col("n_class1") / F.col("n_samples")).withColumn("passed", F.col("fraction") >= condition_threshold)
    return masked.drop("n_samples", "n_class1", "fraction"), decisions


def wilson_lower_bound(k, n, alpha: float = 0.05) -> np.ndarray:
    """The Jeffreys bound: the alpha / 2 quantile of Beta(k + 1/2, n - k + 1/2); 0 where n is 0."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    if np.any(k < 0) or np.any(k > n):
        raise ValueError("k must be between 0 and n")
    return np.clip(np.where(n == 0, 0.0, special.beta_ppf(alpha / 2, k + 0.5, n - k + 0.5)), 0, 1)


def with_wilson_bound(features: DataFrame, k: str = "n_class1_samples", n: str = "n_samples_detected", out: str = "class1_wilson_lb", alpha: float = 0.05) -> DataFrame:
    """Adds the bound; only distinct (k, n) pairs, at most samples squared, are computed."""
    spark = features.sparkSession
    pairs = [(r[0], r[1]) for r in features.select(k, n).where(F.col(k).isNotNull() & F.col(n).isNotNull()).distinct().collect()]
    bounds = wilson_lower_bound([p[0] for p in pairs], [p[1] for p in pairs], alpha) if pairs else []
    table = spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in zip(pairs, bounds, strict=True)], "_k long, _n long, _v double")
    return features.join(F.broadcast(table), (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n")), "left").withColumn(out, F.coalesce("_v", F.lit(0.0))).drop("_k", "_n", "_v")


def auto_wilson_threshold(features: DataFrame, n_samples: int, bound: str = "class1_wilson_lb") -> tuple[float, str]:
    """The elbow of the retention curve over 31 thresholds of the cohort's range."""
    if n_samples < AUTO_MIN_N:
        raise ValueError(f"an automatic threshold needs at least {AUTO_MIN_N} samples, got {n_samples}")
    lo, hi = next((a, b) for most, a, b in AUTO_RANGES if n_samples < most)
    grid = np.linspace(lo, hi, AUTO_POINTS)
    counts = features.agg(F.count("*").alias("all"), *(F.count_if(F.col(bound) >= float(t)).alias(f"t{i}") for i, t in enumerate(grid))).first()
    if not counts["all"]:
        raise ValueError("there are no features")
    kept = np.array([counts[f"t{i}"] for i in range(AUTO_POINTS)], float)
    middle = float((lo + hi) / 2)
    if kept.max() == kept.min():
        return middle, f"flat retention between {lo:.2f} and {hi:.2f}: midpoint {middle:.2f}"
    below = 1 - (grid - lo) / (hi - lo) - (kept - kept.min()) / (kept.max() - kept.min())
    if below.max() < AUTO_STRENGTH:
        return middle, f"no clear elbow ({below.max():.3f}): midpoint {middle:.2f}"
    best = float(grid[int(np.argmax(below))])
    return best, f"elbow at {best:.2f} (strength {below.max():.3f})"


def apply_wilson_filter(features: DataFrame, n_samples: int, threshold: float | str = "auto", bound: str = "class1_wilson_lb") -> DataFrame:
    if threshold == "auto":
        threshold = auto_wilson_threshold(features, n_samples, bound)[0]
    elif isinstance(threshold, bool | str) or not 0 <= threshold <= 1:
        raise ValueError("threshold must be 'auto' or a number from 0 to 1")
    return features.where(F.col(bound) >= float(threshold))


def filter_by_completeness(measure: DataFrame, samples: DataFrame, min_valid_frac: float | None = None, min_valid_n: int | None = None, group_column: str | None = None, keep_strategy: str = "all") -> DataFrame:
    """Features with enough values: over all samples, in any group, or in each group."""
    if (min_valid_frac is None) == (min_valid_n is None):
        raise ValueError("give exactly one of min_valid_frac and min_valid_n")
    if keep_strategy not in ("all", "any", "each"):
        raise ValueError(f"unknown keep_strategy {keep_strategy!r}")
    if keep_strategy != "all" and group_column is None:
        raise ValueError("a group column is needed for 'any' and 'each'")
    group = F.lit("all") if keep_strategy == "all" else F.col(group_column).cast("string")
    labels = samples.select("sample", group.alias("_group")).dropDuplicates(["sample"])
    sizes = labels.groupBy("_group").agg(F.count("*").alias("_size"))
    n_groups = sizes.count()  # a handful
    found = measure.join(labels, "sample").groupBy("feature", "_group").agg(F.count("intensity").alias("_valid")).join(F.broadcast(sizes), "_group")
    enough = F.col("_valid") >= min_valid_n if min_valid_n is not None else F.col("_valid") / F.col("_size") >= min_valid_frac
    needed = n_groups if keep_strategy == "each" else 1
    if (min_valid_n or min_valid_frac or 0) <= 0:
        return measure
    keep = found.where(enough).groupBy("feature").agg(F.count("*").alias("_n")).where(F.col("_n") >= needed).select("feature")
    return measure.join(keep, "feature", "left_semi")


def threshold_sensitivity(features: DataFrame, measure: DataFrame, thresholds: list[float] | None = None, reference: float = 0.5, bound: str = "class1_wilson_lb", n_samples: int | None = None) -> DataFrame:
    """Per threshold: features kept and their share, missing cells, median SD (population) and median detections."""
    spark = features.sparkSession
    grid = thresholds or [round(0.05 * i, 2) for i in range(2, 20)]
    n_samples = n_samples or measure.select("sample").distinct().count()
    stats = measure.groupBy("feature").agg(F.count("intensity").alias("n"), F.when(F.count("intensity") >= 2, F.stddev_pop("intensity")).alias("sd"))
    own = features.select("feature", F.col(bound).alias("lb")).join(stats, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    table = F.broadcast(spark.createDataFrame([(float(t),) for t in grid], "threshold double"))
    kept = own.join(table, F.col("lb") >= F.col("threshold"), "inner")
    out = table.join(kept.groupBy("threshold").agg(F.count("*").alias("n_kept"), F.sum("n").alias("cells"), F.median("sd").alias("median_sd"), F.median("n").alias("median_detections")), "threshold", "left")
    total = features.count()
    near = min(grid, key=lambda t: (abs(t - reference), t))
    out = out.withColumn("n_kept", F.coalesce("n_kept", F.lit(0))).withColumn("pct_kept", F.lit(100.0) * F.col("n_kept") / max(total, 1))
    out = out.withColumn("pct_missing", F.when(F.col("n_kept") > 0, 100 * (1 - F.col("cells") / (F.col("n_kept") * n_samples)))).drop("cells")
    at = F.max(F.when(F.col("threshold") == near, F.col("n_kept"))).over(W.partitionBy(F.lit(0)))
    return out.withColumn("delta_vs_reference", F.col("n_kept") - at)
