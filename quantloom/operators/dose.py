"""Dose response: four-parameter logistic curves per feature; and the pipeline advisor."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.fdr import adjust
from quantloom.functions.special import f_sf


def fit_curve(dose: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """(pEC50, slope, front, back, R2, p): least squares over a grid of pEC50 and slopes; levels are solved exactly."""
    ok = ~np.isnan(y) & (dose > 0)
    x, y = np.log10(dose[ok]), y[ok]
    if len(y) < 5 or len(np.unique(x)) < 4:
        return (math.nan,) * 6
    rest = ((y - y.mean()) ** 2).sum()
    best = (math.inf,)

    def tried(centres, slopes):
        nonlocal best
        for c in centres:
            for s in slopes:
                h = 1 / (1 + 10 ** (s * (x - c)))
                a = np.column_stack([h, 1 - h])
                level, *_ = np.linalg.lstsq(a, y, rcond=None)
                rss = ((y - a @ level) ** 2).sum()
                if rss < best[0] - 1e-15:
                    best = (rss, c, s, *level)

    tried(np.linspace(x.min() - 1, x.max() + 1, 40), (0.5, 1.0, 2.0, 4.0))
    span = (x.max() - x.min() + 2) / 40
    for _ in range(6):
        _, c, s, *_ = best
        tried(np.linspace(c - span, c + span, 9), s * np.array([0.7, 0.85, 1.0, 1.2, 1.4]))
        span /= 3
    rss, c, s, front, back = best
    df = len(y) - 4
    f = ((rest - rss) / 3) / (rss / df) if df > 0 and rss > 0 else math.inf
    return -c, s, front, back, 1 - rss / rest if rest > 0 else math.nan, float(f_sf(f, 3, df)) if df > 0 and math.isfinite(f) else 0.0


def fit_dose_response(measure: DataFrame, samples: DataFrame, dose: str = "dose", timepoint: str | None = "timepoint", unit_exponent: float = -9.0) -> DataFrame:
    """feature, timepoint, pec50, ec50, slope, front, back, r2, p_value, fdr from ratios to the mean of dose 0.

    unit_exponent: power of ten of the dose's unit in mol/l (-9: nM); ec50 is in that unit. One group per feature and
    timepoint: as many rows as samples.
    """
    keys = ["sample", dose, *([timepoint] if timepoint else [])]
    own = measure.where("intensity is not null").join(F.broadcast(samples.select(*keys).dropDuplicates(["sample"])), "sample")
    own = own.select("feature", (F.col(timepoint).cast("double") if timepoint else F.lit(0.0)).alias("timepoint"), F.col(dose).cast("double").alias("dose"), F.pow(F.lit(2.0), F.col("intensity")).alias("x"))
    if not own.where("dose = 0").limit(1).count():
        raise ValueError("a sample of dose 0 is needed as control")
    kind = measure.schema["feature"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = pdf.loc[pdf["dose"] == 0, "x"].mean()
        fitted = fit_curve(pdf["dose"].to_numpy(float), (pdf["x"] / base).to_numpy(float))
        return pd.DataFrame([[pdf["feature"].iloc[0], pdf["timepoint"].iloc[0], fitted[0] - unit_exponent, 10 ** -fitted[0], *fitted[1:]]], columns=["feature", "timepoint", "pec50", "ec50", "slope", "front", "back", "r2", "p_value"])

    out = own.groupBy("feature", "timepoint").applyInPandas(run, f"feature {kind}, timepoint double, pec50 double, ec50 double, slope double, front double, back double, r2 double, p_value double")
    return adjust(out, by=("timepoint",))


@dataclass(frozen=True)
class Recommendation:
    filter: str
    min_valid_n: int
    imputer: str | None
    test: str
    reasons: tuple[str, ...]


def recommend_pipeline(n_samples: int, group_sizes: list[int], missing_share: float, goal: str = "diff_exp") -> Recommendation:
    """Filter, imputer and test from the size of a cohort and its gaps; nothing is run."""
    if goal not in ("diff_exp", "viz_only", "clustering"):
        raise ValueError(f"unknown goal {goal!r}")
    smallest = min(group_sizes)
    n = max(3, min(10, round(0.6 * smallest)))
    reasons = [f"at least {n} values in a group of {smallest}"]
    how = "wilson" if n_samples >= 100 else "completeness"
    reasons.append("Wilson bounds are stable from 100 samples on" if how == "wilson" else "fewer than 100 samples: completeness")
    imputer = None
    if goal == "viz_only" or missing_share >= 0.60:
        imputer = "autoencoder" if n_samples >= 300 else "knn" if n_samples >= 50 and missing_share <= 0.40 else "hybrid"
        reasons.append(f"gaps are filled by {imputer}")
    test = "none" if goal == "viz_only" else "limma" if len(group_sizes) == 2 else "anova" if len(group_sizes) > 2 else "none"
    return Recommendation(how, n, imputer, test, tuple(reasons))
