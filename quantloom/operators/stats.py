"""Per-feature linear models with empirical Bayes variances, and on/off detection.

A design has one row per sample and is small; it and the matrices made from it are literals of the plan.
All features are fitted in one grouped pass: coefficients are sums of fixed multiples of the samples' values.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import special
from quantloom.functions.fdr import adjust
from quantloom.storage import kept


def covariate_is_continuous(values: list, name: str) -> bool:
    """Floats are continuous; integers and booleans are ambiguous and refused."""
    if any(isinstance(v, bool) or isinstance(v, int) for v in values):
        raise ValueError(f"covariate {name!r} is of whole numbers: make it float (continuous) or text (levels)")
    return all(isinstance(v, float) for v in values)


def sanitize_levels(labels: list[str]) -> dict[str, str]:
    """Label -> identifier, one to one; repeated identifiers get _2, _3, ..."""
    out, used = {}, set()
    for label in labels:
        name = re.sub(r"\W", "_", str(label))
        name = name if name and not name[0].isdigit() else f"x{name}"
        n, own = 1, name
        while own in used:
            n += 1
            own = f"{name}_{n}"
        used.add(own)
        out[label] = own
    return out


@dataclass
class DesignMatrix:
    samples: list[str]
    columns: list[str]
    matrix: np.ndarray
    levels: dict[str, str] = field(default_factory=dict)


def design_matrix(samples: DataFrame, condition: str = "condition", reference: str | None = None, covariates: list[str] | None = None, block: str | None = None) -> DesignMatrix:
    """One column per condition (the reference first) without intercept, then covariates, then blocks."""
    names = [condition, *(covariates or []), *([block] if block else [])]
    rows = samples.select("sample", *names).dropDuplicates(["sample"]).orderBy("sample").toPandas()
    if rows[names].isna().any().any():
        raise ValueError("a sample lacks a condition, covariate or block")
    levels = sorted(rows[condition].astype(str).unique())
    if reference is not None:
        if reference not in levels:
            raise ValueError(f"{reference!r} is no level of {condition}")
        levels = [reference, *(v for v in levels if v != reference)]
    if len(levels) < 2:
        raise ValueError("a design needs two levels")
    named = sanitize_levels(levels)
    columns = {named[v]: (rows[condition].astype(str) == v).to_numpy(float) for v in levels}
    for name in covariates or []:
        values = rows[name].tolist()
        if covariate_is_continuous(values, name):
            columns[name] = np.asarray(values, float)
        else:
            for v in sorted({str(x) for x in values})[1:]:
                columns[f"{name}_{v}"] = np.array([str(x) == v for x in values], float)
    if block:
        for v in sorted(rows[block].astype(str).unique())[1:]:
            columns[f"{block}_{v}"] = (rows[block].astype(str) == v).to_numpy(float)
    matrix = np.column_stack(list(columns.values()))
    if np.linalg.matrix_rank(matrix) < matrix.shape[1]:
        raise ValueError("the design is not of full rank: a covariate or block repeats the conditions")
    return DesignMatrix(rows["sample"].tolist(), list(columns), matrix, named)


@dataclass
class LinearModelFit:
    """table: feature, coefficients (array), sigma2, mean; cov: unscaled covariance of the coefficients."""

    table: DataFrame
    design: DesignMatrix
    cov: np.ndarray
    df: int


def _literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def lm_fit(measure: DataFrame, design: DesignMatrix, value: str = "intensity") -> LinearModelFit:
    """Ordinary least squares of every feature. A feature without a value in every sample fails."""
    q, r = np.linalg.qr(design.matrix)
    inverse = np.linalg.inv(r)
    solve, n, p = inverse @ q.T, *design.matrix.shape
    if n <= p:
        raise ValueError("there are no residual degrees of freedom")
    spark = measure.sparkSession
    rows = [(s, solve[:, i].tolist(), q[i].tolist()) for i, s in enumerate(design.samples)]
    weights = F.broadcast(spark.createDataFrame(rows, "sample string, _m array<double>, _q array<double>"))  # a row per sample
    y = F.col(value)
    own = measure.withColumn("sample", F.col("sample").cast("string")).join(weights, "sample")
    sums = lambda c, k: [F.sum(F.get(F.col(c), F.lit(i)) * y) for i in range(k)]
    fitted = own.groupBy("feature").agg(
        F.array(*sums("_m", p)).alias("coefficients"),
        F.array(*sums("_q", p)).alias("_qy"),
        F.sum(y * y).alias("_yy"),
        F.avg(y).alias("mean"),
        F.count(F.nanvl(y, F.lit(None))).alias("_n"),
    )
    whole = F.when(F.col("_n") == n, F.col("coefficients")).otherwise(F.raise_error(F.concat(F.lit("missing values in feature "), F.col("feature").cast("string"))))
    rss = F.greatest(F.lit(0.0), F.col("_yy") - F.aggregate("_qy", F.lit(0.0), lambda a, x: a + x * x))
    table = fitted.select("feature", whole.alias("coefficients"), (rss / (n - p)).alias("sigma2"), "mean")
    return LinearModelFit(kept(table), design, inverse @ inverse.T, n - p)  # prior and tests read it several times


@dataclass(frozen=True)
class EmpiricalBayesPrior:
    """Prior variance and degrees of freedom; with a trend, log prior variance over the mean as spline weights."""

    df: float
    variance: float
    knots: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def variance_at(self, mean: Column) -> Column:
        if not self.weights:
            return F.lit(self.variance)
        total = F.lit(self.weights[0])
        for w, term in zip(self.weights[1:], spline_terms(mean, self.knots), strict=True):
            total = total + w * term
        return F.exp(total)


def spline_terms(x: Column, knots: tuple[float, ...]) -> list[Column]:
    """Terms of a natural cubic spline (linear beyond the outer knots), without the constant."""
    if len(knots) < 3:
        return [x] if knots else []
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0))
    last, before = knots[-1], knots[-2]
    end = (cube(before) - cube(last)) / (last - before)
    return [x, *((cube(k) - cube(last)) / (last - k) - end for k in knots[:-2])]


def fit_prior(fit: LinearModelFit, trend: bool = False) -> EmpiricalBayesPrior:
    """Moments of the log variances; two or three aggregate passes, whatever the number of features."""
    table, half = fit.table, fit.df / 2
    middle = table.where("sigma2 > 0").agg(F.median("sigma2")).first()[0]
    if middle is None:
        raise ValueError("all variances are zero")
    floor = 1e-5 * middle
    shift = float(special.digamma(half)) - math.log(half)
    own = table.select(F.col("mean").alias("x"), (F.log(F.greatest("sigma2", F.lit(floor))) - shift).alias("e"))
    n = own.count()
    if n < 2:
        return EmpiricalBayesPrior(0.0, float(middle))
    knots: tuple[float, ...] = ()
    if trend:
        terms = 1 + (n >= 3) + (n >= 6) + (n >= 30)
        shares = [float(v) for v in np.linspace(0, 1, terms)]
        knots = tuple(sorted(set(own.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]))) if terms > 1 else ()
        own = own.withColumn("t", F.array(F.lit(1.0), *spline_terms(F.col("x"), knots)))
        size = 1 + (len(knots) - 1 if len(knots) >= 3 else int(bool(knots)))
        at = lambda i: F.get(F.col("t"), F.lit(i))
        row = own.agg(*(F.sum(at(i) * at(j)).alias(f"a{i}_{j}") for i in range(size) for j in range(size)), *(F.sum(at(i) * F.col("e")).alias(f"b{i}") for i in range(size))).first()
        a, b = np.array([[row[f"a{i}_{j}"] for j in range(size)] for i in range(size)]), np.array([row[f"b{i}"] for i in range(size)])
        weights = np.linalg.lstsq(a, b, rcond=None)[0]
        guess = F.aggregate(F.zip_with("t", _literal(weights), lambda u, w: u * w), F.lit(0.0), lambda s, v: s + v)
        spread = own.agg(F.sum(F.pow(F.col("e") - guess, F.lit(2.0)))).first()[0] / max(n - size, 1)
    else:
        weights, row = None, own.agg(F.avg("e").alias("m"), F.var_samp("e").alias("v")).first()
        spread = row["v"]
    excess = spread - float(special.trigamma(half))
    if excess > 0:
        df = 2 * special.inverse_trigamma(excess)
        lift = float(special.digamma(df / 2)) - math.log(df / 2)
        level = math.exp(row["m"] + lift) if weights is None else 0.0
    else:
        df, lift = math.inf, 0.0
        level = table.agg(F.avg(F.greatest("sigma2", F.lit(floor)))).first()[0] if weights is None else 0.0
    if weights is None:
        return EmpiricalBayesPrior(df, float(level))
    weights[0] += lift
    return EmpiricalBayesPrior(df, math.nan, knots, tuple(float(w) for w in weights))


def moderate_variance(sigma2: Column, df: int, prior: EmpiricalBayesPrior, mean: Column) -> Column:
    s0 = prior.variance_at(mean)
    return s0 if math.isinf(prior.df) else (prior.df * s0 + df * sigma2) / (prior.df + df)


def _p_values(frame: DataFrame, stat: str, out: str, function) -> DataFrame:
    @F.pandas_udf("double")
    def p(values: pd.Series) -> pd.Series:
        return pd.Series(function(values.to_numpy(float)))

    return frame.withColumn(out, F.when(F.col(stat).isNotNull(), p(F.col(stat))))


def contrast_vectors(design: DesignMatrix, contrasts: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """`treated - control` from (treated, control) levels."""
    out = {}
    for a, b in contrasts:
        for level in (a, b):
            if level not in design.levels:
                raise ValueError(f"{level!r} is no level of the design")
        v = np.zeros(len(design.columns))
        v[design.columns.index(design.levels[a])] += 1
        v[design.columns.index(design.levels[b])] -= 1
        out[f"{a} - {b}"] = v
    return out


def moderated_t_test(fit: LinearModelFit, contrasts: dict[str, np.ndarray], prior: EmpiricalBayesPrior, proportion: float = 0.01) -> DataFrame:
    """contrast, feature, log2fc, se, t_stat, p_value, fdr, B, ave_expr, sigma2, df_moderated."""
    df = prior.df + fit.df
    rows = F.array(*(F.struct(F.lit(name).alias("contrast"), _literal(v).alias("c"), F.lit(float(v @ fit.cov @ v)).alias("v")) for name, v in contrasts.items()))
    own = fit.table.withColumn("_c", F.explode(rows)).withColumn("post", moderate_variance(F.col("sigma2"), fit.df, prior, F.col("mean")))
    estimate = F.aggregate(F.zip_with("coefficients", F.col("_c.c"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = own.select("feature", F.col("_c.contrast").alias("contrast"), estimate.alias("log2fc"), F.sqrt(F.col("post") * F.col("_c.v")).alias("se"), F.col("_c.v").alias("v"), F.col("mean").alias("ave_expr"), "sigma2", F.lit(df).alias("df_moderated"))
    own = own.withColumn("t_stat", F.try_divide("log2fc", "se"))
    own = _p_values(own, "t_stat", "p_value", lambda t: special.t_sf2(t, df))
    # log odds of a changed feature, after Smyth 2004, with the prior spread of changes at its usual start (variance 4 / s0)
    ratio = lambda v: 1 + 4.0 / v
    r, t2 = ratio(F.col("v")), F.col("t_stat") * F.col("t_stat")
    kernel = t2 * (1 - 1 / r) / 2 if math.isinf(df) else (1 + df) / 2 * F.log((t2 + df) / (t2 / r + df))
    own = own.withColumn("B", math.log(proportion / (1 - proportion)) - F.log(r) / 2 + kernel)
    return adjust(own, by=("contrast",)).drop("v")


def moderated_f_test(fit: LinearModelFit, contrasts: dict[str, np.ndarray], prior: EmpiricalBayesPrior) -> DataFrame:
    """feature, f_stat, p_value, fdr, ave_expr: all contrasts at once."""
    c = np.column_stack(list(contrasts.values()))
    inner = c.T @ fit.cov @ c
    rank, weight = int(np.linalg.matrix_rank(inner)), np.linalg.pinv(inner)
    quadratic = c @ weight @ c.T
    b = lambda i: F.get(F.col("coefficients"), F.lit(i))
    total = F.lit(0.0)
    for i in range(len(quadratic)):
        for j in range(len(quadratic)):
            if abs(quadratic[i, j]) > 1e-15:
                total = total + float(quadratic[i, j]) * b(i) * b(j)
    own = fit.table.withColumn("f_stat", F.try_divide(total, rank * moderate_variance(F.col("sigma2"), fit.df, prior, F.col("mean"))))
    df = prior.df + fit.df
    return adjust(_p_values(own.select("feature", "f_stat", F.col("mean").alias("ave_expr")), "f_stat", "p_value", lambda f: special.f_sf(f, rank, df)))


def _guard(measure: DataFrame, value: str = "intensity") -> None:
    row = measure.agg(F.median(value).alias("m"), F.count_if(F.col(value).isNull() | F.isnan(value)).alias("n")).first()
    if row["n"]:
        raise ValueError("missing values: impute or filter first")
    if row["m"] is not None and row["m"] > 30:
        raise ValueError("values look linear (median above 30): give log2")


def diff_exp_contrasts(measure: DataFrame, samples: DataFrame, contrasts: list[tuple[str, str]], condition: str = "condition", covariates: list[str] | None = None, block: str | None = None, trend: bool = True, joint: bool = True) -> DataFrame:
    """joint: one fit over all samples; otherwise one fit for each pair of levels, over their samples only."""
    if not joint:
        parts = [diff_exp_contrasts(*_subset(measure, samples, condition, pair), [pair], condition, covariates, block, trend) for pair in contrasts]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    _guard(measure)
    design = design_matrix(samples, condition, None, covariates, block)
    fit = lm_fit(measure, design)
    return moderated_t_test(fit, contrast_vectors(design, contrasts), fit_prior(fit, trend))


def _subset(measure: DataFrame, samples: DataFrame, condition: str, levels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    own = samples.where(F.col(condition).isin(*levels))
    return measure.join(F.broadcast(own.select("sample")), "sample", "left_semi"), own


def diff_exp_limma(measure: DataFrame, samples: DataFrame, comparison: tuple[str, str], condition: str = "condition", covariates: list[str] | None = None, trend: bool = True) -> DataFrame:
    """Two groups, over their samples only."""
    own = _subset(measure, samples, condition, comparison)
    return diff_exp_contrasts(*own, [comparison], condition, covariates, None, trend)


def diff_exp_anova(measure: DataFrame, samples: DataFrame, condition: str = "condition", covariates: list[str] | None = None, trend: bool = True) -> DataFrame:
    _guard(measure)
    design = design_matrix(samples, condition, None, covariates)
    fit = lm_fit(measure, design)
    first, *rest = design.levels
    return moderated_f_test(fit, contrast_vectors(design, [(level, first) for level in rest]), fit_prior(fit, trend))


def anova_hits(result: DataFrame, fdr_threshold: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(hits, background) features."""
    background = result.where("fdr is not null")
    return background.where(F.col("fdr") < fdr_threshold).select("feature"), background.select("feature")


def on_off(measure: DataFrame, samples: DataFrame, comparison: tuple[str, str], condition: str = "condition", min_observed: int = 3) -> DataFrame:
    """feature, n_treatment, n_control, status: both, on_in_treatment, on_in_control or absent."""
    treated, control = comparison
    labels = F.broadcast(samples.dropDuplicates(["sample"]).select("sample", F.col(condition).alias("_c")))
    seen = F.col("intensity").isNotNull()
    own = measure.join(labels, "sample", "left").groupBy("feature").agg(F.count_if(seen & (F.col("_c") == treated)).alias("n_treatment"), F.count_if(seen & (F.col("_c") == control)).alias("n_control"))
    t, c = F.col("n_treatment") >= min_observed, F.col("n_control") >= min_observed
    return own.withColumn("status", F.when(t & c, "both").when(t & (F.col("n_control") == 0), "on_in_treatment").when(c & (F.col("n_treatment") == 0), "on_in_control").otherwise("absent"))


def annotate_imputed(result: DataFrame, before: DataFrame, samples: DataFrame, comparison: tuple[str, str], condition: str = "condition", min_observed: int = 3) -> DataFrame:
    """Adds observed and missing counts before imputation and `imputed_driven`."""
    counts = on_off(before, samples, comparison, condition, min_observed).drop("status")
    sizes = {r[0]: r[1] for r in samples.dropDuplicates(["sample"]).groupBy(condition).count().collect()}
    out = result.join(counts, "feature", "left").na.fill(0, ["n_treatment", "n_control"])
    out = out.withColumn("n_missing_treatment", F.lit(sizes.get(comparison[0], 0)) - F.col("n_treatment")).withColumn("n_missing_control", F.lit(sizes.get(comparison[1], 0)) - F.col("n_control"))
    return out.withColumn("imputed_driven", (F.col("n_treatment") < min_observed) | (F.col("n_control") < min_observed))


def diff_exp_observed_only(measure: DataFrame, samples: DataFrame, comparison: tuple[str, str], condition: str = "condition", min_observed: int = 3, impute=None) -> tuple[DataFrame, DataFrame]:
    """(tests of features seen in both groups, on/off table). impute: measure -> measure without gaps, or None."""
    status = on_off(measure, samples, comparison, condition, min_observed)
    both = measure.join(status.where("status = 'both'"), "feature", "left_semi")
    own, labels = _subset(both, samples, condition, comparison)
    filled = impute(own) if impute else own
    return annotate_imputed(diff_exp_limma(filled, labels, comparison, condition), own, labels, comparison, condition, min_observed), status
