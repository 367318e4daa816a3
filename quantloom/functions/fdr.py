"""False discovery rates over p values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.order import least_from_here, placed


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; beyond 1000 by its series, which is exact to 15 digits there."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)
    return F.when(n <= 1000, few).otherwise(F.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n * n))


def adjust(frame: DataFrame, p: str = "p_value", out: str = "fdr", by: tuple[str, ...] = (), method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg or Benjamini-Yekutieli over the finite p values of each group; others get null.

    Ranks come from one distributed sort by group and p value; no task sees a whole group.
    """
    if method not in ("bh", "by"):
        raise ValueError(f"unknown FDR method {method!r}")
    finite = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    own = placed(frame.withColumn("_ok", finite), *by, F.col("_ok").desc(), F.col(p), place="_place")
    keys = ("_ok", *by)
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    groups = own.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    ties = own.groupBy(*keys, p).agg(F.max("_place").alias("_last"))
    met = own.alias("a").join(ties.alias("b"), same("a", "b", (*keys, p))).select("a.*", "_last")
    met = met.alias("a").join(groups.alias("b"), same("a", "b", keys)).select("a.*", "_first", "_n")
    factor = F.lit(1.0)
    if method == "by":
        met = met.alias("a").join(groups.select(*keys, _harmonic(F.col("_n")).alias("_factor")).alias("b"), same("a", "b", keys)).select("a.*", "_factor")
        factor = F.col("_factor")
    scaled = met.withColumn("_q", F.col(p) * F.col("_n") / (F.col("_last") - F.col("_first") + 1) * factor)
    least = least_from_here(scaled, "_q", "_least_q", keys, "_place")
    found = least.withColumn(out, F.when(F.col("_ok"), F.least(F.lit(1.0), "_least_q")))
    return found.select(*frame.columns, *([] if out in frame.columns else [out]))
