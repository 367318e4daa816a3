"""Quality control tables. Robust z: (x - median) / (1.4826 * MAD), 0 if the MAD is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.masks import class1
from quantloom.operators.matrix import sample_moments


def robust_z(frame: DataFrame, column: str, out: str) -> DataFrame:
    """frame is a table of samples."""
    every = W.partitionBy(F.lit(0))
    own = frame.withColumn("_m", F.median(column).over(every))
    own = own.withColumn("_d", F.median(F.abs(F.col(column) - F.col("_m"))).over(every))
    return own.withColumn(out, F.when(F.col("_d") > 0, (F.col(column) - F.col("_m")) / (1.4826 * F.col("_d"))).otherwise(F.when(F.col(column).isNotNull(), 0.0))).drop("_m", "_d")


def join_queue(table: DataFrame, queue: DataFrame | None) -> DataFrame:
    """Adds injection_order; samples the queue lacks keep null."""
    return table if queue is None else table.join(F.broadcast(queue.select("sample", "injection_order")), "sample", "left")


def psm_counts(psm: DataFrame, queue: DataFrame | None = None, flag_z: float = -3.0, sample: str = "sample", precursor: str = "precursor", protein: str = "protein") -> DataFrame:
    out = psm.groupBy(F.col(sample).alias("sample")).agg(F.count("*").alias("n_psms"), F.countDistinct(precursor).alias("n_unique_precursors"), F.countDistinct(protein).alias("n_unique_proteins"))
    return join_queue(robust_z(out, "n_unique_precursors", "z").withColumn("flagged", F.col("z") < flag_z), queue)


def run_tic(psm: DataFrame, queue: DataFrame | None = None, flag_z: float = 3.0, sample: str = "sample", precursor: str = "precursor", intensity: str = "intensity", order: str | None = None) -> DataFrame:
    """One intensity per precursor (the first by `order`), summed."""
    one = psm.where(F.col(intensity) > 0).groupBy(F.col(sample).alias("sample"), precursor).agg(F.min_by(intensity, order or intensity).alias("q"))
    out = one.groupBy("sample").agg(F.sum("q").alias("tic"), F.median("q").alias("median_intensity"), F.count("*").alias("n_precursors")).withColumn("log2_tic", F.log2("tic"))
    return join_queue(robust_z(out, "log2_tic", "z").withColumn("flagged", F.abs("z") > flag_z), queue)


def contaminant_share(psm: DataFrame, is_contaminant: Column, threshold: float = 0.10, sample: str = "sample", intensity: str = "intensity", inclusive: bool = False) -> DataFrame:
    """Contaminant share of intensity per sample; the protein table flags at the threshold too."""
    out = psm.where(F.col(intensity) > 0).groupBy(F.col(sample).alias("sample")).agg(F.sum(F.when(is_contaminant, F.col(intensity)).otherwise(0.0)).alias("contaminant_intensity"), F.sum(intensity).alias("total_intensity"))
    out = out.withColumn("fraction", F.try_divide("contaminant_intensity", "total_intensity"))
    return out.withColumn("flagged", F.col("fraction") >= threshold if inclusive else F.col("fraction") > threshold)


def retention_drift(psm: DataFrame, queue: DataFrame | None = None, min_samples: int = 3, flag_min: float = 1.0, sample: str = "sample", precursor: str = "precursor", rt: str = "rt") -> DataFrame:
    """Per sample: median, IQR and slope of the offsets of precursors' retention times to their cohort medians."""
    own = psm.where(F.col(rt).isNotNull()).groupBy(F.col(sample).alias("sample"), F.col(precursor).alias("precursor")).agg(F.median(rt).alias("rt"))
    by = W.partitionBy("precursor")
    own = own.withColumn("n", F.count("*").over(by)).withColumn("cohort", F.median("rt").over(by)).where(F.col("n") >= min_samples).withColumn("offset", F.col("rt") - F.col("cohort"))
    quartiles = F.percentile("offset", F.array(F.lit(0.25), F.lit(0.75)))
    out = own.groupBy("sample").agg(F.count("*").alias("n_precursors"), F.median("offset").alias("median_offset"), quartiles.alias("q"), F.regr_slope("offset", "cohort").alias("slope"))
    out = out.withColumn("iqr_offset", F.col("q")[1] - F.col("q")[0]).drop("q").withColumn("flagged", F.abs("median_offset") > flag_min)
    return join_queue(out, queue)


def drift_trend(drift: DataFrame) -> DataFrame:
    """One row: slope, Pearson and Spearman of offsets over injection order."""
    own = drift.where("injection_order is not null")
    rank = lambda c: F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2
    ranked = own.withColumn("_a", rank("injection_order")).withColumn("_b", rank("median_offset"))
    return ranked.agg(F.regr_slope("median_offset", "injection_order").alias("slope"), F.corr("median_offset", "injection_order").alias("pearson"), F.corr("_a", "_b").alias("spearman"))


def waterfall(counts: list[tuple[str, int]], spark) -> DataFrame:
    """stage, n_rows, lost, pct_of_first from the counts that readers and operators record."""
    rows = [(i, s, int(n)) for i, (s, n) in enumerate(counts)]
    out = spark.createDataFrame(rows, "step int, stage string, n_rows long")
    order = W.partitionBy(F.lit(0)).orderBy("step")
    return out.withColumn("lost", F.coalesce(F.lag("n_rows").over(order) - F.col("n_rows"), F.lit(0))).withColumn("pct_of_first", F.bround(100.0 * F.col("n_rows") / F.first("n_rows").over(order), 2))


def _shares(measure: DataFrame, features: DataFrame, what: Column, values: list[str], name: str) -> DataFrame:
    seen = measure.where("intensity is not null").join(features.select("feature", what.alias(name)), "feature")
    counts = seen.groupBy("sample", name).agg(F.count("*").alias("n"))
    cells = measure.select("sample").distinct().withColumn(name, F.explode(F.array(*map(F.lit, values))))
    out = cells.join(counts, ["sample", name], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy("sample"))), F.lit(0.0)))


def sty_ratio(measure: DataFrame, features: DataFrame) -> DataFrame:
    return _shares(measure, features, F.col("residue"), ["S", "T", "Y"], "residue")


def multiplicity_distribution(measure: DataFrame, features: DataFrame) -> DataFrame:
    return _shares(measure, features, F.when(F.col("multiplicity") >= 3, "3+").otherwise(F.col("multiplicity").cast("string")), ["1", "2", "3+"], "multiplicity")


def localization_distribution(measure: DataFrame) -> DataFrame:
    return measure.where("loc_prob is not null").select("sample", "loc_prob")


def localization_histogram(measure: DataFrame, bins: int = 99) -> DataFrame:
    """Densities over equal bins of [0, 1]; samples with fewer than two values go."""
    own = localization_distribution(measure).withColumn("bin", F.least(F.floor(F.col("loc_prob") * bins), F.lit(bins - 1)))
    own = own.withColumn("_n", F.count("*").over(W.partitionBy("sample"))).where("_n >= 2")
    return own.groupBy("sample", "bin").agg((F.count("*") * bins / F.max("_n")).alias("density"))


def missingness(measure: DataFrame, n_features: int | None = None) -> DataFrame:
    total = n_features if n_features is not None else measure.select("feature").distinct().count()
    out = measure.groupBy("sample").agg((F.lit(total) - F.count("intensity")).alias("n_missing"))
    return out.withColumn("n_total", F.lit(total)).withColumn("pct_missing", F.try_divide(100.0 * F.col("n_missing"), F.col("n_total")))


def class1_per_sample(measure: DataFrame, cutoff: float = 0.75) -> DataFrame:
    out = measure.where("intensity is not null").groupBy("sample").agg(F.count_if(class1(cutoff)).alias("n_class1"), F.count("*").alias("n"))
    return out.withColumn("fraction", F.bround(F.col("n_class1") / F.col("n"), 4))


def class1_comparison(measure: DataFrame, masked: DataFrame, cutoff: float = 0.75) -> DataFrame:
    own = measure.agg(F.count("intensity").alias("all_cells"), F.count_if(F.col("intensity").isNotNull() & class1(cutoff)).alias("per_run"))
    return own.withColumn("policy", F.lit(masked.agg(F.count("intensity")).first()[0]))


def cv_by_condition(measure: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """feature, condition, residue, cv on the linear scale, of two replicates at least."""
    own = measure.where("intensity is not null").join(F.broadcast(samples.dropDuplicates(["sample"]).select("sample", "condition")), "sample").withColumn("x", F.pow(F.lit(2.0), F.col("intensity")))
    out = own.groupBy("feature", "condition").agg(F.try_divide(F.stddev_samp("x"), F.avg("x")).alias("cv"), F.count("*").alias("n")).where("n >= 2 and cv is not null")
    return out.join(features.select("feature", "residue"), "feature").drop("n")


def cv_boxes(cv: DataFrame) -> DataFrame:
    q = F.percentile("cv", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    return cv.groupBy("condition", "residue").agg(q.alias("q")).select("condition", "residue", *(F.col("q")[i].alias(n) for i, n in enumerate(("p5", "q1", "median", "q3", "p95"))))


def replicate_correlation(measure: DataFrame, min_shared: int = 10) -> DataFrame:
    """sample_a < sample_b, n_shared, r: from sums of products, one row per pair of samples and partition."""
    met = sample_moments(measure)
    n, c = F.col("n"), F.col
    spread = (n * c("aa") - c("a") * c("a")) * (n * c("bb") - c("b") * c("b"))
    r = F.when(spread > 0, (n * c("ab") - c("a") * c("b")) / F.sqrt(spread))
    return met.where(n >= min_shared).select("sample_a", "sample_b", n.alias("n_shared"), r.alias("r"))


def contaminant_breakdown(psm: DataFrame, is_contaminant: Column, gene: str = "gene", top: int = 15) -> DataFrame:
    return psm.where(is_contaminant).groupBy(gene).agg(F.count("*").alias("n_rows")).orderBy(F.col("n_rows").desc(), gene).limit(top)


def imputation_summary(imputed: DataFrame) -> DataFrame:
    return imputed.groupBy("sample", "strategy").agg(F.count("*").alias("n"))
