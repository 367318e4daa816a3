"""Phospho beside proteome: pairing of samples and proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WELL = r"_([A-H])(1[0-2]|[1-9])(?:_[^_]+)?$"


def well_of(sample: Column) -> Column:
    return F.when(sample.rlike(WELL), F.concat(F.regexp_extract(sample, WELL, 1), F.regexp_extract(sample, WELL, 2)))


def pair_samples(phospho: DataFrame, proteome: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """sample, protein_sample: by an explicit map, or by the well at the end of names (which must be unique)."""
    if mapping is not None:
        pairs = phospho.sparkSession.createDataFrame(list(mapping.items()), "sample string, protein_sample string")
        return pairs.join(phospho.select("sample").distinct(), "sample", "left_semi").join(proteome.select(F.col("sample").alias("protein_sample")).distinct(), "protein_sample", "left_semi")
    a = phospho.select("sample").distinct().withColumn("_w", well_of(F.col("sample"))).where("_w is not null")
    b = proteome.select(F.col("sample").alias("protein_sample")).distinct().withColumn("_w", well_of(F.col("protein_sample"))).where("_w is not null")
    for side in (a, b):
        if side.groupBy("_w").count().where("count > 1").limit(1).count():
            raise ValueError("a well occurs twice: give an explicit sample map")
    return a.join(b, "_w").drop("_w")


def pair_proteins(features: DataFrame, proteome: DataFrame, policy: str = "first", group: str = "protein_group_id") -> DataFrame:
    """feature, protein: the first accession of the group that the proteome has, or the one with fewest gaps."""
    if policy not in ("first", "best_q"):
        raise ValueError(f"unknown policy {policy!r}")
    seen = proteome.groupBy("feature").agg(F.count("intensity").alias("_n")).select(F.explode(F.split("feature", ";")).alias("_a"), F.col("feature").alias("protein"), "_n")
    own = features.select("feature", F.posexplode(F.split(group, ";")).alias("_i", "_a")).join(seen, "_a")
    rank = F.struct("_i", "protein") if policy == "first" else F.struct(-F.col("_n"), "_i", "protein")
    return own.groupBy("feature").agg(F.min_by("protein", rank).alias("protein"))


def phospho_over_proteome(phospho: DataFrame, features: DataFrame, proteome: DataFrame, mapping: dict[str, str] | None = None, missing: str = "drop", policy: str = "first") -> DataFrame:
    """feature, sample, intensity (log2 difference), was_normalized. missing: drop, carry or fail where a protein value lacks."""
    if missing not in ("drop", "carry", "fail"):
        raise ValueError(f"unknown policy {missing!r}")
    samples, proteins = pair_samples(phospho, proteome, mapping), pair_proteins(features, proteome, policy)
    values = proteome.select(F.col("feature").alias("protein"), F.col("sample").alias("protein_sample"), F.col("intensity").alias("_p"))
    own = phospho.join(F.broadcast(samples), "sample").join(proteins, "feature", "left").join(values, ["protein", "protein_sample"], "left")
    has = F.col("_p").isNotNull()
    if missing == "drop":
        value = F.when(has, F.col("intensity") - F.col("_p"))
        own = own.where(F.col("protein").isNotNull())
    elif missing == "carry":
        value = F.coalesce(F.col("intensity") - F.col("_p"), F.col("intensity"))
    else:
        value = F.when(has | F.col("intensity").isNull(), F.col("intensity") - F.col("_p")).otherwise(F.raise_error(F.concat(F.lit("no protein value for "), F.col("feature").cast("string"))))
    return own.select("feature", "sample", value.alias("intensity"), (has & F.col("intensity").isNotNull()).alias("was_normalized"), F.col("intensity").alias("intensity_phospho"))
