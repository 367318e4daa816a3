"""External matrices in, reports out."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.dataset import SiteDataset
from quantloom.functions import keys
from quantloom.operators import qc
from quantloom.operators.collapse import site_qc


def package_matrix(wide: DataFrame, key: str, loc: DataFrame | None = None, meta: DataFrame | None = None, samples: DataFrame | None = None) -> SiteDataset:
    """A features x samples table (log2, one numeric column per sample) as a dataset; keys are parsed, motifs come from `kinase_sequence`.

    loc: the same shape with localization probabilities; meta: key and further columns, whose names must be new.
    """
    names = [c for c in wide.columns if c != key]
    text = [f for f in wide.schema.fields if f.name != key and f.dataType.simpleString() not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if text:
        raise ValueError(f"not numeric: {', '.join(f.name for f in text)}")
    if len(set(names)) < len(names):
        raise ValueError("a sample occurs twice")
    if wide.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key occurs twice")

    def long(frame: DataFrame, value: str) -> DataFrame:
        own = frame.select(F.col(key).alias("feature"), *(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in names))
        return own.unpivot(["feature"], names, "sample", value)

    measure = long(wide, "intensity")
    measure = measure.join(long(loc, "loc_prob"), ["feature", "sample"], "left") if loc is not None else measure.withColumn("loc_prob", F.lit(None).cast("double"))
    parsed = keys.parse_key(F.col("feature"))
    features = wide.select(F.col(key).alias("feature")).withColumns({"protein_group_id": parsed["protein"], "gene": parsed["gene"], "residue": parsed["residue"], "site_position": parsed["position"], "multiplicity": parsed["multiplicity"]})
    if meta is not None:
        clash = (set(meta.columns) - {key}) & set(features.columns)
        if clash:
            raise ValueError(f"columns that exist already: {', '.join(sorted(clash))}")
        features = features.join(meta.withColumnRenamed(key, "feature"), "feature", "left")
        if "kinase_sequence" in meta.columns:
            features = features.withColumns(keys.motif(F.col("kinase_sequence")))
    features = features.join(site_qc(measure), "feature", "left")
    table = wide.sparkSession.createDataFrame([(n,) for n in names], "sample string")
    return SiteDataset(measure, features, table.join(samples.dropDuplicates(["sample"]), "sample", "left") if samples is not None else table, [("package_matrix", key)])


def dashboard(spark: SparkSession, data: SiteDataset, path: str, title: str = "Quality control", most_rows: int = 2000) -> None:
    """One HTML file of the QC tables. Each has a row per sample (or sample and class): small by nature, and bounded."""
    tables = {"Missing values": qc.missingness(data.measure), "Class I": qc.class1_per_sample(data.measure)}
    if {"residue", "multiplicity"} <= set(data.features.columns):
        tables |= {"Residues": qc.sty_ratio(data.measure, data.features), "Multiplicity": qc.multiplicity_distribution(data.measure, data.features)}
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, table in tables.items():
        parts.append(f"<h2>{html.escape(name)}</h2>" + table.orderBy("sample").limit(most_rows).toPandas().to_html(index=False))
    steps = "".join(f"<li>{html.escape(step)}: {html.escape(note)}</li>" for step, note in data.provenance)
    spark.createDataFrame([("".join(parts) + f"<ul>{steps}</ul>",)], "value string").coalesce(1).write.mode("overwrite").text(path)
