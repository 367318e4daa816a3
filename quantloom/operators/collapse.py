"""From precursor reports to site, precursor and protein tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.dataset import SiteDataset
from quantloom.functions import keys
from quantloom.functions import peptides as P
from quantloom.operators import masks
from quantloom.schema import (
    ASSAY_PROB, CHANNEL_JOIN, GENES, LOC_PROBS, PHOSPHO, POSITION, PRECURSOR, PROTEINS, RESIDUES, SAMPLE, CollapseSettings, PrecursorSettings, resolve_quant_column,
)
from quantloom.storage import kept


def fold_channels(psm: DataFrame, channel: str = "Channel") -> DataFrame:
    """A sample is a run and a channel, where the report has channels."""
    if channel not in psm.columns:
        return psm
    return psm.withColumn("_run", F.col(SAMPLE)).withColumn(SAMPLE, F.when(F.col(channel).isNull(), F.col(SAMPLE)).otherwise(F.concat(SAMPLE, F.lit(CHANNEL_JOIN), channel)))


def selectivity(psm: DataFrame) -> DataFrame:
    """Per sample: distinct precursors, those with phospho, and their percentage (half-even, 2 digits)."""
    own = psm.select(F.col(f"`{SAMPLE}`").alias("sample"), F.col(f"`{PRECURSOR}`").alias("p")).where("p is not null").distinct()
    out = own.groupBy("sample").agg(F.count("*").alias("n_precursors"), F.count_if(F.col("p").contains("[Phospho (STY)]")).alias("n_phospho"))
    return out.withColumn("phospho_selectivity_pct", F.bround(100.0 * F.col("n_phospho") / F.col("n_precursors"), 2))


def duplicated_files(psm: DataFrame, n: int = 200) -> DataFrame:
    """Groups of samples whose first precursors and quantities are the same: a file that was read twice."""
    own = psm.select(F.col(f"`{SAMPLE}`").alias("sample"), F.concat_ws("|", F.col(f"`{PRECURSOR}`"), F.col("_quant").cast("string")).alias("cell"))
    ranked = own.withColumn("_n", F.row_number().over(W.partitionBy("sample").orderBy("cell"))).where(F.col("_n") <= n)
    digest = ranked.groupBy("sample").agg(F.md5(F.array_join(F.array_sort(F.collect_list("cell")), "\n")).alias("digest"))
    return digest.groupBy("digest").agg(F.array_sort(F.collect_list("sample")).alias("samples")).where("size(samples) > 1")


def prepare(psm: DataFrame, quant: str) -> DataFrame:
    """Canonical columns of phospho rows: sample, precursor, sequence, positions, localization cells, and what keys need."""
    c = lambda name: F.col(f"`{name}`")
    out = psm.select(
        c(SAMPLE).alias("sample"), c(PRECURSOR).alias("precursor"), c(POSITION).cast("string").alias("peptide_position"), c(PROTEINS).alias("proteins"),
        c(GENES).alias("genes"), c(ASSAY_PROB).cast("double").alias("assay_prob"), c(quant).cast("double").alias("_quant"), c(LOC_PROBS).alias("loc_string"),
    )
    # a cheap test first: what is parsed stays out of the filter, and the sequence with its brackets is made once
    out = out.where(F.col("precursor").contains(PHOSPHO)).withColumn("_base", P.base_sequence(F.col("precursor")))
    own = (F.col("precursor"), F.col("_base"))
    out = out.withColumns({"positions": P.phospho_positions(*own), "sequence": P.clean_sequence(*own), "mods": P.modifications(*own), "loc_cells": P.localization(F.col("loc_string"))})
    return out.drop("_base")


def explode_sites(prepared: DataFrame) -> DataFrame:
    """One row per phosphorylated position; its own probability, else that of the whole assay."""
    out = prepared.withColumn("n_phospho", F.size("positions")).withColumn("position", F.explode("positions"))  # drops rows without positions
    out = out.withColumn("loc_prob", F.coalesce(P.loc_at(F.col("loc_cells"), F.col("position")), F.col("assay_prob")))
    return out.withColumn("residue", P.residue_at(F.col("sequence"), F.col("position"))).withColumn("marked", P.marked_sequence(F.col("sequence"), F.col("position")))


def site_precursors(exploded: DataFrame) -> DataFrame:
    """Per site, precursor and sample: summed quantity (0 is missing) and best localization; with the site's keys.

    Rows without a peptide position or with another residue than S, T, Y go.
    """
    start = P.first_position(F.col("peptide_position"))
    own = exploded.withColumn("_start", start).where(F.col("_start").isNotNull() & F.col("residue").isin(*RESIDUES))
    own = own.withColumn("site_position", F.col("_start") + F.col("position") - 1).withColumn("multiplicity", F.least(F.col("n_phospho"), F.lit(3)))
    own = own.withColumn("protein_group_id", keys.leading_protein(F.col("proteins"))).withColumn("gene", F.coalesce(F.split("genes", ";")[0], F.lit("")))
    own = own.withColumn("is_contaminant", keys.is_contaminant_tagged(F.col("proteins")))
    key = (F.col("residue"), F.col("site_position"), F.col("multiplicity"))
    own = own.withColumn("feature", keys.full_key(F.col("protein_group_id"), F.col("gene"), *key))
    cells = own.groupBy("feature", "protein_group_id", "gene", "residue", "site_position", "multiplicity", "precursor", "position", "sample")
    out = cells.agg(F.sum("_quant").alias("quant"), F.max("loc_prob").alias("loc_prob"), F.min("marked").alias("marked"), F.bool_or("is_contaminant").alias("is_contaminant"))
    return out.withColumn("quant", F.when(F.col("quant") != 0, F.col("quant")))


def consolidate(matrix: np.ndarray) -> np.ndarray:
    """Precursors x samples -> one row: gaps are filled from the other precursors by median ratios, then rows are summed."""
    m = matrix[(~np.isnan(matrix)).sum(axis=1) > 1].astype(float)
    nothing = np.full(matrix.shape[1], np.nan)
    if len(m) < 2:
        return m[0].copy() if len(m) else nothing
    m = m[np.argsort(np.nanmedian(m, axis=1))]
    for _ in range(10 * len(m)):
        gaps = np.isnan(m)
        if not gaps[~gaps.all(axis=1)].any():
            break
        before = m.copy()
        for r in range(len(m)):
            gap = np.isnan(m[r])
            if not gap.any() or gap.all():
                continue
            guesses = []
            for other in np.delete(m, r, axis=0):
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = m[r] / other
                ratio = ratio[np.isfinite(ratio)]
                scale = np.median(ratio) if len(ratio) else 0
                if scale and np.isfinite(scale):
                    guesses.append(scale * other[gap])
            if guesses:
                block = np.array(guesses)
                some = ~np.isnan(block).all(axis=0)
                m[r, np.flatnonzero(gap)[some]] = np.nanmedian(block[:, some], axis=0)
        if np.array_equal(before, m, equal_nan=True):
            worst = np.isnan(m).sum(axis=1)
            if not worst.max():
                break
            m = np.delete(m, int(worst.argmax()), axis=0)
            if not len(m):
                return nothing
    return np.where(np.isnan(m).all(axis=0), np.nan, np.nansum(m, axis=0))


def _consolidated(cells: DataFrame) -> DataFrame:
    """A feature's precursors by samples are one small group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.groupby(["row", "sample"])["quant"].sum(min_count=1).unstack()
        values = consolidate(wide.to_numpy(float))
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "sample": wide.columns, "quant": values})

    own = cells.select("feature", "sample", "quant", F.concat_ws("@", "precursor", F.col("position").cast("string")).alias("row"))
    return own.groupBy("feature").applyInPandas(run, "feature string, sample string, quant double")


def aggregate_sites(cells: DataFrame, aggregation: str = "sum", gate: float | None = 0.75) -> DataFrame:
    """feature, sample, quant, loc_prob. With a gate, a precursor counts if it reaches it or if none of its site and run does."""
    by = W.partitionBy("feature", "sample")
    own = cells.withColumn("loc_all", F.col("loc_prob"))
    if gate is not None:
        good = masks.class1(gate)
        own = own.withColumn("quant", F.when(good | ~F.max(good).over(by), F.col("quant")))
    best = own.groupBy("feature", "sample").agg(F.max("loc_all").alias("loc_prob"), *([] if aggregation == "consolidate" else [_aggregate(aggregation).alias("quant")]))
    if aggregation == "consolidate":
        best = best.join(_consolidated(own), ["feature", "sample"], "left")
    return best.select("feature", "sample", "quant", "loc_prob")


def _aggregate(how: str, value: str = "quant") -> Column:
    known = {"sum": F.sum, "mean": F.avg, "median": F.median}
    if how == "top3":
        return F.aggregate(F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x)
    if how not in known:
        raise ValueError(f"unknown aggregation {how!r}; known: {sorted([*known, 'top3'])}")
    return known[how](value)


def log2_intensity(quant: Column, noise_floor: bool = True) -> Column:
    """log2; zero and negative are missing, and with the noise floor results of exactly 0 or 1 are too."""
    value = F.when(quant > 0, F.log2(quant))
    return F.nullif(F.nullif(value, F.lit(0.0)), F.lit(1.0)) if noise_floor else value


def site_qc(measure: DataFrame, class1_cutoff: float = 0.75) -> DataFrame:
    """feature, n_samples_detected, mean/max/min_loc_prob, n_class1_samples, fraction_class1."""
    seen = F.col("intensity").isNotNull()
    out = measure.groupBy("feature").agg(
        F.count("intensity").alias("n_samples_detected"),
        F.avg(F.when(seen, F.col("loc_prob"))).alias("mean_loc_prob"),
        F.max(F.when(seen, F.col("loc_prob"))).alias("max_loc_prob"),
        F.min(F.when(seen, F.col("loc_prob"))).alias("min_loc_prob"),
        F.count_if(seen & masks.class1(class1_cutoff)).alias("n_class1_samples"),
    )
    return out.withColumn("fraction_class1", F.when(F.col("n_samples_detected") > 0, F.col("n_class1_samples") / F.col("n_samples_detected")))


def collapse_sites(psm: DataFrame, samples: DataFrame | None = None, advanced: dict | None = None) -> SiteDataset:
    """The whole way from a precursor report to sites."""
    s = CollapseSettings.of(advanced)
    psm = fold_channels(psm)
    quant = resolve_quant_column(psm.columns, s.engine, s.quant_level)
    if s.top_n is True or (s.top_n == "auto" and s.engine == "spectronaut"):
        filtered = psm.where(P.is_top_n(F.col(f"`{PRECURSOR}`"), F.col(f"`{LOC_PROBS}`")))
    else:
        filtered = psm
    cells = kept(site_precursors(explode_sites(prepare(filtered, quant))))  # parsed once: sites and their metadata both read it
    gate = (s.class1_cutoff if s.strategy == "condition" else s.cutoff) if s.precursor_gate else None
    sites = aggregate_sites(cells, s.aggregation, gate).withColumnRenamed("quant", "intensity")
    found = psm.select(F.col(f"`{SAMPLE}`").alias("sample")).distinct()
    labels = samples.dropDuplicates(["sample"]) if samples is not None else found.withColumn("condition", F.lit(None).cast("string"))
    if s.strategy == "condition" and samples is not None:
        sites = masks.mask_condition_aware(sites, labels, s.class1_cutoff, s.condition_threshold)[0].drop("condition")
    elif s.strategy == "per_run" or s.strategy == "condition":
        sites = masks.mask_per_run(sites, s.cutoff)
    else:
        sites = masks.filter_by_global_max(sites, s.cutoff)
    sites = sites.withColumn("intensity", log2_intensity(F.col("intensity"), s.noise_floor))
    if s.drop_all_missing and s.strategy != "global_max":
        sites = masks.drop_missing_features(sites)
    sites = kept(sites)
    meta = cells.groupBy("feature", "protein_group_id", "gene", "residue", "site_position", "multiplicity").agg(F.min("marked").alias("marked_sequence"), F.bool_or("is_contaminant").alias("is_contaminant"))
    key = (F.col("residue"), F.col("site_position"), F.col("multiplicity"))
    meta = meta.withColumn("full_key", F.col("feature")).withColumn("short_key", keys.short_key(F.col("gene"), *key)).withColumn("pg_key", keys.pg_key(F.col("protein_group_id"), *key))
    features = keys.resolve_collisions(meta.join(sites.select("feature").distinct(), "feature", "left_semi")).join(site_qc(sites, s.class1_cutoff), "feature", "left")
    features = masks.with_wilson_bound(features)
    table = found.join(labels, "sample", "left").join(selectivity(psm).select("sample", "phospho_selectivity_pct"), "sample", "left")
    if s.strategy == "wilson":
        features = masks.apply_wilson_filter(features, table.count(), s.wilson_threshold)
        sites = sites.join(features.select("feature"), "feature", "left_semi")
    return SiteDataset(sites, features, table, [("collapse_sites", str(s))])


def collapse_precursors(psm: DataFrame, samples: DataFrame | None = None, advanced: dict | None = None) -> SiteDataset:
    """PSM rows to precursors: keyed by protein, gene, peptide, charge and modifications."""
    s = PrecursorSettings.of(advanced)
    psm = fold_channels(psm)
    c = lambda name: F.col(f"`{name}`")
    own = psm.select(
        c(SAMPLE).alias("sample"), c(PRECURSOR).alias("precursor"), c(PROTEINS).alias("proteins"), c(GENES).alias("genes"), c(POSITION).cast("string").alias("peptide_position"),
        c(LOC_PROBS).alias("loc_string"), c(ASSAY_PROB).cast("double").alias("assay_prob"), c(resolve_quant_column(psm.columns)).cast("double").alias("quant"),
    )
    phospho = F.col("precursor").contains("[Phospho (STY)]")
    own = own.where(phospho) if s.phospho_only else own
    cells = P.localization(F.col("loc_string"))
    own = own.withColumn("positions", P.phospho_positions(F.col("precursor")))
    own = own.withColumn("loc_prob", F.when(phospho, F.coalesce(F.array_max(F.transform(cells, lambda x: x["prob"])), F.col("assay_prob"))))
    own = own.withColumn("protein_group_id", keys.leading_protein(F.col("proteins"))).withColumn("gene", F.coalesce(F.split("genes", ";")[0], F.lit("")))
    own = own.withColumn("peptide", P.clean_sequence(F.col("precursor"))).withColumn("charge", F.regexp_extract("precursor", r"\.(\d+)$", 1))
    mods = F.transform(P.modifications(F.col("precursor")), lambda m: F.trim(F.regexp_replace(m, r"\(.*\)", "")))
    own = own.withColumn("mods", F.array_join(mods, ","))
    own = own.withColumn("feature", F.concat_ws("|", "protein_group_id", "gene", "peptide", "charge", "mods"))
    measure = own.groupBy("feature", "sample").agg(_aggregate(s.aggregation).alias("q"), F.max("loc_prob").alias("loc_prob"))
    measure = measure.select("feature", "sample", log2_intensity(F.col("q")).alias("intensity"), "loc_prob")
    best = own.groupBy("feature").agg(
        F.min("protein_group_id").alias("protein_group_id"), F.min("gene").alias("gene"), F.min("peptide").alias("peptide"), F.min("charge").alias("charge"), F.min("mods").alias("mods"),
        F.max("loc_prob").alias("best_loc_prob"), F.min("peptide_position").alias("peptide_position"), F.max(F.struct("loc_prob", "loc_string"))["loc_string"].alias("loc_string"), F.min("positions").alias("positions"),
    )
    if s.annotate_localization:
        best = best.where(F.coalesce(F.col("best_loc_prob") >= s.class1_cutoff, F.col("positions").isNull()))
        measure = measure.join(best.select("feature"), "feature", "left_semi")
    found = psm.select(c(SAMPLE).alias("sample")).distinct()
    table = found.join(samples.dropDuplicates(["sample"]), "sample", "left") if samples is not None else found
    return SiteDataset(measure, best, table, [("collapse_precursors", str(s))])


def precursor_site_view(features: DataFrame, require_localization: float = 0.75, residues: tuple[str, ...] = RESIDUES) -> DataFrame:
    """feature, site_key: the best localized position of each precursor. Multiplicity is not clamped here."""
    cells = F.coalesce(P.localization(F.col("loc_string")), F.array().cast("array<struct<pos:int,prob:double>>"))
    best = F.get(P.ranked_positions(cells, F.lit(1)), F.lit(0))
    own = features.withColumn("_best", best).where(F.col("_best.prob") >= require_localization)
    start, position = P.first_position(F.col("peptide_position")), F.col("_best.pos")
    own = own.withColumn("residue", P.residue_at(F.col("peptide"), position)).where(F.col("residue").isin(*residues))
    key = keys.full_key(F.col("protein_group_id"), F.col("gene"), F.col("residue"), start + position - 1, F.size("positions"))
    return own.select("feature", key.alias("site_key"), F.col("_best.prob").alias("loc_prob"))


def aggregate_to_sites(result: DataFrame, view: DataFrame, stat: str = "log2fc", stat_agg: str = "max_abs", fdr: str = "fdr", fdr_agg: str = "min") -> DataFrame:
    """site_key, stat, fdr, n_precursors: the statistic of largest size with its sign, the mean, or the first."""
    own = result.join(view.select("feature", "site_key"), "feature").where("site_key is not null")
    how = {"max_abs": F.max_by(stat, F.struct(F.abs(stat), F.hash("feature"))), "mean": F.avg(stat), "first": F.min_by(stat, "feature")}
    far = {"min": F.min(fdr), "mean": F.avg(fdr)}
    if stat_agg not in how or fdr_agg not in far:
        raise ValueError(f"unknown aggregation {stat_agg!r} or {fdr_agg!r}")
    return own.groupBy("site_key").agg(how[stat_agg].alias(stat), far[fdr_agg].alias(fdr), F.count("*").alias("n_precursors"))


def collapse_proteome(rows: DataFrame, protein: str = PROTEINS, sample: str = SAMPLE, quant: str = "quant", aggregation: str = "sum", min_precursors: int | None = None) -> DataFrame:
    """feature, sample, intensity (log2): protein groups from positive precursor quantities."""
    own = rows.select(F.col(f"`{protein}`").alias("feature"), F.col(f"`{sample}`").alias("sample"), F.col(f"`{quant}`").cast("double").alias("quant")).where("quant > 0")
    out = own.groupBy("feature", "sample").agg(_aggregate(aggregation).alias("q"), F.count("*").alias("n_precursors"))
    if min_precursors is not None:
        out = out.withColumn("_most", F.max("n_precursors").over(W.partitionBy("feature"))).where(F.col("_most") >= min_precursors).drop("_most")
    return out.select("feature", "sample", F.log2("q").alias("intensity"), "n_precursors")
