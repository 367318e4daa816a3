"""Set enrichment: ORA, GSEA, kinase activities, matching of sites. Sets are library, set_name, member."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import keys, special
from quantloom.functions.fdr import adjust
from quantloom.functions.order import placed
from quantloom.storage import kept

#: The longest ranked list of which gsea() sends a number per feature to every executor (160 MB).
MAX_RANKED = 20_000_000
# The columns of the PTM table, and the sets that are made from it with their descriptions.
PTM_DB_COLUMNS = (
    "substrate_gene", "substrate_uniprot", "residue", "position", "modification", "enzyme_gene", "enzyme_uniprot", "effect", "effect_canonical", "ADB_disease_variant",
    "Ochoa_functional_score", "curation_confidence", "is_curated", "chemistry_warning_flag",
)

EFFECTS = {
    "activates_activity": "Phosphosite whose modification up-regulates the substrate's activity.",
    "inhibits_activity": "Phosphosite whose modification down-regulates the substrate's activity.",
    "induces_ppi": "Phosphosite whose modification enhances a protein-protein interaction.",
    "disrupts_ppi": "Phosphosite whose modification disrupts a protein-protein interaction.",
    "alters_stability": "Phosphosite whose modification alters substrate stability.",
}
VARIANTS = {
    "clinvar_site": (("clinvar",), "Phosphosite with a ClinVar disease-associated variant at the exact residue."),
    "cancer_TCGA_site": (("mc3_tcga", "tcga"), "Phosphosite with a TCGA/MC3 cancer mutation at the exact residue."),
}
SCORE_BINS = {
    "ochoa_top_quartile": "Phosphosite in the top 25% of Ochoa et al. 2020 functional score (most likely functional).",
    "ochoa_bottom_quartile": "Phosphosite in the bottom 25% of Ochoa et al. 2020 functional score (negative control).",
}
LIBRARY_FILES = {"FUNCTIONAL_EFFECT": "functional_effect", "DISEASE_VARIANT": "disease_variant", "FUNCTIONAL_SCORE_BIN": "functional_score"}


def set_counts(sets: DataFrame, background: DataFrame, hits: DataFrame) -> DataFrame:
    """library, set_name, set_size and overlap within the background, with the list of overlapping members."""
    own = sets.distinct().join(background.select(F.col(background.columns[0]).alias("member")).distinct(), "member", "left_semi")
    marked = own.join(hits.select(F.col(hits.columns[0]).alias("member"), F.lit(1).alias("_hit")).distinct(), "member", "left")
    return marked.groupBy("library", "set_name").agg(
        F.count("*").alias("set_size"), F.count("_hit").alias("overlap"), F.array_sort(F.collect_list(F.when(F.col("_hit").isNotNull(), F.col("member")))).alias("members")
    )


def ora(hits: DataFrame, background: DataFrame, sets: DataFrame, min_set_size: int = 5, min_overlap: int = 1, alternative: str = "two-sided", fdr_method: str = "bh", pooled: bool = False) -> DataFrame:
    """Fisher's exact test of every set; hits must be part of the background."""
    hits, background = hits.select(F.col(hits.columns[0]).alias("m")).distinct(), background.select(F.col(background.columns[0]).alias("m")).distinct()
    if hits.join(background, "m", "left_anti").limit(1).count():
        raise ValueError("some hits are not in the background")
    n, k = background.count(), hits.count()
    out = set_counts(sets, background, hits).where((F.col("set_size") >= max(min_set_size, 1)) & (F.col("overlap") >= min_overlap))

    @F.pandas_udf("double")
    def p(overlap: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([special.fisher_exact(int(a), k - int(a), int(s - a), n - k - int(s - a), alternative) for a, s in zip(overlap, size, strict=True)])

    out = out.withColumn("expected", F.col("set_size") * (k / max(n, 1))).withColumn("log2_fold", F.when(F.col("overlap") > 0, F.log2(F.try_divide("overlap", "expected"))))
    out = out.withColumn("direction", F.when(F.col("overlap") > F.col("expected"), "enriched").otherwise("depleted")).withColumn("p_value", p("overlap", "set_size"))
    return adjust(out, by=() if pooled else ("library",), method=fdr_method)


def enrichment_score(ranked: DataFrame, sets: DataFrame, weight: float = 1.0) -> DataFrame:
    """library, set_name, size, es: the running sum's largest deviation. ranked: feature, stat.

    Only a set's own members are walked through: between them the sum falls in a straight line.
    """
    positions = placed(ranked, F.col("stat").desc(), "feature").drop("_piece")
    total = positions.count()
    own = sets.distinct().join(positions, F.col("member") == F.col("feature")).withColumn("w", F.pow(F.abs("stat"), F.lit(float(weight))))
    by = W.partitionBy("library", "set_name")
    upto = by.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("n", F.count("*").over(by)).withColumn("sum_w", F.sum("w").over(by)).withColumn("i", F.row_number().over(by.orderBy("place"))).withColumn("cum", F.sum("w").over(upto))
    share = lambda c: F.when(F.col("sum_w") > 0, c / F.col("sum_w")).otherwise(0.0)
    missed = (F.col("place") - F.col("i")) / F.greatest(F.lit(total) - F.col("n"), F.lit(1))
    own = own.withColumn("after", share(F.col("cum")) - missed).withColumn("before", share(F.col("cum") - F.col("w")) - missed)
    return own.groupBy("library", "set_name").agg(F.max("n").alias("size"), F.max("after").alias("top"), F.min("before").alias("bottom")).select(
        "library", "set_name", "size", F.when(F.col("top") >= -F.col("bottom"), F.col("top")).otherwise(F.col("bottom")).alias("es")
    )


def _es(places: np.ndarray, weights: np.ndarray, total: int) -> float:
    w = weights[places]
    s = w.sum()
    cum = np.cumsum(w) / s if s > 0 else np.zeros(len(w))
    missed = (places - np.arange(len(places))) / max(total - len(places), 1)
    after, before = cum - missed, np.concatenate([[0.0], cum[:-1]]) - missed
    top, bottom = after.max(), before.min()
    return float(top if top >= -bottom else bottom)


def gsea(ranked: DataFrame, sets: DataFrame, min_set_size: int = 5, max_set_size: int = 500, n_permutations: int = 10_000, seed: int = 42, weight: float = 1.0, fdr_method: str = "bh") -> DataFrame:
    """es, nes, p_value, fdr and leading edge of every set; random position sets of the same size, seeded by the set's name.

    ranked: feature, stat - one row per feature. Places come from a distributed sort and a set's members join them;
    what goes to the executors whole is one number per feature, the weights by place, which random sets draw from:
    at most MAX_RANKED of them (a longer list fails).
    """
    positions = kept(placed(ranked.where("stat is not null"), F.col("stat").desc(), "feature").drop("_piece"))
    total = positions.count()
    if total > MAX_RANKED:
        raise ValueError(f"{total} ranked features; at most {MAX_RANKED} can be drawn from")
    if positions.select("feature").distinct().count() < total:
        raise ValueError("a feature is ranked twice")
    weights = np.zeros(total)
    listed = positions.select("place", "stat").toArrow()
    weights[listed["place"].to_numpy() - 1] = np.abs(listed["stat"].to_numpy().astype(float)) ** weight
    held = ranked.sparkSession.sparkContext.broadcast(weights)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        weights, pdf = held.value, pdf.sort_values("place")
        at = pdf["place"].to_numpy() - 1
        es = _es(at, weights, total)
        rng = np.random.default_rng([seed, zlib.crc32(f"{pdf['library'].iloc[0]}|{pdf['set_name'].iloc[0]}".encode())])
        null = np.array([_es(np.sort(rng.choice(total, len(at), replace=False)), weights, total) for _ in range(n_permutations)])
        same = null[null >= 0] if es >= 0 else null[null < 0]
        mean = np.abs(same).mean() if len(same) else math.nan
        w = weights[at]
        cum = np.cumsum(w) / max(w.sum(), 1e-300) - (at - np.arange(len(at))) / max(total - len(at), 1)
        edge = slice(0, int(cum.argmax()) + 1) if es >= 0 else slice(int((cum - w / max(w.sum(), 1e-300)).argmin()), None)
        p = ((np.abs(same) >= abs(es)).sum() + 1) / (len(same) + 1)
        row = [pdf["library"].iloc[0], pdf["set_name"].iloc[0], len(at), es, es / mean if mean else math.nan, p, pdf["feature"].astype(str).tolist()[edge]]
        return pd.DataFrame([row], columns=["library", "set_name", "size", "es", "nes", "p_value", "leading_edge"])

    met = sets.distinct().join(positions, F.col("member") == F.col("feature")).select("library", "set_name", "feature", "place")
    sizes = met.groupBy("library", "set_name").agg(F.count("*").alias("n")).where(F.col("n").between(min_set_size, max_set_size)).drop("n")
    out = met.join(sizes, ["library", "set_name"]).groupBy("library", "set_name").applyInPandas(run, "library string, set_name string, size long, es double, nes double, p_value double, leading_edge array<string>")
    return adjust(out, by=("library",), method=fdr_method)


def library_redundancy(sets: DataFrame, background: DataFrame | None = None, min_jaccard: float = 0.0) -> DataFrame:
    """Jaccard of the pairs of sets of a library that share a member."""
    own = sets.distinct()
    if background is not None:
        own = own.join(background.select(F.col(background.columns[0]).alias("member")), "member", "left_semi")
    sizes = own.groupBy("library", "set_name").agg(F.count("*").alias("n"))
    a, b = own.withColumnRenamed("set_name", "set_a"), own.withColumnRenamed("set_name", "set_b")
    met = a.join(b, ["library", "member"]).where("set_a < set_b").groupBy("library", "set_a", "set_b").agg(F.count("*").alias("shared"))
    met = met.join(sizes.select("library", F.col("set_name").alias("set_a"), F.col("n").alias("size_a")), ["library", "set_a"]).join(sizes.select("library", F.col("set_name").alias("set_b"), F.col("n").alias("size_b")), ["library", "set_b"])
    return met.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).where(F.col("jaccard") >= min_jaccard)


def dedup_abs_max(result: DataFrame, key: str, stat: str) -> DataFrame:
    """One row per key: the statistic of largest size (of equal ones the larger)."""
    return result.where(F.col(key).isNotNull() & F.col(stat).isNotNull()).groupBy(key).agg(F.max_by(stat, F.struct(F.abs(stat), F.col(stat))).alias(stat))


def validate_network(net: DataFrame) -> DataFrame:
    """source, target, weight (1 by default), one row per pair."""
    missing = {"source", "target"} - set(net.columns)
    if missing:
        raise ValueError(f"the network lacks {sorted(missing)}")
    weight = F.col("weight").cast("double") if "weight" in net.columns else F.lit(1.0)
    out = net.select("source", "target", weight.alias("weight")).where("source is not null and target is not null")
    if not out.limit(1).count():
        raise ValueError("the network is empty")
    return out.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def kinase_activity(stats: DataFrame, net: DataFrame, method: str = "ulm", min_substrates: int = 5, fdr_method: str = "bh") -> DataFrame:
    """ULM: the t value of the slope of a one-variable regression of all statistics on a kinase's weights.

    stats: target, stat. Targets outside a kinase's substrates have weight 0, so sums over substrates are enough.
    """
    net = validate_network(net)
    own = dedup_abs_max(stats, "target", "stat")
    n, total, squares = own.agg(F.count("*"), F.sum("stat"), F.sum(F.col("stat") * F.col("stat"))).first()
    met = net.join(own, "target")
    if method == "mlm":
        return _mlm(met, own, min_substrates, fdr_method)
    if method != "ulm":
        raise ValueError(f"unknown method {method!r}")
    sums = met.groupBy("source").agg(F.count("*").alias("n_substrates"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("ww"), F.sum(F.col("weight") * F.col("stat")).alias("wy"))
    sums = sums.where(F.col("n_substrates") >= min_substrates)
    sxx, sxy, syy = F.col("ww") - F.col("w") * F.col("w") / n, F.col("wy") - F.col("w") * total / n, squares - total * total / n
    r = F.try_divide(sxy, F.sqrt(sxx * syy))
    out = sums.withColumn("score", F.try_divide(r * F.sqrt(F.lit(n - 2.0)), F.sqrt(1 - r * r)))
    return _scored(out, n - 2, fdr_method)


def _scored(out: DataFrame, df: int, fdr_method: str) -> DataFrame:
    @F.pandas_udf("double")
    def p(t: pd.Series) -> pd.Series:
        return pd.Series(special.t_sf2(t.to_numpy(float), df))

    out = out.select("source", "score", "n_substrates", F.when(F.col("score").isNotNull(), p("score")).alias("p_value"))
    return adjust(out.withColumn("direction", F.when(F.col("score") > 0, "up").otherwise("down")), method=fdr_method)


def _mlm(met: DataFrame, stats: DataFrame, min_substrates: int, fdr_method: str) -> DataFrame:
    """One regression on all kinases; kinases are some hundreds, so its normal equations fit on the driver."""
    counts = met.groupBy("source").agg(F.count("*").alias("n_substrates"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("stat")).alias("wy")).where(F.col("n_substrates") >= min_substrates).orderBy("source").toPandas()
    names = counts["source"].tolist()
    kept = met.join(F.broadcast(met.sparkSession.createDataFrame([(s,) for s in names], "source string")), "source", "left_semi")
    a, b = kept.select("target", F.col("source").alias("a"), F.col("weight").alias("wa")), kept.select("target", F.col("source").alias("b"), F.col("weight").alias("wb"))
    cross = a.join(b, "target").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s")).toPandas()
    n, total, squares = stats.agg(F.count("*"), F.sum("stat"), F.sum(F.col("stat") * F.col("stat"))).first()
    at = {s: i + 1 for i, s in enumerate(names)}
    m, v = np.zeros((len(names) + 1,) * 2), np.array([total, *counts["wy"]])
    m[0, 0], m[0, 1:], m[1:, 0] = n, counts["w"], counts["w"]
    for x, y, s in cross.itertuples(index=False):
        m[at[x], at[y]] = s
    inverse = np.linalg.pinv(m)
    beta, df = inverse @ v, n - len(names) - 1
    scale = max(squares - beta @ v, 0) / max(df, 1)
    scores = beta[1:] / np.sqrt(scale * np.diag(inverse)[1:])
    rows = list(zip(names, map(float, scores), map(int, counts["n_substrates"]), strict=True))
    return _scored(met.sparkSession.createDataFrame(rows, "source string, score double, n_substrates long"), df, fdr_method)


def ksea_z(stats: DataFrame, net: DataFrame, min_substrates: int = 3) -> DataFrame:
    """z = (mean of substrates - mean of all) * sqrt(n) / sd of all; two-sided normal p."""
    mean, sd = stats.agg(F.avg("stat"), F.stddev_samp("stat")).first()
    own = net.select("source", "target").distinct().join(stats, "target").groupBy("source").agg(F.count("stat").alias("n"), F.avg("stat").alias("mean")).where(F.col("n") >= min_substrates)

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series(2 * special.normal_sf(z.abs().to_numpy(float)))

    return adjust(own.withColumn("z", (F.col("mean") - mean) * F.sqrt("n") / sd).withColumn("p_value", p("z")))


def load_ptm_db(frame: DataFrame) -> DataFrame:
    missing = [c for c in PTM_DB_COLUMNS if c not in frame.columns]
    if missing:
        raise ValueError(f"the PTM database lacks the columns {missing}")
    return frame


def ptm_network(db: DataFrame, require_curated: bool = True, min_confidence: float | None = None) -> DataFrame:
    """Kinase-substrate edges: the best confidence of each pair."""
    own = load_ptm_db(db).where("enzyme_gene is not null")
    own = own.where("is_curated") if require_curated else own
    own = own.where(F.col("curation_confidence").cast("double") >= min_confidence) if min_confidence is not None else own
    target = keys.site_id(F.col("substrate_uniprot"), F.col("residue"), F.col("position"))
    return own.select(F.col("enzyme_gene").alias("source"), target.alias("target"), F.col("curation_confidence").cast("double").alias("confidence")).where("target is not null").groupBy("source", "target").agg(F.max("confidence").alias("confidence"), F.lit(1.0).alias("weight"))


def best_sourced_network(edges: DataFrame, min_n_sources: int = 1) -> DataFrame:
    """Edges from a table with n_sources: the best of each pair."""
    return edges.where(F.col("n_sources") >= min_n_sources).groupBy("source", "target").agg(F.max("n_sources").alias("n_sources"), F.lit(1.0).alias("weight"))


def kinase_substrate_sets(db: DataFrame, min_set_size: int = 5, require_curated: bool = True) -> DataFrame:
    own = ptm_network(db, require_curated).select(F.lit("kinase_substrates").alias("library"), F.col("source").alias("set_name"), F.col("target").alias("member"))
    return own.withColumn("_n", F.count("*").over(W.partitionBy("set_name"))).where(F.col("_n") >= min_set_size).drop("_n")


def ptm_libraries(db: DataFrame, min_set_size: int = 5, require_curated: bool = False, drop_chemistry_warned: bool = True) -> DataFrame:
    """library, set_name, member: sites by effect on function, by disease variant, and by the outer quartiles of functional scores."""
    own = load_ptm_db(db)
    own = own.where("is_curated") if require_curated else own
    own = own.where(~F.coalesce(F.col("chemistry_warning_flag").cast("boolean"), F.lit(False))) if drop_chemistry_warned else own
    own = own.withColumn("member", keys.site_id(F.col("substrate_uniprot"), F.col("residue"), F.col("position"))).where("member is not null")
    scores = own.where("Ochoa_functional_score is not null").groupBy("substrate_uniprot", "residue", "position", "member").agg(F.min(F.col("Ochoa_functional_score").cast("double")).alias("s"))
    q25, q75 = scores.agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.75)))).first()[0] or (None, None)
    variant = F.lower("ADB_disease_variant")
    effects = [(name, F.col("effect_canonical") == name) for name in EFFECTS]
    variants = [(name, F.greatest(*(variant.contains(t) for t in tokens)) if len(tokens) > 1 else variant.contains(tokens[0])) for name, (tokens, _) in VARIANTS.items()]
    named = lambda library, rules: F.explode(F.filter(F.array(*(F.when(rule, F.struct(F.lit(library).alias("library"), F.lit(name).alias("set_name"))) for name, rule in rules)), lambda s: s.isNotNull())).alias("s")
    out = own.select(named("FUNCTIONAL_EFFECT", effects), "member").unionByName(own.select(named("DISEASE_VARIANT", variants), "member"))
    if q75 is not None:
        bins = [("ochoa_top_quartile", F.col("s") >= q75), ("ochoa_bottom_quartile", F.col("s") <= q25)]
        out = out.unionByName(scores.select(named("FUNCTIONAL_SCORE_BIN", bins), "member"))
    out = out.select("s.library", "s.set_name", "member").distinct()
    return out.withColumn("_n", F.count("*").over(W.partitionBy("library", "set_name"))).where(F.col("_n") >= min_set_size).drop("_n")


def libraries_manifest(sets: DataFrame) -> DataFrame:
    """library, set_name, n_sites, description."""
    described = F.create_map(*(F.lit(x) for pair in ({**EFFECTS, **{k: v[1] for k, v in VARIANTS.items()}, **SCORE_BINS}).items() for x in pair))
    return sets.groupBy("library", "set_name").agg(F.count("*").alias("n_sites")).withColumn("description", F.coalesce(F.try_element_at(described, F.col("set_name")), F.lit("")))


def emit_libraries(db: DataFrame, path: str, min_set_size: int = 5, require_curated: bool = False, drop_chemistry_warned: bool = True) -> DataFrame:
    """Writes each library as GMT lines and the manifest as CSV below path; returns the manifest."""
    sets = kept(ptm_libraries(db, min_set_size, require_curated, drop_chemistry_warned))
    manifest = libraries_manifest(sets)
    lines = sets.groupBy("library", "set_name").agg(F.concat_ws("\t", F.array_sort(F.collect_set("member"))).alias("members")).join(manifest, ["library", "set_name"])
    for library, name in LIBRARY_FILES.items():
        lines.where(F.col("library") == library).orderBy("set_name").select(F.concat_ws("\t", "set_name", "description", "members").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}.gmt")
    manifest.orderBy("library", "set_name").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/manifest.csv")
    return manifest


def match_sites(queries: DataFrame, db: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, unmatched with reason, counts): by protein, residue and position; else by gene, residue and position."""
    p = keys.parse_key(F.col(key))
    own = queries.select(key).distinct().withColumns({"_p": p["protein"], "_g": p["gene"], "_r": p["residue"], "_n": p["position"]})
    place = [F.col("residue").alias("_r"), F.col("position").cast("int").alias("_n"), keys.site_id(F.col("substrate_uniprot"), F.col("residue"), F.col("position")).alias("site_id")]
    by_protein = db.select(F.col("substrate_uniprot").alias("_p"), *place).groupBy("_p", "_r", "_n").agg(F.min("site_id").alias("_by_protein"))
    by_gene = db.select(F.col("substrate_gene").alias("_g"), *place).groupBy("_g", "_r", "_n").agg(F.min("site_id").alias("_by_gene"))
    met = own.join(by_protein, ["_p", "_r", "_n"], "left").join(by_gene, ["_g", "_r", "_n"], "left")
    met = met.withColumn("site_id", F.coalesce("_by_protein", "_by_gene")).withColumn("tier", F.when(F.col("_by_protein").isNotNull(), "protein").when(F.col("_by_gene").isNotNull(), "gene"))
    reason = F.when(F.col("_r").isNull(), "unparseable").otherwise("not_in_database")
    matched, unmatched = met.where("site_id is not null").select(key, "site_id", "tier"), met.where("site_id is null").select(key, reason.alias("reason"))
    stats = met.agg(F.count("*").alias("n_queries"), F.count("site_id").alias("n_matched"), F.count_if(F.col("tier") == "protein").alias("n_by_protein"), F.count_if(F.col("tier") == "gene").alias("n_by_gene"))
    return matched, unmatched, stats


def attach_site_ids(result: DataFrame, db: DataFrame, key: str = "feature") -> DataFrame:
    return result.join(match_sites(result, db, key)[0].select(key, "site_id"), key, "left")


def sites_to_genes(result: DataFrame, stat: str = "log2fc", how: str = "max_abs", key: str = "feature") -> DataFrame:
    """gene, stat: the largest change, or that of the lowest FDR."""
    own = result.withColumn("gene", keys.key_gene(F.col(key))).where("gene is not null")
    if how not in ("max_abs", "min_fdr"):
        raise ValueError(f"unknown aggregation {how!r}")
    best = F.max_by(stat, F.struct(F.abs(stat), F.col(stat))) if how == "max_abs" else F.min_by(stat, F.struct("fdr", F.col(key)))
    return own.groupBy("gene").agg(best.alias(stat))


def pathway_enrichment(result: DataFrame, gene_sets: DataFrame, fdr_threshold: float = 0.05, log2fc_threshold: float = 0.0, direction: str = "split", background: DataFrame | None = None, **how) -> DataFrame:
    """ORA on genes for up, down, both, or up and down apart."""
    own = result.withColumn("gene", keys.key_gene(F.col("feature"))).where("gene is not null")
    base = background if background is not None else own.select("gene").distinct()
    hit = F.col("fdr") < fdr_threshold
    sides = {"up": hit & (F.col("log2fc") > log2fc_threshold), "down": hit & (F.col("log2fc") < -log2fc_threshold), "both": hit & (F.abs("log2fc") > log2fc_threshold)}
    if direction not in (*sides, "split", "any"):
        raise ValueError(f"unknown direction {direction!r}")
    out = None
    for side in ("up", "down") if direction == "split" else ("both",) if direction == "any" else (direction,):
        genes = own.where(sides[side]).select("gene").distinct().join(base, "gene", "left_semi")
        part = ora(genes, base, gene_sets, **how).withColumn("hit_direction", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


def pathway_gsea(result: DataFrame, gene_sets: DataFrame, stat: str = "log2fc", how: str = "max_abs", min_set_size: int = 15, max_set_size: int = 500, n_permutations: int = 1000, seed: int = 42) -> DataFrame:
    ranked = sites_to_genes(result, stat, how).select(F.col("gene").alias("feature"), F.col(stat).alias("stat"))
    return gsea(ranked, gene_sets, min_set_size, max_set_size, n_permutations, seed)


def expectations(gold: DataFrame, condition_query: str) -> DataFrame:
    return gold.where(F.lower("Condition").contains(condition_query.lower()))


def score_against_gold(scores: DataFrame, gold: DataFrame, condition_query: str) -> DataFrame:
    """One row: share of expected kinases whose score has the expected sign, and rank AUC of expected up kinases."""
    own = expectations(gold, condition_query).select(F.col("Kinase").alias("source"), F.lower("Directionality").alias("d")).distinct()
    met = scores.join(own, "source", "left")
    right = F.when(F.col("d").contains("up"), F.col("score") > 0).when(F.col("d").contains("down"), F.col("score") < 0)
    places = placed(met.withColumn("right", right), "score", "source").drop("_piece")
    middle = places.groupBy("score").agg(F.avg("place").alias("rank"))  # of ties
    ranked = places.alias("a").join(middle.alias("b"), F.col("a.score").eqNullSafe(F.col("b.score"))).select("a.*", "rank").withColumn("up", F.coalesce(F.col("d").contains("up"), F.lit(False)))
    n1, n0 = F.count_if("up"), F.count_if(~F.col("up"))
    auc = F.try_divide(F.sum(F.when(F.col("up"), F.col("rank"))) - n1 * (n1 + 1) / 2, n1 * n0)
    return ranked.agg(F.count("d").alias("n_expected"), F.count_if("right").alias("n_right"), F.try_divide(F.count_if("right"), F.count("d")).alias("recall"), auc.alias("auc"))


def top_k(frame: DataFrame, by: Column | str, value: str, k: int, tie: str) -> DataFrame:
    """The k largest values of each key; ties in the order of `tie`."""
    return frame.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col(value).desc(), tie))).where(F.col("rank") <= k)
