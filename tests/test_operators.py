import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import fdr, order
from quantloom.operators import collapse, dimred, dose, enrichment, impute, masks, proteome, qc, sequences, signalome, stats
from quantloom.plans import queries
from quantloom.schema import ASSAY_PROB, GENES, LOC_PROBS, POSITION, PRECURSOR, PROTEINS, QUANT, SAMPLE


def psm(spark):
    s = "_S[Phospho (STY)]TVQK_.2"
    rows = [
        ("a", "P1;P2", "G1;G2", "473", s, 0.9, "_S[Phospho (STY): 99%]TVQK_", 8.0),
        ("a", "P1;P2", "G1;G2", "473", "_S[Phospho (STY)]TVQK_.3", 0.9, "_S[Phospho (STY): 60%]T[Phospho (STY): 40%]VQK_", 100.0),
        ("b", "P1;P2", "G1;G2", "473", s, 0.9, "_S[Phospho (STY): 50%]T[Phospho (STY): 50%]VQK_", 16.0),
        ("a", "P3", "G3", "10,20", "_AS[Phospho (STY)]T[Phospho (STY)]K_.2", 0.8, None, 32.0),
        ("a", "P4", "G4", "None", s, 0.9, "_S[Phospho (STY): 99%]TVQK_", 5.0),
        ("a", "P5", "G5", "7", "_PEPTIDE_.2", None, None, 5.0),
        ("b", "P1;P2", "G1;G2", "473", "_ST[Phospho (STY)]VQK_.2", 0.9, "_S[Phospho (STY): 90%]T[Phospho (STY): 10%]VQK_", 9.0),
    ]
    names = [SAMPLE, PROTEINS, GENES, POSITION, PRECURSOR, ASSAY_PROB, LOC_PROBS, QUANT]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'double' if n in (ASSAY_PROB, QUANT) else 'string'}" for n in names))


def test_collapse_sites(spark):
    out = collapse.collapse_sites(psm(spark), advanced={"strategy": "per_run", "cutoff": 0.75})
    got = {(r["feature"], r["sample"]): r["intensity"] for r in out.measure.where("intensity is not null").collect()}
    # the second precursor of sample a misses the gate; sample b is not localized; P3 falls back to the assay's probability
    assert got == {("P1|G1|S473|M1", "a"): 3.0}
    loose = collapse.collapse_sites(psm(spark), advanced={"strategy": "per_run", "cutoff": 0.0, "precursor_gate": False, "top_n": False})
    got = {(r["feature"], r["sample"]): round(r["intensity"], 6) for r in loose.measure.where("intensity is not null").collect()}
    assert got[("P1|G1|S473|M1", "a")] == round(math.log2(108), 6) and got[("P3|G3|S11|M2", "a")] == got[("P3|G3|T12|M2", "a")] == 5.0
    assert ("P1|G1|T474|M1", "b") in got and not any(k[0].startswith(("P4", "P5")) for k in got)
    row = out.samples.where("sample = 'a'").first()
    assert row["phospho_selectivity_pct"] == 75.0


def test_condition_mask(spark):
    cells = [("f", s, 1.0 + i, p) for i, (s, p) in enumerate([("a", 0.9), ("b", 0.5), ("c", 0.9), ("d", 0.1), ("e", None)])]
    measure = spark.createDataFrame(cells, "feature string, sample string, intensity double, loc_prob double")
    samples = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("f", "y")], "sample string, condition string")
    masked, decisions = masks.mask_condition_aware(measure, samples, 0.75, 0.6)
    assert {r["sample"] for r in masked.where("intensity is not null").collect()} == {"a", "c"}
    masked, decisions = masks.mask_condition_aware(measure, samples, 0.75, 0.5)
    assert {r["sample"] for r in masked.where("intensity is not null").collect()} == {"a", "b", "c", "d"}
    assert {(r["condition"], r["n_samples"], r["fraction"]) for r in decisions.collect()} == {("x", 2, 0.5), ("y", 2, 0.5)}


def test_consolidate():
    nan = np.nan
    m = np.array([[10.0, 20.0, nan], [1.0, 2.0, 4.0], [nan, nan, 5.0]])
    assert collapse.consolidate(m).tolist() == [11.0, 22.0, 44.0]
    assert np.isnan(collapse.consolidate(np.array([[1.0, nan]]))).all() and collapse.consolidate(np.zeros((0, 2))).shape == (2,)


def test_precursors_and_site_view(spark):
    out = collapse.collapse_precursors(psm(spark))
    view = {r["site_key"] for r in collapse.precursor_site_view(out.features).collect()}
    assert "P1|G1|S473|M1" in view
    result = out.features.select("feature").withColumn("log2fc", F.lit(-2.0)).withColumn("fdr", F.lit(0.1))
    assert collapse.aggregate_to_sites(result, collapse.precursor_site_view(out.features)).first()["log2fc"] == -2.0


def test_wilson():
    assert masks.wilson_lower_bound(0, 0) == 0 and masks.wilson_lower_bound(5, 10)[()] == pytest.approx(0.2234, abs=2e-3)
    assert (np.diff(masks.wilson_lower_bound(np.arange(11), np.full(11, 10))) > 0).all()


def matrix(spark, x, samples=None):
    samples = samples or [f"s{j}" for j in range(x.shape[1])]
    rows = [(f"f{i:03d}", s, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(len(x)) for j, s in enumerate(samples)]
    return spark.createDataFrame(rows, "feature string, sample string, intensity double")


def groups(spark, labels):
    return spark.createDataFrame([(f"s{j}", g, f"b{j % 2}") for j, g in enumerate(labels)], "sample string, condition string, batch string")


def test_linear_model_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(20, 1, (60, 9)) * np.linspace(0.5, 1.5, 60)[:, None] ** 0.1
    labels = ["a"] * 3 + ["b"] * 3 + ["c"] * 3
    out = {r["feature"]: r for r in stats.diff_exp_contrasts(matrix(spark, x), groups(spark, labels), [("b", "a")], trend=False).collect()}
    design = stats.design_matrix(groups(spark, labels))
    beta = np.linalg.lstsq(design.matrix, x.T, rcond=None)[0]
    sigma2 = ((x.T - design.matrix @ beta) ** 2).sum(axis=0) / 6
    for i in (0, 17, 59):
        r = out[f"f{i:03d}"]
        assert r["log2fc"] == pytest.approx(x[i, 3:6].mean() - x[i, :3].mean()) and r["sigma2"] == pytest.approx(sigma2[i])
    fit = stats.lm_fit(matrix(spark, x), design)
    prior = stats.fit_prior(fit)
    post = (prior.df * prior.variance + 6 * sigma2) / (prior.df + 6) if math.isfinite(prior.df) else np.full(60, prior.variance)
    assert out["f005"]["t_stat"] == pytest.approx(out["f005"]["log2fc"] / math.sqrt(post[5] * 2 / 3))
    f = {r["feature"]: r for r in stats.diff_exp_anova(matrix(spark, x), groups(spark, labels), trend=False).collect()}
    means = np.array([x[5, :3].mean(), x[5, 3:6].mean(), x[5, 6:].mean()])
    assert f["f005"]["f_stat"] == pytest.approx(3 * ((means - means.mean()) ** 2).sum() / 2 / post[5])
    trend = stats.diff_exp_contrasts(matrix(spark, x), groups(spark, labels), [("b", "a")])
    assert trend.where("p_value between 0 and 1 and fdr >= p_value").count() == 60


def test_design_guards(spark):
    with pytest.raises(ValueError, match="rank"):
        stats.design_matrix(spark.createDataFrame([("s0", "a", "x"), ("s1", "b", "y")], "sample string, condition string, k string"), covariates=["k"])
    with pytest.raises(ValueError, match="whole numbers"):
        stats.covariate_is_continuous([1, 2], "k")
    assert stats.sanitize_levels(["a b", "a-b", "1"]) == {"a b": "a_b", "a-b": "a_b_2", "1": "x1"}


def test_on_off_and_completeness(spark):
    nan = np.nan
    x = np.array([[1, 1, 1, 1], [1, 1, nan, nan], [nan, 1, nan, nan], [nan, nan, 1, 1.0]])
    measure, samples = matrix(spark, x), groups(spark, ["t", "t", "c", "c"])
    got = {r["feature"]: r["status"] for r in stats.on_off(measure, samples, ("t", "c"), min_observed=2).collect()}
    assert got == {"f000": "both", "f001": "on_in_treatment", "f002": "absent", "f003": "on_in_control"}
    kept = lambda **k: sorted({r["feature"] for r in masks.filter_by_completeness(measure, samples, **k).select("feature").distinct().collect()})
    assert kept(min_valid_frac=0.5) == ["f000", "f001", "f003"] and kept(min_valid_n=2, group_column="condition", keep_strategy="each") == ["f000"]
    with pytest.raises(ValueError):
        masks.filter_by_completeness(measure, samples)


def test_imputation(spark):
    nan = np.nan
    x = np.array([[1, 2, 3, 4], [1.1, nan, 3.1, 4.1], [9, 8, 7, nan], [9, 8, 7.2, 6]], float)
    out = {(r["feature"], r["sample"]): r["intensity"] for r in impute.impute_knn(matrix(spark, x), groups(spark, "aabb"), 1).collect()}
    assert out[("f001", "s1")] == 2 and out[("f002", "s3")] == 6 and len(out) == 16
    hybrid = impute.impute_hybrid(matrix(spark, x), groups(spark, "aabb"), n_neighbors=1)
    assert hybrid.where("intensity is null").count() == 0 and hybrid.where("strategy = 'observed'").count() == 14
    assert impute.impute_shift(matrix(spark, x), groups(spark, "aabb")).where("is_imputed").count() == 2


def test_combat_removes_a_batch(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(20, 1, (80, 8))
    x[:, 1::2] += 3
    out = impute.combat(matrix(spark, x), groups(spark, "aabbaabb")).groupBy(F.substring("sample", 2, 1).cast("int") % 2).agg(F.avg("intensity")).collect()
    assert abs(out[0][1] - out[1][1]) < 0.2


def test_distance_pca_and_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    x[:, :3] += 5
    measure = matrix(spark, x)
    d = {(r["sample_a"], r["sample_b"]): r["distance"] for r in dimred.sample_distance(measure).collect()}
    assert d[("s0", "s4")] == pytest.approx(math.sqrt(((x[:, 0] - x[:, 4]) ** 2).mean()))
    scores, loadings, ratios = dimred.pca(measure, 3)
    u, s, _ = np.linalg.svd((x - x.mean(axis=1, keepdims=True)).T, full_matrices=False)
    got = np.array([r["value"] for r in scores.where("pc = 1").orderBy("sample").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, 0] * s[0])) and ratios[0] == pytest.approx(s[0] ** 2 / (s**2).sum())
    assert loadings.where("pc = 1").agg(F.sum(F.col("value") ** 2)).first()[0] == pytest.approx(1)
    tree, order = dimred.hierarchical_cluster(dimred.sample_distance(measure), "ward")
    assert {*order[:3]} in ({"s0", "s1", "s2"}, {"s3", "s4", "s5"}) and dimred.cut_tree(tree, 2).tolist() == [1, 1, 1, 2, 2, 2]
    assert dimred.linkage(np.array([[0, 1, 4], [1, 0, 3], [4, 3, 0]], float), "single")[:, 2].tolist() == [1, 3]
    y = dimred.tsne(np.r_[rng.normal(size=(8, 3)), rng.normal(size=(8, 3)) + 20], perplexity=4, rounds=300)
    assert np.linalg.norm(y[:8].mean(0) - y[8:].mean(0)) > 3 * y[:8].std()


def test_enrichment(spark):
    background = spark.createDataFrame([(f"S{i}",) for i in range(100)], "m string")
    hits = background.where(F.substring("m", 2, 3).cast("int") < 20)
    sets = spark.createDataFrame([("lib", "a", f"S{i}") for i in range(10, 40)], "library string, set_name string, member string")
    r = enrichment.ora(hits, background, sets).first()
    assert (r["overlap"], r["set_size"], r["expected"], r["direction"]) == (10, 30, 6.0, "enriched")
    ranked = spark.createDataFrame([(f"S{i}", float(50 - i)) for i in range(100)], "feature string, stat double")
    top = spark.createDataFrame([("lib", "top", f"S{i}") for i in range(8)], "library string, set_name string, member string")
    es = enrichment.enrichment_score(ranked, top).first()["es"]
    g = enrichment.gsea(ranked, top, n_permutations=200).first()
    assert es == pytest.approx(1.0) and g["es"] == pytest.approx(es) and g["p_value"] < 0.05 and len(g["leading_edge"]) == 8
    net = spark.createDataFrame([("K", f"S{i}", 1.0) for i in range(0, 30)] + [("L", f"S{i}", -1.0) for i in range(20, 60)], "source string, target string, weight double")
    stat = ranked.withColumnRenamed("feature", "target")
    got = {r["source"]: r["score"] for r in enrichment.kinase_activity(stat, net).collect()}
    y = np.array([50.0 - i for i in range(100)])
    w = np.array([1.0] * 30 + [0.0] * 70)
    r = np.corrcoef(w, y)[0, 1]
    assert got["K"] == pytest.approx(r * math.sqrt(98 / (1 - r * r)))
    mlm = {r["source"]: r["score"] for r in enrichment.kinase_activity(stat, net, "mlm").collect()}
    v = np.array([0.0] * 20 + [-1.0] * 40 + [0.0] * 40)
    a = np.column_stack([np.ones(100), w, v])
    beta, rss = np.linalg.lstsq(a, y, rcond=None)[:2]
    assert mlm["K"] == pytest.approx(beta[1] / math.sqrt(rss[0] / 97 * np.linalg.inv(a.T @ a)[1, 1]))


def test_sequences(spark):
    fasta = spark.createDataFrame([("P1", "G1", True, "MKRSPEAATYK"), ("P2", "G2", False, "MKRSPEAGTYK")], "accession string, gene string, reviewed boolean, sequence string")
    own = sequences.phospho_windows(fasta, 3)
    assert {r["window"] for r in own.where("uniprot = 'P1' and position = 4").collect()} == {"MKRSPEA"}
    sites = spark.createDataFrame([("q", "MKRSPEA", "g1"), ("r", "AAAAAAA", "x")], "query string, window string, gene string")
    best, _ = sequences.map_sites(sites, fasta, {"window": 3, "max_mismatches": 1, "fdr": 1.0})
    got = {r["query"]: (r["uniprot"], r["mismatches"], r["status"]) for r in best.collect()}
    assert got["q"] == ("P1", 0, "exact") and got["r"][0] is None
    pssm = spark.createDataFrame([("K", 1, "P", 4.0), ("K", -1, "R", 2.0), ("L", 1, "P", 1.0)], "kinase string, offset int, aa string, value double")
    feats = spark.createDataFrame([("f", "_MKR*S*PEA_")], "feature string, kinase_sequence string")
    scores = sequences.score_kinases(feats, pssm)
    assert {r["kinase"]: r["score"] for r in scores.collect()} == {"K": 3.0, "L": 0.0}
    assert sequences.predict_kinases(scores, 1, "score").first()["kinases"] == ["K"]


def test_signalome(spark):
    rng = np.random.default_rng(4)
    shape = np.array([[0.9, 0.1, 0.2, 0.8], [0.1, 0.9, 0.7, 0.2]])
    rows = [(f"f{i:02d}", f"k{j}", float(np.clip(shape[i % 2, j] + rng.normal() * 0.03, 0, 1))) for i in range(20) for j in range(4)]
    scores = spark.createDataFrame(rows, "feature string, kinase string, score double")
    proteins = scores.select("feature").distinct().withColumn("protein", F.concat(F.lit("P"), (F.substring("feature", 2, 2).cast("int") % 4).cast("string")))
    out = signalome.build_signalome(scores, proteins, 0.5, 0.8, requested=2)
    got = {r["feature"]: r["cluster"] for r in out.clusters.collect()}
    assert len({got[f"f{i:02d}"] for i in range(0, 20, 2)}) == 1 and got["f00"] != got["f01"]
    assert {r["module"] for r in out.modules.collect()} == {1, 2} and out.edges.count() > 0 and out.expanded.count() > 0
    assert out.table.groupBy("module").agg(F.sum("percent").alias("p")).where("abs(p - 100) > 0.01").count() == 0


def test_qc_and_proteome(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], "sample string, x double")
    z = {r["sample"]: r["z"] for r in qc.robust_z(frame, "x", "z").collect()}
    assert z["b"] == 0 and z["c"] == pytest.approx(7 / 1.4826)
    nan = np.nan
    phospho = matrix(spark, np.array([[5.0, 6.0], [4.0, nan]]), ["x_A1", "x_B2"])
    prot = matrix(spark, np.array([[1.0, 2.0]]), ["y_A1_2", "y_B2_2"]).withColumn("feature", F.lit("P1"))
    feats = spark.createDataFrame([("f000", "P9;P1"), ("f001", "P7")], "feature string, protein_group_id string")
    out = {(r["feature"], r["sample"]): r["intensity"] for r in proteome.phospho_over_proteome(phospho, feats, prot).collect()}
    assert out == {("f000", "x_A1"): 4.0, ("f000", "x_B2"): 4.0}


def test_dose_response(spark):
    doses = [0.0, 1, 3, 10, 30, 100, 300, 1000]
    y = [1.0] + [2 - 1 / (1 + d / 30) for d in doses[1:]]
    rows = [("f", f"s{i}", math.log2(v * 7)) for i, v in enumerate(y)]
    samples = spark.createDataFrame([(f"s{i}", float(d), 0.0) for i, d in enumerate(doses)], "sample string, dose double, timepoint double")
    r = dose.fit_dose_response(spark.createDataFrame(rows, "feature string, sample string, intensity double"), samples).first()
    assert r["ec50"] == pytest.approx(30, rel=0.05) and r["r2"] > 0.99
    assert dose.recommend_pipeline(24, [12, 12], 0.2).test == "limma" and dose.recommend_pipeline(24, [3, 3], 0.2).min_valid_n == 3


PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_hamming_join_equals_brute_force(spark, tmp_path):
    """Accessions of every remainder are asked."""
    names = ["steel toy ring", "steel tay ring", "steal tay rung", "mossy yarn", "messy yarn", "t", "olive stone"]
    spark.createDataFrame([(i + 1, n, "b", "TYPE", 1, 1.0) for i, n in enumerate(names)], PARTS).write.parquet(f"{tmp_path}/part.parquet")
    texts = ["_" * 7 + (n + "TYPE").replace(" ", "").upper() + "_" * 7 for n in names]
    windows = {t[i - 7 : i + 8] for t in texts for i in range(7, len(t) - 7) if t[i] in "STY"}
    differ = {(a, b): sum(x != y for x, y in zip(a, b, strict=True)) for a in windows for b in windows if (a[7] == "Y") == (b[7] == "Y")}
    brute = sorted((a, b, d) for (a, b), d in differ.items() if d <= 2)
    assert any(d for _, _, d in brute)
    assert sorted(map(tuple, queries.hamming_join(spark, str(tmp_path)).collect())) == brute


def test_kinase_queries_take_all_components(spark, tmp_path):
    """What tells the sites apart lies behind the twelfth component."""
    rows = [(i, [0.01 * ((i + k * k) % 5) for k in range(13)] + [0.9 if i < 4 else 0.0, 0.8 if i < 4 else 0.1, 0.0 if i < 4 else 0.7]) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    met = {(r["source"], r["target"]): r["r"] for r in queries.kinase_network(spark, str(tmp_path)).collect()}
    assert len(met) == 16 * 15 // 2 and met["k13", "k15"] == pytest.approx(-1)
    best = {(r["feature"], r["rank"]): r["kinase"] for r in queries.topk_per_site(spark, str(tmp_path)).collect()}
    assert [best[0, 1], best[0, 2], best[7, 1], best[7, 2]] == ["k13", "k14", "k15", "k14"]
    assert {r["kinase"] for r in queries.module_table(spark, str(tmp_path)).collect()} == {"k13", "k14", "k15"}
    labels = {r["feature"]: r["cluster"] for r in queries.signalome_clusters(spark, str(tmp_path)).collect()}
    assert not {labels[i] for i in range(4)} & {labels[i] for i in range(4, 8)}


def test_tiered_match_asks_every_feature(spark, tmp_path):
    """The database's positions come from the price; parts of every remainder are asked and matched."""
    rows = [(k, "n", f"B{k % 3}", f"T{k // 5}", 3 + k, 902.0 + (k + 1) // 2) for k in range(1, 13)]
    spark.createDataFrame(rows, PARTS).write.parquet(f"{tmp_path}/part.parquet")
    proteins, genes = {(r[2], int(r[5]) % 50 + 1) for r in rows}, {(r[3], int(r[5]) % 50 + 1) for r in rows}
    tiers = {f"{b}|{t}|{'STY'[n % 3]}{n}|M1": "protein" if (b, n) in proteins else "gene" if (t, n) in genes else None for _, _, b, t, n, _ in rows}
    assert set(tiers.values()) == {"protein", "gene", None}
    assert {r["key"]: r["tier"] for r in queries.tiered_match(spark, str(tmp_path)).collect()} == {k: t for k, t in tiers.items() if t}


def test_ward_tree_equals_linkage():
    x = np.random.default_rng(5).normal(size=(90, 4))
    x[20:40] = x[3]  # repeated rows
    plain = dimred.linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), "ward")
    tree = dimred.ward_tree(x)
    assert tree[:, 2] == pytest.approx(plain[:, 2], abs=1e-7)
    assert all((dimred.cut_tree(tree, k) == dimred.cut_tree(plain, k)).all() for k in range(1, 12))


def test_small_cluster_among_many_sites(spark):
    """More sites than MAX_EXACT; the sites of the small cluster have the largest hashes."""
    ids = [r["id"] for r in spark.range(5100).orderBy(F.xxhash64("id")).collect()]
    small = set(ids[-6:])
    rows = [(i, k, 0.9 - i * 1e-6 if (i in small and k == "c") or (i not in small and k == "ab"[i % 2]) else 0.1) for i in ids for k in "abc"]
    out = {r["feature"]: r["cluster"] for r in signalome.cluster_sites(spark.createDataFrame(rows, "feature long, kinase string, score double"), 3).collect()}
    assert len(out) == 5100
    assert {out[i] for i in small}.isdisjoint(out[i] for i in ids[:-6])


def test_places_and_running_values(spark):
    """A sort over several partitions; ties, groups, nulls and an empty table."""
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i % 3}" if i % 7 else None, float(v)) for i, v in enumerate(rng.integers(0, 40, 300))]
    frame = spark.createDataFrame(rows, "i int, g string, v double").repartition(7)
    got = order.placed(frame, "v", "i").collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["place"])] == [i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))] and sorted(r["place"] for r in got) == list(range(1, 301))
    own = order.sums_so_far(order.placed(frame, "v", "i"), {"s": F.col("i")})
    total = 0
    for r in sorted(own.collect(), key=lambda r: r["place"]):
        total += r["i"]
        assert r["s"] == total
    back = order.least_from_here(order.placed(frame, "g", "v", "i"), "i", "least", ("g",)).collect()
    for r in back:
        assert r["least"] == min(q["i"] for q in back if q["g"] == r["g"] and q["place"] >= r["place"])
    assert order.placed(frame.limit(0), "v").count() == 0 and fdr.adjust(frame.limit(0), "v").count() == 0


def test_adjust_equals_the_plain_procedure(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], float(p)) for i, p in enumerate(np.round(rng.uniform(size=120) ** 2, 2))] + [(500, "a", None), (501, "b", float("nan"))]
    frame = spark.createDataFrame(rows, "i int, g string, p_value double").repartition(5)
    for method in ("bh", "by"):
        got = {r["i"]: r["fdr"] for r in fdr.adjust(frame, by=("g",), method=method).collect()}
        assert got[500] is None and got[501] is None
        for g in "ab":
            own = sorted((p, i) for i, h, p in rows if h == g and p is not None and p == p)
            n, least = len(own), 1.0
            c = sum(1 / k for k in range(1, n + 1)) if method == "by" else 1
            for k in range(n, 0, -1):
                least = min(least, own[k - 1][0] * n / k * c)
                assert abs(got[own[k - 1][1]] - least) < 1e-12


def test_libraries_are_emitted(spark, tmp_path):
    names = enrichment.PTM_DB_COLUMNS
    base = dict.fromkeys(names) | {"substrate_uniprot": "P", "residue": "S", "is_curated": True, "chemistry_warning_flag": False}
    rows = [base | {"position": i, "effect_canonical": "induces_ppi" if i % 2 else "odd", "ADB_disease_variant": "ClinVar" if i < 6 else None, "Ochoa_functional_score": float(i)} for i in range(24)]
    kinds = {"position": "int", "is_curated": "boolean", "chemistry_warning_flag": "boolean", "Ochoa_functional_score": "double", "curation_confidence": "double"}
    db = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    manifest = {(r["library"], r["set_name"]): r["n_sites"] for r in enrichment.emit_libraries(db, str(tmp_path)).collect()}
    assert manifest == {("FUNCTIONAL_EFFECT", "induces_ppi"): 12, ("DISEASE_VARIANT", "clinvar_site"): 6, ("FUNCTIONAL_SCORE_BIN", "ochoa_top_quartile"): 6, ("FUNCTIONAL_SCORE_BIN", "ochoa_bottom_quartile"): 6}
    lines = [line.split("\t") for line in spark.read.text(f"{tmp_path}/functional_effect.gmt").toPandas()["value"]]
    assert [(x[0], len(x) - 2) for x in lines] == [("induces_ppi", 12)] and lines[0][1] == enrichment.EFFECTS["induces_ppi"]


def test_wide_window_settles_between_paralogs(spark):
    """Two genes share the small window; the wide one tells them apart. Ends of proteins are not verified."""
    core = "AAKSGLL"
    human = [("H1", "G1", True, "WWWWWW" + core + "WWWWWW"), ("H2", "G2", True, "CDEFGH" + core + "IKLMNP"), ("H3", "G3", True, "MMCPSRHH")]
    fasta = spark.createDataFrame(human, "accession string, gene string, reviewed boolean, sequence string")
    source = spark.createDataFrame([("M1", "CDEFGW" + core + "IKLMNP"), ("M2", "MMCPSRHH")], "accession string, sequence string")
    sites = spark.createDataFrame([("a", core, "G1", "M1", 10, "S"), ("b", "MCPSRHH", "G3", "M2", 5, "S")], "query string, window string, gene string, protein string, site_position int, residue string")
    plain = {r["query"]: r["uniprot"] for r in sequences.map_sites(sites, fasta, {"window": 3, "max_mismatches": 0, "fdr": 1.0})[0].collect()}
    assert plain == {"a": "H1", "b": "H3"}
    got = {r["query"]: r for r in sequences.map_sites(sites, fasta, {"window": 3, "max_mismatches": 0, "fdr": 1.0, "verify_window": 6}, source)[0].collect()}
    assert (got["a"]["uniprot"], got["a"]["gene"], got["a"]["verification_mismatches"]) == ("H2", "G2", 1) and abs(got["a"]["verification_identity"] - 12 / 13) < 1e-12
    assert (got["b"]["uniprot"], got["b"]["verification_mismatches"], got["b"]["verification_identity"]) == ("H3", -1, None)
    with pytest.raises(ValueError):
        sequences.OrthologySettings.of({"verify_window": 7})


@pytest.mark.parametrize(("weights", "block_rows"), [("uniform", 7), ("distance", 4096)])
def test_knn_equals_brute_force(spark, weights, block_rows):
    """Gaps, ties, a sample without comparable donors; many small blocks give what one large one gives."""
    rng = np.random.default_rng(12)
    m = np.round(rng.normal(20, 2, (40, 6)), 1)
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:, 0] = np.where(np.isnan(m[:, 0]) & np.isnan(m[:, 1:]).all(axis=1), 20.0, m[:, 0])
    m[5] = m[9]
    rows = [(f"f{i:02d}", f"s{j}", None if np.isnan(m[i, j]) else float(m[i, j])) for i in range(40) for j in range(6)]
    frame = spark.createDataFrame(rows, "feature string, sample string, intensity double")
    got = {(r["feature"], r["sample"]): (r["intensity"], r["is_imputed"]) for r in impute.impute_knn(frame, frame.select("sample"), 3, weights, block_rows).collect()}
    assert len(got) == 240
    for i in range(40):
        for j in range(6):
            value, imputed = got[f"f{i:02d}", f"s{j}"]
            assert imputed == np.isnan(m[i, j])
            if not imputed:
                assert value == m[i, j]
                continue
            able = []
            for d in range(40):
                both = ~np.isnan(m[i]) & ~np.isnan(m[d])
                if not np.isnan(m[d, j]) and both.any():
                    able.append((math.sqrt(max(0.0, ((m[i] - m[d])[both] ** 2).sum()) * 6 / both.sum()), d))
            near = sorted((round(x, 9), d) for x, d in able)[:3]
            if not near:
                assert value == pytest.approx(np.nanmean(m[:, j]))
            elif len(able) > 3 and len({x for x, _ in sorted((round(x, 9), d) for x, d in able)[2:4]}) == 1:
                continue  # a tie at the end of the list
            elif weights == "distance":
                w = [float(x == 0) for x, _ in near] if near[0][0] < 1e-7 else [1 / x for x, _ in near]
                assert near[0][0] < 1e-7 or value == pytest.approx(sum(a * m[d, j] for a, (_, d) in zip(w, near, strict=True)) / sum(w), abs=1e-6)
            else:
                assert value == pytest.approx(np.mean([m[d, j] for _, d in near]))


def test_settings_and_helpers(spark):
    from quantloom import schema
    from quantloom.operators import figures

    assert schema.PcaSettings.of({"n_components": 3}).n_components == 3 and schema.TsneSettings.of().perplexity == 30.0
    for bad in ({"n_components": 0}, {"n_components": True}, {"nothing": 1}):
        with pytest.raises(ValueError):
            schema.PcaSettings.of(bad)
    with pytest.raises(ValueError):
        schema.TsneSettings.of({"perplexity": 0.0})
    assert [figures.plot_width(n) for n in (1, 6, 7, 12, 13, 99)] == [600, 600, 900, 900, 1200, 1800]
    assert figures.should_show_points([3, 99]) and not figures.should_show_points([3, 100]) and not figures.should_show_points([])
    rows = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", None)], "sample string, condition string")
    assert figures.group_order(rows, "condition") == ["x", "y"] and figures.group_order(rows, "condition", ["y", "z", "x"]) == ["y", "x"]


def test_selection_of_modules_is_recorded(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(3, 12))
    rows = [(f"s{i:02d}", f"k{j:02d}", float(centres[i % 3, j] + 0.01 * rng.normal())) for i in range(30) for j in range(12)]
    found = signalome.clustering(spark.createDataFrame(rows, "feature string, kinase string, score double"))
    labels = {r["feature"]: r["cluster"] for r in found.clusters.collect()}
    picked = found.selection
    assert picked.reason == "primary" and picked.mode == "exact" and picked.n_sites == 30 and len(found.tree) == 29
    assert picked.candidates[picked.module_count].mean == max(c.mean for c in picked.candidates.values()) and picked.module_count >= 3
    homes = {}
    for site, label in labels.items():
        homes.setdefault(label, set()).add(int(site[1:]) % 3)
    assert all(len(h) == 1 for h in homes.values()) and picked.candidates[3].n_singletons == 0 and picked.candidates[3].least > 0.9


def test_pair_sums_with_gaps(spark):
    """Correlations and distances over what both samples have; a pair that shares nothing; whole-number samples."""
    rng = np.random.default_rng(14)
    m = rng.normal(10, 2, (60, 5))
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:30, 3], m[30:, 4] = np.nan, np.nan
    rows = [(i, j, float(m[i, j])) for i in range(60) for j in range(5) if not np.isnan(m[i, j])]
    frame = spark.createDataFrame(rows, "feature int, sample int, intensity double").repartition(6)
    r = {(x["sample_a"], x["sample_b"]): (x["n_shared"], x["r"]) for x in qc.replicate_correlation(frame, 3).collect()}
    for metric in ("euclidean", "correlation", "cosine"):
        d = {(x["sample_a"], x["sample_b"]): x["distance"] for x in dimred.sample_distance(frame, metric).collect()}
        for i in range(5):
            for j in range(i + 1, 5):
                both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
                x, y = m[both, i], m[both, j]
                if not both.any():
                    assert (i, j) not in d and (i, j) not in r
                    continue
                expected = {"euclidean": math.sqrt(((x - y) ** 2).mean()), "correlation": 1 - np.corrcoef(x, y)[0, 1], "cosine": 1 - x @ y / math.sqrt((x @ x) * (y @ y))}
                assert d[i, j] == pytest.approx(expected[metric], abs=1e-9) and r[i, j][0] == both.sum() and r[i, j][1] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert qc.replicate_correlation(frame.limit(0)).count() == 0


def test_knn_ties_and_panels():
    """Copies, zeros and many gaps: panels in any order give the nearest donors, of equal ones those with the smallest places."""
    rng = np.random.default_rng(15)
    x = np.tile(np.round(rng.normal(17, 1, (60, 6)), 1), (10, 1))
    x[rng.random(x.shape) < 0.1] = 0
    x[rng.random(x.shape) < 0.4] = np.nan
    wanted, places = x[np.isnan(x).any(axis=1)][:150], rng.permutation(len(x))
    found = impute.Neighbours(wanted, 3)
    for panel in np.array_split(np.arange(len(x)), 4):
        found.meet(x[panel], places[panel])
    got = found.filled("uniform", np.full(6, -1.0))
    for i, w in enumerate(wanted):
        both = ~np.isnan(w - x)
        with np.errstate(invalid="ignore", divide="ignore"):
            square = np.where(both.any(axis=1), (np.where(both, w - x, 0.0) ** 2).sum(axis=1) * 6 / both.sum(axis=1), np.inf)
        for j in np.flatnonzero(np.isnan(w)):
            able = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(square))
            near = able[np.lexsort((places[able], square[able]))[:3]]
            assert got[i, j] == (pytest.approx(x[near, j].mean()) if len(near) else -1)


def test_knn_deals_few_bytes(spark):
    """The donors are not shuffled once for each block of features with gaps."""
    rng = np.random.default_rng(16)
    m = rng.normal(20, 2, (3000, 6))
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:, 0] = np.where(np.isnan(m).all(axis=1), 20.0, m[:, 0])
    rows = [(i, f"s{j}", float(m[i, j])) for i in range(3000) for j in range(6) if not np.isnan(m[i, j])]
    frame = spark.createDataFrame(rows, "feature int, sample string, intensity double")
    written = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = written()
    assert impute.impute_knn(frame, frame.select("sample"), 3, block_rows=50).where("intensity is not null").count() == 18000
    assert written() - before < 4e6


def test_percentile_by_buckets(spark):
    rng = np.random.default_rng(17)
    for x in (rng.normal(size=501), np.r_[np.zeros(300), rng.normal(1e6, 1, 200)], np.ones(7), np.array([3.0]), np.array([1.0, 1, 1, 9])):
        frame = spark.createDataFrame([(float(v),) for v in [*x]] + [(None,)], "x double")
        for share in (0.0, 0.3, 0.5986, 1.0):
            assert order.value_at(frame, share, buckets=4, few=2) == pytest.approx(np.percentile(x, 100 * share), abs=1e-12)
    assert order.value_at(frame.limit(0), 0.3) is None


def test_hybrid_deals_few_bytes(spark):
    """Strategies follow the features' means; neither the cells nor their percentile are shuffled again after the search."""
    rng = np.random.default_rng(18)
    m = rng.normal(20, 2, (3000, 6)) + rng.normal(0, 3, (3000, 1))
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:, 0] = np.where(np.isnan(m).all(axis=1), 20.0, m[:, 0])
    rows = [(i, f"s{j}", float(m[i, j])) for i in range(3000) for j in range(6) if not np.isnan(m[i, j])]
    frame = spark.createDataFrame(rows, "feature int, sample string, intensity double")
    out = impute.impute_hybrid(frame, frame.select("sample"), n_neighbors=3)
    got = {(r["feature"], r["sample"]): (r["intensity"], r["strategy"]) for r in out.collect()}
    low = np.nanmean(m, axis=1) < np.nanpercentile(m, 30)
    assert len(got) == 18000 and all(got[i, f"s{j}"][1] == ("observed" if not np.isnan(m[i, j]) else "gaussian" if low[i] else "knn") for i in range(3000) for j in range(6))
    assert all(got[i, f"s{j}"][0] == m[i, j] for i in range(3000) for j in range(6) if not np.isnan(m[i, j]))
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().toString()) and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("density", [0.02, 0.6])
def test_moments_of_many_tiles(spark, density, monkeypatch):
    """Small tiles and slices, few or many cells: the sums of all pairs that share features, and no row for others."""
    from quantloom.operators import matrix as tiles

    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "TILES", 2)
    monkeypatch.setattr(tiles, "SLICE_CELLS", 64)
    rng = np.random.default_rng(19)
    m = rng.normal(10, 2, (200, 40))
    m[rng.random(m.shape) >= density] = np.nan
    rows = [(i, j, float(m[i, j])) for i in range(200) for j in range(40) if not np.isnan(m[i, j])]
    got = {(r["sample_a"], r["sample_b"]): tuple(r)[2:] for r in tiles.sample_moments(spark.createDataFrame(rows, "feature int, sample int, intensity double")).collect()}
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            x, y = m[both, i], m[both, j]
            if not both.any():
                assert (i, j) not in got
                continue
            assert got[i, j] == pytest.approx((both.sum(), x.sum(), y.sum(), x @ x, y @ y, x @ y))
