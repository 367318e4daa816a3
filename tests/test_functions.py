import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import fdr, keys, special
from quantloom.functions import peptides as P
from quantloom.schema import CollapseSettings, DiannSettings, resolve_quant_column


def values(spark, text, *columns):
    return spark.createDataFrame([(text,)], "s string").select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("text", "clean", "n", "positions", "mods"),
    [
        ("_AS[Phospho (STY)]C[Carbamidomethyl (C)]T[Phospho (STY)]K_.2", "ASCTK", 2, [2, 4], ["Phospho (STY)", "Carbamidomethyl (C)", "Phospho (STY)"]),
        ("_S[Phospho (STY)]TS[Phospho (STY)]K_.3", "STSK", 2, [1, 3], ["Phospho (STY)"] * 2),
        ("_PEPTIDE_.2", "PEPTIDE", 0, None, []),
        ("*.PS[Phospho (STY)]T.*", "PST", 1, [2], ["Phospho (STY)"]),
        ("AB", "AB", 0, None, []),
    ],
)
def test_modified_sequences(spark, text, clean, n, positions, mods):
    c = F.col("s")
    assert list(values(spark, text, P.clean_sequence(c), P.phospho_count(c), P.phospho_positions(c), P.modifications(c))) == [clean, n, positions, mods]


@pytest.mark.parametrize(
    ("text", "cells"),
    [
        ("_PVS[Phospho (STY): 92.3%]PS[Phospho (STY): 7.6%]_", [(3, 0.923), (5, 0.076)]),
        ("_AS[Phospho (STY): 56.9%]C[Carbamidomethyl (C): 100%]PT[Phospho (STY): 43.1%]K_", [(2, 0.569), (5, 0.431)]),
        ("_AS[Phospho (STY)]K_", []),
        ("_AS[Phospho (STY): 50%", []),
        ("", []),
    ],
)
def test_localization(spark, text, cells):
    got = values(spark, text, P.localization(F.col("s")))[0]
    assert [(c["pos"], round(c["prob"], 9)) for c in got] == cells


def test_top_positions(spark):
    c = F.col("s")
    text = "_AS[Phospho (STY): 50%]T[Phospho (STY): 50%]Y[Phospho (STY): 20%]_"
    assert values(spark, text, P.top_positions(P.localization(c), F.lit(2)))[0] == [2, 3]
    assert values(spark, text, P.is_top_n(F.lit("_AS[Phospho (STY)]TY_.2"), c), P.is_top_n(F.lit("_ASTY[Phospho (STY)]_.2"), c), P.is_top_n(F.lit("_ASTY_.2"), c))[0:3] == (True, False, True)


@pytest.mark.parametrize(("text", "position"), [("12,40;7", 12), (" 473 ", 473), ("None", None), ("", None), (None, None)])
def test_first_position(spark, text, position):
    assert values(spark, text, P.first_position(F.col("s")))[0] == position


def test_diann_strings(spark):
    c = F.col("s")
    assert values(spark, "AC(UniMod:4)AS(UniMod:21)PLK", P.diann_precursor(c, F.lit(2)))[0] == "_ACAS[Phospho (STY)]PLK_.2"
    got = values(spark, "AAS(UniMod:21){1.000000}LPT{0.848000}K2", P.diann_localization(c))[0]
    assert [(x["pos"], round(x["prob"], 9)) for x in got] == [(3, 1.0), (6, 0.848)]
    sites = "[Q16828:S331];[Q16829:C3,S369]"
    assert list(values(spark, sites, P.first_site_position(c), P.first_site_position(c, F.lit("Q16829")), P.first_site_position(c, F.lit("none")))) == [331, 369, None]
    assert values(spark, "[P12345:S100]", P.diann_start(F.lit("AAS(UniMod:21)PLK"), c))[0] == 98
    assert values(spark, r"V:\raw\x\run.1.raw", P.run_name(c))[0] == "run.1"


def test_keys(spark):
    c = F.col("s")
    assert values(spark, "P1;P2|AKT1|S473|M1", keys.canonical_id(c), keys.key_gene(c), keys.site_label(c))[0:3] == ("P1_S473", "AKT1", "AKT1 S473")
    assert values(spark, "x", keys.full_key(c, F.lit("g"), F.lit("S"), F.lit("5"), F.lit("bad")), keys.parse_key(c))[0:2] == ("Error_key", None)
    assert values(spark, "P05783;Cont_P05783", keys.leading_protein(c), keys.is_contaminant_tagged(c))[0:2] == ("Cont_P05783", True)
    m = keys.motif(c)
    assert list(values(spark, "_RRRASVA*S*PDE____", m["p_minus_1"], m["p_plus_1"], m["is_proline_directed"], m["is_basophilic"], m["is_acidic_motif"])) == ["A", "P", True, True, True]
    assert list(values(spark, "POSITION_ERROR: 3", m["p_plus_1"], m["is_proline_directed"])) == [None, None]


def test_short_key_collisions(spark):
    frame = spark.createDataFrame([("k", "b"), ("k", "a"), ("j", "c")], "short_key string, full_key string")
    assert sorted((r["full_key"], r["short_key"]) for r in keys.resolve_collisions(frame).collect()) == [("a", "k"), ("b", "k#2"), ("c", "j")]


def test_distribution_functions():
    assert special.t_sf2(2.0, 10)[()] == pytest.approx(0.07338803, abs=1e-8) and special.t_sf2(1.96, np.inf)[()] == pytest.approx(0.0499958, abs=1e-7)
    assert special.f_sf(4.0, 2, 10)[()] == pytest.approx((1 + 2 * 4 / 10) ** -5, abs=1e-10) and special.chi2_sf(5.991465, 2)[()] == pytest.approx(0.05, abs=1e-7)
    assert special.beta_ppf(0.5, 2, 2)[()] == pytest.approx(0.5) and special.beta_cdf(0.3, 1, 3)[()] == pytest.approx(1 - 0.7**3)
    assert special.digamma(1.0)[()] == pytest.approx(-0.5772156649) and special.trigamma(1.0)[()] == pytest.approx(math.pi**2 / 6)
    assert float(special.trigamma(special.inverse_trigamma(0.7))) == pytest.approx(0.7)
    assert special.fisher_exact(10, 10, 20, 60) == pytest.approx(0.0503, abs=2e-2) and special.fisher_exact(3, 0, 0, 3) == pytest.approx(0.1)


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04]
    frame = spark.createDataFrame([(i, v, "g") for i, v in enumerate([*p, None, float("nan")])], "i int, p_value double, g string")
    got = {r["i"]: r["fdr"] for r in fdr.adjust(frame, by=("g",)).collect()}
    order = np.argsort(p, kind="stable")
    expected = np.minimum.accumulate((np.array(p)[order] * 5 / np.arange(1, 6))[::-1])[::-1]
    assert [got[i] for i in order] == pytest.approx(expected.tolist()) and got[5] is None and got[6] is None
    by = {r["i"]: r["fdr"] for r in fdr.adjust(frame, by=("g",), method="by").collect()}
    assert by[0] == pytest.approx(min(1, got[0] * sum(1 / k for k in range(1, 6))))


def test_settings():
    with pytest.raises(ValueError, match="unknown setting"):
        CollapseSettings.of({"cutof": 0.5})
    with pytest.raises(ValueError):
        DiannSettings.of({"quality_min": True})
    with pytest.raises(ValueError):
        CollapseSettings.of({"cutoff": 2.0})
    assert resolve_quant_column(["FG.MS1Quantity", "EG.TotalQuantity (Settings)"], level="MS2") == "EG.TotalQuantity (Settings)"
    with pytest.raises(ValueError, match="tried"):
        resolve_quant_column(["x"])
