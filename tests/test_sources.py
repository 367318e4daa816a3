import pytest

from quantloom.sources import fasta, reports


def test_spectronaut_report(spark, tmp_path):
    path = tmp_path / "r.tsv"
    head = ["R.FileName", "PG.ProteinGroups", "PG.Genes", "PEP.PeptidePosition", "EG.PrecursorId", "EG.PTMAssayProbability", "EG.PTMLocalizationProbabilities", "EG.TotalQuantity_(Settings)", "EG.IsDecoy", "EG.Qvalue", "Other"]
    rows = [["a", "P1", "G", "3", "_S_.2", "0.9", "", "5", "False", "0.001", "x"], ["a", "Cont_P2;P2", "G", "3", "_S_.2", "0.9", "", "5", "False", "", "x"], ["a", "Cont_P2", "G", "3", "_S_.2", "0.9", "", "5", "False", "0.2", "x"], ["a", "P3", "G", "3", "_S_.2", "0.9", "", "5", "True", "0.2", "x"]]
    path.write_text("\n".join("\t".join(r) for r in [head, *rows]) + "\n")
    out = reports.read_spectronaut(spark, str(path))
    assert "Other" not in out.columns and "EG.TotalQuantity (Settings)" in out.columns and out.count() == 2
    assert reports.read_spectronaut(spark, str(path), {"qvalue_max": 0.01}).count() == 1
    with pytest.raises(ValueError, match="lacks"):
        bad = tmp_path / "b.tsv"
        bad.write_text("x\ty\n1\t2\n")
        reports.read_spectronaut(spark, str(bad))
    with pytest.raises(ValueError, match="suffix"):
        reports.read_any(spark, "x.xlsx")


def test_diann_conversion(spark):
    raw = spark.createDataFrame(
        [("/d/run.raw", "AAS(UniMod:21)PLK", 2, 10.0, "[P1:S12]", 0.9, "G", "P1", "AAS(UniMod:21){0.95}PLK2"), ("/d/run.raw", "AASPLK", 2, 10.0, "[P1:S12]", 0.9, "G", "P1", "")],
        "Run string, `Modified.Sequence` string, `Precursor.Charge` int, `Precursor.Quantity` double, `Protein.Sites` string, `PTM.Site.Confidence` double, Genes string, `Protein.Group` string, `Site.Occupancy.Probabilities` string",
    )
    row = reports.diann_to_psm(raw).first()
    assert (row["R.FileName"], row["EG.PrecursorId"], row["PEP.PeptidePosition"]) == ("run", "_AAS[Phospho (STY)]PLK_.2", "10")
    assert row["EG.PTMLocalizationProbabilities"].startswith("_AAS[Phospho (STY): 95")


def test_fragpipe(spark, tmp_path):
    head = [*reports.FRAGPIPE_META, "x/s1_uncalibrated.mzML", "s2"]
    rows = [["P1_S77", "G", "P1", "PEP", "KAGTRTDsREDEIsP", "1", "0.9", "", "", "8", "0"], ["P1_T80", "G", "P1", "PEP", "", "1", "0.5", "", "", "8", "4"]]
    path = tmp_path / "s.tsv"
    path.write_text("\n".join("\t".join(r) for r in [head, *rows]) + "\n")
    out = reports.read_fragpipe_sites(spark, str(path))
    assert sorted((r["feature"], r["sample"], r["intensity"]) for r in out.measure.collect()) == [("P1|G|S77|M1", "s1", 3.0), ("P1|G|S77|M1", "s2", None)]
    assert out.features.first()["kinase_sequence"] == "_KAGTRTD*S*REDEISP_"


def test_proteome_tables(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("PG.ProteinGroups\tPG.Genes\t[1] run.raw.PG.Quantity\t[2] other.raw.PG.Quantity\r\nP1\tG\t4\tNaN\r\n")
    measure, meta = reports.read_spectronaut_short(spark, str(path))
    assert sorted((r["sample"], r["intensity"]) for r in measure.collect()) == [("other", None), ("run", 2.0)] and meta.columns == ["feature", "PG.Genes"]
    assert reports.detect_report_format(["PG.ProteinGroups", "[1] run.raw.PG.Quantity"]).shape == "short"
    assert reports.detect_report_format(["Run", "Precursor.Id", "Protein.Group"]) == reports.ReportFormat("diann", "long")
    assert reports.detect_report_format(["Protein.Group", "Genes", "a.raw"]) == reports.ReportFormat("diann", "short")
    assert reports.detect_report_format(["R_FileName", "PG_ProteinGroups"]) == reports.ReportFormat("spectronaut", "long")


def test_channels_and_queue(spark, tmp_path):
    frame = spark.createDataFrame([("_A[Lys8]_",), ("_A_",), ("_A[Arg6]K[Lys4]_",)], "`FG.Id` string")
    assert [r[0] for r in frame.select(reports.derive_channel(reports.F.col("`FG.Id`"))).collect()] == ["heavy", "light", "medium"]
    assert reports.detect_multichannel(frame) == ["Arg6", "Lys4", "Lys8"]
    with pytest.raises(Exception, match="several channels"):
        spark.createDataFrame([("[Lys8][Arg6]",)], "s string").select(reports.derive_channel(reports.F.col("s"))).collect()
    path = tmp_path / "q.csv"
    path.write_text("Bracket Type=4\nFile Name,Path,Instrument Method,Position\nx1,p,m,A1\nBlank_2,p,m,A2\nx3,p,m,A3\n")
    assert [(r["sample"], r["injection_order"]) for r in reports.load_acquisition_queue(spark, str(path)).collect()] == [("x1", 1), ("x3", 3)]


def test_fasta_and_gmt(spark, tmp_path):
    path = tmp_path / "f.fasta"
    path.write_text(">sp|P1|A_HUMAN x GN=AKT1 PE=1\nMKS\nTY\n>P2 other\nAAA\n")
    got = {r["accession"]: r for r in fasta.load_fasta(spark, str(path)).collect()}
    assert got["P1"]["sequence"] == "MKSTY" and got["P1"]["gene"] == "AKT1" and got["P1"]["reviewed"] and got["P2"]["sequence"] == "AAA"
    sites = spark.createDataFrame([("Cont_P1-2", 3, "S"), ("P1", 9, "S"), ("none", 1, "S"), ("P1", 1, "S")], "protein_group_id string, site_position int, residue string")
    out = {(r["protein_group_id"], r["site_position"]): r["kinase_sequence"] for r in fasta.add_windows(sites, fasta.load_fasta(spark, str(path)), 3).collect()}
    assert out[("Cont_P1-2", 3)] == "__MK*S*TY__" and out[("P1", 9)].startswith("POSITION_ERROR") and out[("none", 1)].startswith("FASTA_ERROR") and out[("P1", 1)].startswith("SEQUENCE_MISMATCH")
    gmt = tmp_path / "lib.gmt"
    gmt.write_text("# c\nset\tdesc\tA\tB\nshort\tx\n")
    assert sorted((r["library"], r["set_name"], r["member"]) for r in fasta.load_gmt(spark, str(gmt)).collect()) == [("lib", "set", "A"), ("lib", "set", "B")]


def test_package_and_dashboard(spark, tmp_path):
    from quantloom.sources import package

    wide = spark.createDataFrame([("P1|G|S3|M1", 1.0, float("nan")), ("P2|H|T4|M2", 2.0, 3.0)], "key string, a double, b double")
    meta = spark.createDataFrame([("P1|G|S3|M1", "_AAK*S*P____")], "key string, kinase_sequence string")
    out = package.package_matrix(wide, "key", meta=meta)
    got = {r["feature"]: (r["gene"], r["n_samples_detected"], r["is_proline_directed"]) for r in out.features.collect()}
    assert got == {"P1|G|S3|M1": ("G", 1, True), "P2|H|T4|M2": ("H", 2, None)}
    with pytest.raises(ValueError, match="numeric"):
        package.package_matrix(wide.withColumn("c", reports.F.lit("x")), "key")
    package.dashboard(spark, out, str(tmp_path / "d"))
    assert "Residues" in spark.read.text(str(tmp_path / "d"), wholetext=True).first()[0]
