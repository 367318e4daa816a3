"""Kinase scores of sequence windows and mapping of sites between species."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.order import least_from_here, placed, sums_so_far

from quantloom.operators.enrichment import gsea, ora
from quantloom.schema import Settings


def window_residues(frame: DataFrame, sequence: str = "kinase_sequence") -> DataFrame:
    """The frame's rows once for each residue around the marked one: offset (negative to the left) and aa."""
    pattern = r"^_?([A-Z_]*)\*([A-Za-z])\*([A-Z_]*?)_?$"
    left, right = F.regexp_extract(sequence, pattern, 1), F.regexp_extract(sequence, pattern, 3)
    before = F.transform(F.split(F.reverse(left), ""), lambda c, i: F.struct((-i - 1).alias("offset"), c.alias("aa")))
    after = F.transform(F.split(right, ""), lambda c, i: F.struct((i + 1).alias("offset"), c.alias("aa")))
    centre = F.array(F.struct(F.lit(0).alias("offset"), F.upper(F.regexp_extract(sequence, pattern, 2)).alias("aa")))
    cells = F.filter(F.concat(before, centre, after), lambda c: ~c["aa"].isin("", "_"))
    return frame.where(F.col(sequence).rlike(pattern)).withColumn("_c", F.explode(cells)).select("*", F.col("_c.offset").cast("int").alias("offset"), F.col("_c.aa").alias("aa")).drop("_c")


def score_kinases(features: DataFrame, pssm: DataFrame, digits: int = 3) -> DataFrame:
    """feature, kinase, score: sums of log2 of the matrix values. pssm: kinase, offset, aa, value, and optionally pool.

    A matrix has some hundreds of kinases times fifteen places; it is joined on (offset, aa).
    """
    cells = window_residues(features.select("feature", "kinase_sequence"))
    own = cells.where("offset <> 0").join(pssm.select("kinase", "offset", "aa", "value"), ["offset", "aa"])
    return own.groupBy("feature", "kinase").agg(F.bround(F.sum(F.log2("value")), digits).alias("score"))


def score_percentiles(scores: DataFrame, background: DataFrame) -> DataFrame:
    """Adds the share (0 to 100) of a kinase's background scores that are not larger."""
    rows = scores.select("feature", "kinase", "score", F.lit(1).alias("own")).unionByName(background.select(F.lit(None).cast(scores.schema["feature"].dataType).alias("feature"), "kinase", "score", F.lit(0).alias("own")))
    upto = W.partitionBy("kinase").orderBy("score").rangeBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(1 - F.col("own")).over(W.partitionBy("kinase"))
    return rows.withColumn("percentile", F.try_divide(100.0 * F.sum(1 - F.col("own")).over(upto), n)).where("own = 1").drop("own")


def predict_kinases(scores: DataFrame, top_k: int = 5, metric: str = "percentile") -> DataFrame:
    """feature, kinases, values: the best kinases of each site, ties by name."""
    rank = F.row_number().over(W.partitionBy("feature").orderBy(F.col(metric).desc(), "kinase"))
    own = scores.where(F.col(metric).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= top_k)
    cells = F.array_sort(F.collect_list(F.struct("rank", "kinase", F.col(metric).alias("value"))))
    return own.groupBy("feature").agg(cells.alias("c")).select("feature", F.transform("c", lambda c: c["kinase"]).alias("kinases"), F.transform("c", lambda c: c["value"]).alias("values"))


def substrate_sets(scores: DataFrame, threshold: float = 90, metric: str = "percentile") -> DataFrame:
    return scores.where(F.col(metric) >= threshold).select(F.lit("kinases").alias("library"), F.col("kinase").alias("set_name"), F.col("feature").alias("member"))


def kinase_enrichment(result: DataFrame, scores: DataFrame, lfc: float = 0.585, fdr: float = 0.05, threshold: float = 90) -> DataFrame:
    """ORA of predicted substrates among up and down sites, apart."""
    sets, background = substrate_sets(scores, threshold), result.select("feature").distinct()
    parts = []
    for side, hit in (("up", F.col("log2fc") >= lfc), ("down", F.col("log2fc") <= -lfc)):
        hits = result.where(hit & (F.col("fdr") <= fdr)).select("feature").distinct()
        parts.append(ora(hits, background, sets, 1, 0, "greater").withColumn("hit_direction", F.lit(side)))
    return parts[0].unionByName(parts[1])


def kinase_enrichment_binary(foreground: DataFrame, background: DataFrame, scores: DataFrame, threshold: float = 90) -> DataFrame:
    both = foreground.select("feature").unionByName(background.select("feature")).distinct()
    return ora(foreground.select("feature"), both, substrate_sets(scores, threshold), 1, 0)


def kinase_mea(result: DataFrame, scores: DataFrame, rank_col: str = "log2fc", threshold: float = 90, n_permutations: int = 1000, seed: int = 42) -> DataFrame:
    ranked = result.groupBy("feature").agg(F.max_by(rank_col, F.struct(F.abs(rank_col), F.col(rank_col))).alias("stat"))
    return gsea(ranked, substrate_sets(scores, threshold), 1, 1 << 30, n_permutations, seed)


# ---- mapping between species


@dataclass(frozen=True)
class OrthologySettings(Settings):
    window: int = 7
    max_mismatches: int = 2
    fdr: float = 0.01
    decoy_seed: int = 42
    max_genes: int = 3
    verify_window: int | None = None

    def __post_init__(self):
        self._fraction("fdr")
        if self.verify_window is not None and self.verify_window <= self.window:
            raise ValueError("verify_window must be wider than window")
        if self.window < 1 or not 0 <= self.max_mismatches <= 2 * self.window:
            raise ValueError("window or max_mismatches out of range")


def phospho_windows(fasta: DataFrame, size: int = 7) -> DataFrame:
    """window, uniprot, gene, position, residue, reviewed: around every S, T and Y of every protein."""
    padded = F.concat(F.lit("_" * size), F.col("sequence"), F.lit("_" * size))
    places = F.filter(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.substr(F.col("sequence"), i, F.lit(1)).isin("S", "T", "Y"))
    own = fasta.where(F.length("sequence") > 0).withColumn("position", F.explode(places))
    return own.select(F.substr(padded, F.col("position"), F.lit(2 * size + 1)).alias("window"), F.col("accession").alias("uniprot"), "gene", "position", F.substr("sequence", F.col("position"), F.lit(1)).alias("residue"), "reviewed")


def decoy_proteins(fasta: DataFrame, seed: int = 42) -> DataFrame:
    """Every protein's residues other than S, T, Y in an order by hash; S, T, Y stay where they are."""
    letters = F.split("sequence", "")
    cells = F.transform(letters, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    free = F.filter(cells, lambda c: ~c["c"].isin("S", "T", "Y", ""))
    turned = F.transform(F.array_sort(F.transform(free, lambda c: F.struct(F.xxhash64(F.lit(seed), F.col("accession"), c["i"]).alias("h"), c["c"].alias("c")))), lambda c: c["c"])
    own = fasta.withColumn("_free", F.transform(free, lambda c: c["i"])).withColumn("_turned", turned)
    # the k-th free place takes the k-th turned letter
    table = F.map_from_arrays("_free", "_turned")
    sequence = F.array_join(F.transform(letters, lambda c, i: F.coalesce(F.try_element_at(table, i), c)), "")
    return own.withColumn("sequence", sequence).drop("_free", "_turned")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d)


def fuzzy_join(queries: DataFrame, index: DataFrame, size: int = 7, max_mismatches: int = 2) -> DataFrame:
    """Pairs of windows with at most max_mismatches differences and centres of one class (S and T, or Y).

    Pigeonhole: such windows agree in one of max_mismatches + 1 segments, so segments are joined by equality.
    """
    n = max_mismatches + 1
    length = 2 * size + 1
    cuts = [length * i // n for i in range(n + 1)]
    segments = lambda w: F.array(*(F.concat(F.lit(f"{i}:"), F.substr(F.col(w), F.lit(cuts[i] + 1), F.lit(cuts[i + 1] - cuts[i]))) for i in range(n)))
    q = queries.select("query", F.col("window").alias("qw")).withColumn("_s", F.explode(segments("qw")))
    t = index.select(F.col("window").alias("tw"), "uniprot", "gene", "position", "residue", "reviewed").withColumn("_s", F.explode(segments("tw")))
    middle = lambda w: F.substr(F.col(w), F.lit(size + 1), F.lit(1)) == "Y"
    met = q.join(t, "_s").where(middle("qw") == middle("tw")).withColumn("mismatches", hamming(F.col("qw"), F.col("tw"))).where(F.col("mismatches") <= max_mismatches)
    return met.drop("_s").distinct()


def target_decoy_q(matches: DataFrame, score: str = "mismatches", tie: str = "query") -> DataFrame:
    """Adds q_value: the least share of decoys to targets among all matches up to this score. matches: one row per query, is_decoy."""
    own = placed(matches, score, tie, place="_place")
    own = sums_so_far(own, {"_d": F.col("is_decoy").cast("int"), "_t": (~F.col("is_decoy")).cast("int")}, "_place")
    own = own.withColumn("_f", F.least(F.lit(1.0), F.col("_d") / F.greatest(F.col("_t"), F.lit(1))))
    return least_from_here(own, "_f", "q_value", place="_place").drop("_d", "_t", "_f", "_place", "_piece")


def wide_window(sequence: Column, position: Column, residue: Column, size: int) -> Column:
    """The residues around a position; null at a protein's ends and where the residue is another one."""
    inside = (position > size) & (position + size <= F.length(sequence)) & (F.substr(sequence, position, F.lit(1)) == residue)
    return F.when(inside, F.substr(sequence, position - size, F.lit(2 * size + 1)))


def verify_matches(best: DataFrame, near: DataFrame, sites: DataFrame, source_fasta: DataFrame, target_fasta: DataFrame, size: int) -> DataFrame:
    """best with the paralog that agrees most over the wide window, `verification_mismatches` (-1: not verified) and `verification_identity`.

    A site is verified if its own and its first match's wide windows are whole. Of equal paralogs the first match stays.
    sites: query, protein, site_position, residue.
    """
    own = sites.select("query", F.col("protein").alias("accession"), F.col("site_position").cast("int").alias("_p"), F.col("residue").alias("_r"))
    own = own.join(source_fasta.select("accession", "sequence"), "accession").select("query", wide_window(F.col("sequence"), F.col("_p"), F.col("_r"), size).alias("_source")).where("_source is not null")
    cells = near.select("query", "uniprot", "gene", F.col("position").cast("int").alias("position"), "residue").distinct()
    cells = cells.join(target_fasta.select(F.col("accession").alias("uniprot"), "sequence"), "uniprot").withColumn("_wide", wide_window(F.col("sequence"), F.col("position"), F.col("residue"), size)).drop("sequence")
    first = best.select("query", F.col("uniprot").alias("_u"), F.col("position").cast("int").alias("_n"))
    met = cells.where("_wide is not null").join(own, "query").join(first, "query")
    met = met.withColumn("_mm", hamming(F.col("_source"), F.col("_wide"))).withColumn("_first", (F.col("uniprot") == F.col("_u")) & (F.col("position") == F.col("_n")))
    met = met.where(F.col("_first") | (F.col("uniprot") != F.col("_u")))
    rank = F.struct("_mm", (~F.col("_first")).cast("int").alias("other"), "gene", "uniprot", "position", "residue")
    won = met.groupBy("query").agg(F.min(rank).alias("_w"), F.max("_first").alias("_seen")).where("_seen").drop("_seen")
    out = best.join(won, "query", "left")
    replaced = {c: F.coalesce(F.col(f"_w.{c}").cast(best.schema[c].dataType), F.col(c)) for c in ("uniprot", "gene", "position", "residue")}
    out = out.withColumns(replaced).withColumn("verification_mismatches", F.coalesce(F.col("_w._mm"), F.lit(-1)))
    return out.withColumn("verification_identity", F.when(F.col("_w._mm").isNotNull(), 1 - F.col("_w._mm") / (2 * size + 1))).drop("_w")


def map_sites(sites: DataFrame, target_fasta: DataFrame, advanced: dict | None = None, source_fasta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(best match of each site with status and q value, all matching paralogs). sites: query, window, gene.

    With verify_window and the source proteins (and protein, site_position, residue of sites) matches are verified over a wider window.

    Of equally near targets: the same gene, then reviewed, then by gene and accession. A site whose decoy is nearer is
    `decoy_won`; one of more genes than max_genes is promiscuous; q values at the FDR or above are `below_fdr`.
    """
    s = OrthologySettings.of(advanced)
    target = phospho_windows(target_fasta, s.window)
    decoy = phospho_windows(decoy_proteins(target_fasta, s.decoy_seed), s.window)
    found = fuzzy_join(sites, target, s.window, s.max_mismatches)
    wrong = fuzzy_join(sites, decoy, s.window, s.max_mismatches).groupBy("query").agg(F.min("mismatches").alias("decoy_mismatches"))
    near = found.withColumn("_least", F.min("mismatches").over(W.partitionBy("query"))).where("mismatches = _least").drop("_least")
    near = near.join(sites.select("query", F.upper("gene").alias("_own")), "query")
    pick = W.partitionBy("query").orderBy((F.upper("gene") == F.col("_own")).cast("int").desc(), F.col("reviewed").cast("int").desc(), "gene", "uniprot", "position")
    genes = F.size(F.collect_set("gene").over(W.partitionBy("query")))
    best = near.withColumn("n_genes", genes).withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n", "_own")
    if s.verify_window is not None and source_fasta is not None:
        best = verify_matches(best, near, sites, source_fasta, target_fasta, s.verify_window)
    renamed = {c: f"source_{c}" for c in ("gene", "position", "residue", "uniprot", "reviewed") if c in sites.columns}
    out = sites.withColumnsRenamed(renamed).join(best.drop("qw"), "query", "left")
    out = out.join(wrong, "query", "left").withColumn("is_decoy", F.coalesce(F.col("decoy_mismatches") < F.col("mismatches"), F.col("mismatches").isNull() & F.col("decoy_mismatches").isNotNull()))
    scored = target_decoy_q(out.where("mismatches is not null or decoy_mismatches is not null").select("query", F.coalesce(F.when(F.col("is_decoy"), F.col("decoy_mismatches")), F.col("mismatches")).alias("mismatches"), "is_decoy"))
    out = out.join(scored.select("query", "q_value"), "query", "left")
    status = (
        F.when(F.col("is_decoy"), "decoy_won").when(F.col("mismatches").isNull(), "unmapped").when(F.col("q_value") >= s.fdr, "below_fdr").when(F.col("n_genes") > s.max_genes, "promiscuous")
        .when(F.col("mismatches") == 0, "exact").otherwise("fuzzy")
    )
    return out.withColumn("status", status), near.drop("_own", "qw")
