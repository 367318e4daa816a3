"""More queries over the driver's tables: the flagship whole, report strings, keys, filters, models, figures' tables.

Each builds the strings or tables that an operator expects from columns of the driver's tables and says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import fdr, keys, peptides
from quantloom.operators import collapse, dimred, enrichment, figures, masks, proteome, qc, sequences, signalome, stats
from quantloom.plans import base as B
from quantloom.plans.base import DENSE, FEATURES, MEASURE, SAMPLES, STATS, table
from quantloom.plans.queries import _scores, query, r6
from quantloom.sources import reports

c = F.col


def _text(*parts):
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


# ---- the flagship: a precursor report to sites


def _report(spark, sf_dir):
    """Line items as a report: run (supplier), peptide (part, one or two phospho sites), localization, quantity."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = line.join(part, line.l_partkey == part.p_partkey)
    share = F.round(100 - 500 * c("l_discount"), 1)
    two = c("p_partkey") % 3 == 0
    peptide = F.when(two, "_AS[Phospho (STY)]C[Carbamidomethyl (C)]T[Phospho (STY)]K_.").otherwise("_AS[Phospho (STY)]C[Carbamidomethyl (C)]TK_.")
    where = F.when(two, _text("_AS[Phospho (STY): ", share, "%]CT[Phospho (STY): ", F.round(200 - 100 - share / 2, 2), "%]K_")).otherwise(_text("_AS[Phospho (STY): ", share, "%]CTK_"))
    return own.select(
        _text("run", c("l_suppkey")).alias("R.FileName"),
        F.concat("p_brand", F.lit(";Other")).alias("PG.ProteinGroups"),
        F.concat("p_type", F.lit(";x")).alias("PG.Genes"),
        _text(c("p_size"), ";7").alias("PEP.PeptidePosition"),
        _text(peptide, (c("p_partkey") % 4 + 1)).alias("EG.PrecursorId"),
        F.lit(0.5).alias("EG.PTMAssayProbability"),
        where.alias("EG.PTMLocalizationProbabilities"),
        c("l_extendedprice").alias("EG.TotalQuantity (Settings)"),
    )


_REPORT = """
sites AS (SELECT 'run' || l_suppkey AS sample, p_brand AS protein, p_type AS gene, p_size, p_partkey % 3 = 0 AS two, p_partkey % 4 AS z, l_extendedprice AS q, unnest(CASE WHEN p_partkey % 3 = 0 THEN [
    {'pos': 2, 'r': 'S', 'p': round(100 - 500 * l_discount, 1) / 100}, {'pos': 4, 'r': 'T', 'p': round(100 - round(100 - 500 * l_discount, 1) / 2, 2) / 100}]
    ELSE [{'pos': 2, 'r': 'S', 'p': round(100 - 500 * l_discount, 1) / 100}] END) AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
cells AS (SELECT protein || '|' || gene || '|' || s.r || (p_size + s.pos - 1) || '|M' || CASE WHEN two THEN 2 ELSE 1 END AS feature, two, z, sample, sum(q) AS quant, max(s.p) AS p FROM sites GROUP BY ALL),
gate AS (SELECT *, max((p >= 0.75)::INT) OVER (PARTITION BY feature, sample) AS good FROM cells),
summed AS (SELECT feature, sample, sum(CASE WHEN p >= 0.75 OR good = 0 THEN quant END) AS quant, max(p) AS p FROM gate GROUP BY 1, 2),
called AS (SELECT feature, sample, p, CASE WHEN p >= 0.75 AND quant > 0 AND log2(quant) NOT IN (0, 1) THEN log2(quant) END AS intensity FROM summed),
kept AS (SELECT *, count(intensity) OVER (PARTITION BY feature) AS n FROM called)"""


@query(f"WITH {_REPORT} SELECT feature, sample, round(intensity, 6) AS intensity, round(p, 6) AS loc_prob FROM kept WHERE n > 0")
def collapse_sites(spark, sf_dir):
    out = collapse.collapse_sites(_report(spark, sf_dir), advanced={"strategy": "per_run", "cutoff": 0.75, "top_n": False})
    return out.measure.select("feature", "sample", *r6("intensity", "loc_prob"))


@query(f"""WITH {_REPORT}, f AS (SELECT feature, count(intensity) AS n_samples_detected, count(*) FILTER (WHERE intensity IS NOT NULL AND p >= 0.75) AS n_class1_samples FROM kept WHERE n > 0 GROUP BY 1),
k AS (SELECT *, regexp_extract(feature, '[|](.*)$', 1) AS short FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY feature) AS i FROM k)
SELECT feature, split_part(feature, '|', 1) AS protein_group_id, split_part(feature, '|', 2) AS gene, substr(split_part(feature, '|', 3), 1, 1) AS residue, substr(split_part(feature, '|', 3), 2)::INT AS site_position,
  CASE WHEN i > 1 THEN short || '#' || i ELSE short END AS short_key, n_samples_detected, n_class1_samples FROM r""")
def collapse_site_table(spark, sf_dir):
    out = collapse.collapse_sites(_report(spark, sf_dir), advanced={"strategy": "per_run", "cutoff": 0.75, "top_n": False})
    return out.features.select("feature", "protein_group_id", "gene", "residue", "site_position", "short_key", "n_samples_detected", "n_class1_samples")


@query(f"WITH {_REPORT} SELECT DISTINCT sample, feature, z + 1 AS charge, round(quant, 4) AS quant, round(p, 6) AS loc_prob FROM cells")
def site_precursor_cells(spark, sf_dir):
    own = collapse.site_precursors(collapse.explode_sites(collapse.prepare(_report(spark, sf_dir), "EG.TotalQuantity (Settings)")))
    return own.select("sample", "feature", F.regexp_extract("precursor", r"\.(\d+)$", 1).cast("long").alias("charge"), F.round("quant", 4).alias("quant"), *r6("loc_prob"))


@query("""WITH r AS (SELECT 'run' || l_suppkey AS sample, p_brand || '|' || p_type || '|ASCTK|' || (p_partkey % 4 + 1) || '|Phospho,Carbamidomethyl' || CASE WHEN p_partkey % 3 = 0 THEN ',Phospho' ELSE '' END AS feature, l_extendedprice AS q,
  CASE WHEN p_partkey % 3 = 0 THEN greatest(round(100 - 500 * l_discount, 1), round(100 - round(100 - 500 * l_discount, 1) / 2, 2)) ELSE round(100 - 500 * l_discount, 1) END / 100 AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT feature, sample, round(log2(sum(q)), 6) AS intensity, round(max(p), 6) AS loc_prob FROM r GROUP BY 1, 2""")
def collapse_precursors(spark, sf_dir):
    return collapse.collapse_precursors(_report(spark, sf_dir), advanced={"annotate_localization": False}).measure.select("feature", "sample", *r6("intensity", "loc_prob"))


# ---- strings of reports


@query("SELECT p_partkey AS feature, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size::INT END AS position FROM part")
def first_peptide_position(spark, sf_dir):
    text = F.when(c("p_partkey") % 4 == 0, "x;3").otherwise(_text(" ", c("p_size"), ",40;7"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), peptides.first_position(text).alias("position"))


_THREE = "(VALUES (2, 0), (4, 1), (5, 2)) v(pos, i)"


@query(f"""WITH p AS (SELECT p_partkey AS feature, pos, [p_size, (p_size * 7) % 50, (p_partkey % 50)][i + 1]::INT AS s FROM part, {_THREE}),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY s DESC, pos) AS n FROM p) SELECT feature, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, max(CASE WHEN n = 1 THEN pos END)::INT AS best FROM r WHERE n <= 2 GROUP BY 1""")
def top_localized_positions(spark, sf_dir):
    values = (c("p_size"), c("p_size") * 7 % 50, c("p_partkey") % 50)
    text = _text("_AS[Phospho (STY): ", values[0].cast("int"), "%]CT[Phospho (STY): ", values[1].cast("int"), "%]Y[Phospho (STY): ", values[2].cast("int"), "%]K_")
    cells = peptides.localization(text)
    own = table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), peptides.top_positions(cells, F.lit(2)).alias("top"), F.get(peptides.ranked_positions(cells, F.lit(1)), F.lit(0))["pos"].alias("best"))
    return own.select("feature", F.array_join("top", ",").alias("positions"), "best")


@query("""WITH p AS (SELECT p_partkey AS feature, p_size::INT AS a, ((p_size * 7) % 50)::INT AS b, p_partkey % 2 = 0 AS first FROM part)
SELECT feature FROM p WHERE (first AND a >= b) OR (NOT first AND b > a)""")
def best_localized_rows(spark, sf_dir):
    """Rows whose encoded position is the best localized one."""
    precursor = F.when(c("p_partkey") % 2 == 0, "_AS[Phospho (STY)]CTK_.2").otherwise("_ASC[Carbamidomethyl (C)]T[Phospho (STY)]K_.2")
    text = _text("_AS[Phospho (STY): ", c("p_size").cast("int"), "%]CT[Phospho (STY): ", (c("p_size") * 7 % 50).cast("int"), "%]K_")
    return table(spark, sf_dir, "part").where(peptides.is_top_n(precursor, text)).select(c("p_partkey").alias("feature"))


@query("SELECT p_partkey AS feature, CASE WHEN p_partkey % 3 = 0 THEN '2,5' ELSE '2' END AS positions, CASE p_partkey % 3 WHEN 0 THEN 'ASCGTK' ELSE 'ASCGK' END AS sequence, CASE p_partkey % 3 WHEN 0 THEN 'As*CGTK' ELSE 'As*CGK' END AS marked, CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 1 END AS n_phospho FROM part")
def encoded_positions(spark, sf_dir):
    precursor = F.when(c("p_partkey") % 3 == 0, "_AS[Phospho (STY)]C[Carbamidomethyl (C)]GT[Phospho (STY)]K_.3").otherwise("_AS[Phospho (STY)]C[Carbamidomethyl (C)]GK_.2")
    sequence = peptides.clean_sequence(precursor)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), F.array_join(peptides.encoded_positions(precursor), ",").alias("positions"), sequence.alias("sequence"), peptides.marked_sequence(sequence, F.lit(2)).alias("marked"), peptides.phospho_count(precursor).alias("n_phospho"))


@query("""SELECT p_partkey AS feature, '_AAS[Phospho (STY)]PLK_.' || (p_size % 3 + 1) AS precursor, 3 AS position, round(((p_size % 9) + 1) / 10, 6) AS prob, (p_size + 9)::INT AS site, (p_size + 7)::INT AS start FROM part""")
def diann_strings(spark, sf_dir):
    modified, protein = F.lit("AAS(UniMod:21)PLK"), c("p_brand")
    occupancy = _text("AAS(UniMod:21){0.", (c("p_size") % 9 + 1).cast("int"), "00000}PLK", (c("p_size") % 3 + 1).cast("int"))
    sites = _text("[x", ":C3,S5];[", protein, ":C2,S", (c("p_size") + 9).cast("int"), ",T700]")
    own = table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), peptides.diann_precursor(modified, c("p_size") % 3 + 1).alias("precursor"), F.explode(peptides.diann_localization(occupancy)).alias("cell"), peptides.first_site_position(sites, protein).alias("site"), peptides.diann_start(modified, sites, protein).alias("start"))
    return own.select("feature", "precursor", c("cell.pos").alias("position"), F.round("cell.prob", 6).alias("prob"), "site", "start")


@query("SELECT p_partkey AS feature, replace(p_type, ' ', '_') AS protein, 'S' AS residue, p_size::INT AS position, '_KAG' || upper(left(replace(p_brand, '#', ''), 4)) || '*S*' || 'REDEISP_' AS kinase_sequence, 'run' || p_size AS run FROM part")
def fragpipe_strings(spark, sf_dir):
    index = reports.parse_fragpipe_index(_text(F.replace("p_type", F.lit(" "), F.lit("_")), "_S", c("p_size").cast("int")))
    window = _text("kag", F.lower(F.left(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(4))), "s", "REDEISp")
    path = F.when(c("p_partkey") % 2 == 0, _text("C:\\data\\run", c("p_size").cast("int"), ".raw")).otherwise(_text("/data/run", c("p_size").cast("int"), ".d"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), index["protein"].alias("protein"), index["residue"].alias("residue"), index["position"].alias("position"), peptides.window_to_kinase_sequence(window, F.lit("s")).alias("kinase_sequence"), peptides.run_name(path).alias("run"))


@query("""WITH f AS (SELECT p_partkey AS feature, ['light', 'medium', 'heavy'][p_partkey % 3 + 1] AS channel FROM part) SELECT channel, count(*) AS n FROM f GROUP BY 1""")
def label_channels(spark, sf_dir):
    tag = F.when(c("p_partkey") % 3 == 0, "").when(c("p_partkey") % 3 == 1, "[Arg6]").otherwise("[Lys8]")
    own = table(spark, sf_dir, "part").select(reports.derive_channel(F.concat(F.lit("_AK"), tag, F.lit("[Other]_.2"))).alias("Channel"))
    return reports.describe_channels(own).select(c("Channel").alias("channel"), c("count").alias("n"))


# ---- keys, groups, contaminants


@query(f"""WITH {FEATURES} SELECT feature, protein || '|' || residue || site_position || '|M' || multiplicity AS pg_key, CASE WHEN feature % 5 = 0 THEN NULL ELSE protein || '_' || residue || site_position END AS site_id,
  CASE WHEN feature % 5 = 0 THEN 'bad key' WHEN feature % 7 = 0 THEN protein || ' ' || residue || site_position ELSE gene || ' ' || residue || site_position END AS label, CASE WHEN feature % 5 = 0 THEN NULL WHEN feature % 7 = 0 THEN NULL ELSE gene END AS gene FROM features""")
def site_names(spark, sf_dir):
    own = B.features(spark, sf_dir).withColumn("named", F.when(c("feature") % 7 == 0, "").otherwise(c("gene")))
    place = (c("residue"), c("site_position"), c("multiplicity"))
    key = F.when(c("feature") % 5 == 0, "bad key").otherwise(keys.full_key(c("protein"), c("named"), *place))
    out = keys.canonicalise(own.withColumn("key", key), "key", drop_unparseable=False)
    return out.select("feature", keys.pg_key(c("protein"), *place).alias("pg_key"), "site_id", keys.site_label(c("key")).alias("label"), keys.key_gene(c("key")).alias("gene"))


@query("""SELECT p_partkey AS feature, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Cont_' || p_partkey ELSE 'CON__B' END AS leading, p_partkey % 3 <> 0 AS tagged, p_partkey % 3 = 2 AS is_contaminant FROM part""")
def contaminant_groups(spark, sf_dir):
    group = F.when(c("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("; P2"))).when(c("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(";Cont_"), c("p_partkey").cast("string"))).otherwise("Cont_A;CON__B")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), keys.leading_protein(group).alias("leading"), keys.is_contaminant_tagged(group).alias("tagged"), reports.contaminant(group).alias("is_contaminant"))


@query("SELECT p_partkey AS feature FROM part WHERE p_partkey % 3 <> 2")
def contaminants_dropped(spark, sf_dir):
    group = F.when(c("p_partkey") % 3 == 2, "Cont_A;CON__B").otherwise(F.concat("p_brand", F.lit(";Cont_A")))
    return reports.filter_contaminants(table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), group.alias("PG.ProteinGroups"))).select("feature")


# ---- filters

# The Jeffreys bound by bisection; the Beta distribution's integral in x = sin^2 is one of powers of sines and cosines, summed by the midpoint rule.
_WILSON = f"""WITH RECURSIVE {MEASURE}, f AS (SELECT feature, count(intensity) AS n, count(*) FILTER (WHERE intensity IS NOT NULL AND loc_prob >= 0.75) AS k FROM measure GROUP BY 1),
d AS (SELECT DISTINCT k, n FROM f WHERE n > 0),
w AS (SELECT k, n, list_sum(list_transform(range(2000), lambda i: sin((i + 0.5) * pi() / 4000) ** (2 * k) * cos((i + 0.5) * pi() / 4000) ** (2 * (n - k)))) * pi() / 4000 AS whole FROM d),
b(k, n, whole, lo, hi, step) AS (SELECT k, n, whole, 0.0::DOUBLE, pi() / 2, 0 FROM w
  UNION ALL SELECT k, n, whole, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, step + 1 FROM (
    SELECT k, n, whole, lo, hi, step, (lo + hi) / 2 AS mid, list_sum(list_transform(range(4000), lambda i: sin((i + 0.5) * (lo + hi) / 8000) ** (2 * k) * cos((i + 0.5) * (lo + hi) / 8000) ** (2 * (n - k)))) * (lo + hi) / 8000 < 0.025 * whole AS below FROM b WHERE step < 40)),
lb AS (SELECT feature, f.k, f.n, coalesce(sin(lo) ** 2, 0) AS lb FROM f LEFT JOIN b ON b.k = f.k AND b.n = f.n AND b.step = 40)"""


def _bounded(spark, sf_dir):
    return masks.with_wilson_bound(collapse.site_qc(B.measure(spark, sf_dir)))


@query(f"{_WILSON} SELECT feature, k AS n_class1_samples, n AS n_samples_detected, round(lb, 4) AS bound FROM lb")
def wilson_bounds(spark, sf_dir):
    return _bounded(spark, sf_dir).select("feature", "n_class1_samples", "n_samples_detected", F.round("class1_wilson_lb", 4).alias("bound"))


@query(f"{_WILSON} SELECT feature FROM lb WHERE lb >= 0.5123")
def wilson_filter(spark, sf_dir):
    return masks.apply_wilson_filter(_bounded(spark, sf_dir), 100, 0.5123).select("feature")


@query(f"""{_WILSON}, t AS (SELECT unnest([0.1003, 0.3003, 0.5003, 0.7003]::DOUBLE[]) AS threshold), s AS (SELECT feature, count(intensity) AS cells, CASE WHEN count(intensity) >= 2 THEN stddev_pop(intensity) END AS sd FROM measure GROUP BY 1),
a AS (SELECT threshold, count(lb) AS n_kept, sum(cells) AS cells, median(sd) AS median_sd, median(cells) AS median_detections FROM t LEFT JOIN lb ON lb >= threshold LEFT JOIN s USING (feature) GROUP BY 1)
SELECT threshold, n_kept, round(100.0 * n_kept / (SELECT count(*) FROM f), 6) AS pct_kept, CASE WHEN n_kept > 0 THEN round(100 * (1 - cells / (n_kept * (SELECT count(DISTINCT sample) FROM measure))), 6) END AS pct_missing, round(median_sd, 6) AS median_sd, n_kept - (SELECT n_kept FROM a WHERE threshold = 0.5003::DOUBLE) AS delta_vs_reference FROM a""")
def wilson_sensitivity(spark, sf_dir):
    out = masks.threshold_sensitivity(_bounded(spark, sf_dir), B.measure(spark, sf_dir), [0.1003, 0.3003, 0.5003, 0.7003])
    return out.select("threshold", "n_kept", *r6("pct_kept", "pct_missing", "median_sd"), "delta_vs_reference")


@query(f"{_WILSON}, t AS (SELECT unnest([0.2003, 0.4003, 0.6003]::DOUBLE[]) AS threshold) SELECT threshold, count(lb) AS n_sites FROM t LEFT JOIN lb ON lb >= threshold GROUP BY 1")
def retention_curve(spark, sf_dir):
    return figures.retention_curve(_bounded(spark, sf_dir), [0.2003, 0.4003, 0.6003])


@query(f"WITH {MEASURE}, n AS (SELECT *, count(CASE WHEN loc_prob >= 0.99 THEN intensity END) OVER (PARTITION BY feature) AS n FROM measure) SELECT feature, sample, round(CASE WHEN loc_prob >= 0.99 THEN intensity END, 6) AS intensity FROM n WHERE n > 0")
def drop_missing_features(spark, sf_dir):
    return masks.drop_missing_features(masks.mask_per_run(B.measure(spark, sf_dir), 0.99)).select("feature", "sample", *r6("intensity"))


# ---- models

# Digamma and its derivatives by their series at x + 8. Prior degrees of freedom by Newton steps on the inverse trigamma.
_DI = "(ln({x} + 8) - 1 / (2 * ({x} + 8)) - 1 / (12 * ({x} + 8) ** 2) + 1 / (120 * ({x} + 8) ** 4) - 1 / (252 * ({x} + 8) ** 6) - list_sum(list_transform(range(8), lambda i: 1 / ({x} + i))))"
_TRI = "(1 / ({x} + 8) + 1 / (2 * ({x} + 8) ** 2) + 1 / (6 * ({x} + 8) ** 3) - 1 / (30 * ({x} + 8) ** 5) + 1 / (42 * ({x} + 8) ** 7) - 1 / (30 * ({x} + 8) ** 9) + list_sum(list_transform(range(8), lambda i: 1 / ({x} + i) ** 2)))"
_TETRA = "(-1 / ({x} + 8) ** 2 - 1 / ({x} + 8) ** 3 - 1 / (2 * ({x} + 8) ** 4) + 1 / (6 * ({x} + 8) ** 6) - 1 / (6 * ({x} + 8) ** 8) - 2 * list_sum(list_transform(range(8), lambda i: 1 / ({x} + i) ** 3)))"
_DF = B.DENSE_SAMPLES - 3
_MODERATED = f"""WITH RECURSIVE {DENSE}, g AS (SELECT feature, substr(sample, 2)::INT % 3 AS g, avg(intensity) AS m, count(*) AS n, var_pop(intensity) * count(*) AS ss FROM dense GROUP BY 1, 2),
t AS (SELECT feature, sum(ss) / {_DF} AS s2, sum(m * n) / sum(n) AS mean, max(CASE WHEN g = 0 THEN m END) AS m0, max(CASE WHEN g = 1 THEN m END) AS m1, max(CASE WHEN g = 2 THEN m END) AS m2, max(CASE WHEN g = 0 THEN n END) AS n0, max(CASE WHEN g = 1 THEN n END) AS n1, max(CASE WHEN g = 2 THEN n END) AS n2 FROM g GROUP BY 1),
e AS (SELECT ln(greatest(s2, 1e-5 * (SELECT median(s2) FROM t WHERE s2 > 0))) - ({_DI.format(x=_DF / 2)} - ln({_DF / 2})) AS e FROM t),
v AS (SELECT avg(e) AS m, var_samp(e) - {_TRI.format(x=_DF / 2)} AS excess FROM e),
y(y, excess, m, step) AS (SELECT 0.5 + 1 / excess, excess, m, 0 FROM v UNION ALL SELECT y + {_TRI.format(x="y")} * (1 - {_TRI.format(x="y")} / excess) / {_TETRA.format(x="y")}, excess, m, step + 1 FROM y WHERE step < 40),
prior AS (SELECT 2 * y AS d0, exp(m + ({_DI.format(x="y")} - ln(y))) AS s0 FROM y WHERE step = 40),
post AS (SELECT t.*, (d0 * s0 + {_DF} * s2) / (d0 + {_DF}) AS post, d0 FROM t, prior)"""


@query(f"""{_MODERATED} SELECT feature, 'g1 - g0' AS contrast, round(m1 - m0, 5) AS log2fc, round((m1 - m0) / sqrt(post * (1.0 / n1 + 1.0 / n0)), 4) AS t_stat FROM post
UNION ALL SELECT feature, 'g2 - g0', round(m2 - m0, 5), round((m2 - m0) / sqrt(post * (1.0 / n2 + 1.0 / n0)), 4) FROM post""")
def moderated_t(spark, sf_dir):
    """The variances' prior without a trend over the mean."""
    out = stats.diff_exp_contrasts(B.dense(spark, sf_dir), B.dense_samples(spark, sf_dir), [("g1", "g0"), ("g2", "g0")], trend=False)
    return out.select("feature", "contrast", F.round("log2fc", 5).alias("log2fc"), F.round("t_stat", 4).alias("t_stat"))


@query(f"{_MODERATED} SELECT feature, round((n0 * (m0 - mean) ** 2 + n1 * (m1 - mean) ** 2 + n2 * (m2 - mean) ** 2) / 2 / post, 4) AS f_stat, round(mean, 6) AS ave_expr FROM post")
def moderated_f(spark, sf_dir):
    out = stats.diff_exp_anova(B.dense(spark, sf_dir), B.dense_samples(spark, sf_dir), trend=False)
    return out.select("feature", F.round("f_stat", 4).alias("f_stat"), *r6("ave_expr"))


@query(f"""WITH {MEASURE}, {SAMPLES}, o AS (SELECT feature, count(intensity) FILTER (WHERE condition = 'c1') AS n_treatment, count(intensity) FILTER (WHERE condition = 'c0') AS n_control FROM measure JOIN samples USING (sample) GROUP BY 1),
z AS (SELECT count(*) FILTER (WHERE condition = 'c1') AS a, count(*) FILTER (WHERE condition = 'c0') AS b FROM samples)
SELECT feature, n_treatment, n_control, a - n_treatment AS n_missing_treatment, b - n_control AS n_missing_control, n_treatment < 12 OR n_control < 12 AS imputed_driven FROM o, z""")
def imputed_provenance(spark, sf_dir):
    own = B.measure(spark, sf_dir)
    return stats.annotate_imputed(own.select("feature").distinct(), own, B.samples(spark, sf_dir), ("c1", "c0"), min_observed=12)


@query("""WITH p AS (SELECT l_partkey AS feature, avg(l_discount) * 10 AS p FROM lineitem GROUP BY 1), r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM p)
SELECT feature, round(least(1, min(p * n / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) * (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM p) + 1) t(i))), 6) AS fdr FROM r""")
def by_fdr(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("feature")).agg((F.avg("l_discount") * 10).alias("p_value"))
    return fdr.adjust(own, method="by").select("feature", *r6("fdr"))


# ---- principal components


@query(f"""WITH {DENSE}, x AS (SELECT feature, sample, intensity - avg(intensity) OVER (PARTITION BY feature) AS x FROM dense)
SELECT a.sample AS sample_a, b.sample AS sample_b, round(sum((a.x - b.x) ** 2), 3) AS distance FROM x a JOIN x b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2""")
def pca_distances(spark, sf_dir):
    """All components together keep the distances between samples."""
    scores = dimred.pca(B.dense(spark, sf_dir), B.DENSE_SAMPLES - 1)[0]
    a, b = scores.select("pc", c("sample").alias("sample_a"), c("value").alias("x")), scores.select("pc", c("sample").alias("sample_b"), c("value").alias("y"))
    return a.join(b, "pc").where("sample_a < sample_b").groupBy("sample_a", "sample_b").agg(F.round(F.sum((c("x") - c("y")) * (c("x") - c("y"))), 3).alias("distance"))


# ---- quality control and figures' tables


@query(f"""WITH {MEASURE}, l AS (SELECT sample, least(floor(loc_prob * 20), 19)::BIGINT AS bin, count(*) OVER (PARTITION BY sample) AS n FROM measure WHERE loc_prob IS NOT NULL)
SELECT sample, bin, round(count(*) * 20 / any_value(n), 6) AS density FROM l WHERE n >= 2 GROUP BY 1, 2""")
def localization_histogram(spark, sf_dir):
    return qc.localization_histogram(B.measure(spark, sf_dir), 20).select("sample", "bin", *r6("density"))


@query(f"WITH {MEASURE} SELECT count(intensity) AS all_cells, count(intensity) FILTER (WHERE loc_prob >= 0.75) AS per_run, count(intensity) FILTER (WHERE loc_prob >= 0.9) AS policy FROM measure")
def class1_comparison(spark, sf_dir):
    own = B.measure(spark, sf_dir)
    return qc.class1_comparison(own, masks.mask_per_run(own, 0.9))


@query(f"""WITH {MEASURE}, {SAMPLES}, {FEATURES}, v AS (SELECT feature, condition, stddev_samp(2.0 ** intensity) / avg(2.0 ** intensity) AS cv FROM measure JOIN samples USING (sample) WHERE intensity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT condition, residue, round(quantile_cont(cv, 0.05), 6) AS p5, round(quantile_cont(cv, 0.25), 6) AS q1, round(median(cv), 6) AS median, round(quantile_cont(cv, 0.75), 6) AS q3, round(quantile_cont(cv, 0.95), 6) AS p95 FROM v JOIN features USING (feature) GROUP BY 1, 2""")
def cv_boxes(spark, sf_dir):
    cv = qc.cv_by_condition(B.measure(spark, sf_dir), B.features(spark, sf_dir), B.samples(spark, sf_dir))
    return qc.cv_boxes(cv).select("condition", "residue", *r6("p5", "q1", "median", "q3", "p95"))


@query("""WITH t AS (SELECT 0 AS step, 'rows' AS stage, count(*) AS n_rows FROM lineitem UNION ALL SELECT 1, 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 2, 'cheap', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)
SELECT step, stage, n_rows, coalesce(lag(n_rows) OVER (ORDER BY step) - n_rows, 0) AS lost, round_even(100.0 * n_rows / first(n_rows) OVER (ORDER BY step), 2) AS pct_of_first FROM t""")
def pipeline_waterfall(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    flagged = F.col("l_returnflag") == "R"
    row = own.agg(F.count("*").alias("rows"), F.count_if(flagged).alias("returned"), F.count_if(flagged & (F.col("l_discount") > 0.05)).alias("cheap")).first()
    return qc.waterfall([(n, row[n]) for n in ("rows", "returned", "cheap")], spark)


@query("""WITH o AS (SELECT user_id AS sample, event_type AS precursor, median(value) AS rt FROM events WHERE value IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, count(*) OVER (PARTITION BY precursor) AS n, median(rt) OVER (PARTITION BY precursor) AS cohort FROM o),
d AS (SELECT sample, median(rt - cohort) AS m FROM k WHERE n >= 3 GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS a, rank() OVER (ORDER BY sample) AS b FROM d)
SELECT round(regr_slope(m, sample), 9) AS slope, round(corr(m, sample), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r""")
def drift_trend(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(c("user_id").alias("sample"), c("event_type").alias("precursor"), c("value").alias("rt"))
    drift = qc.retention_drift(own).withColumn("injection_order", c("sample").cast("double"))
    return qc.drift_trend(drift).select(F.round("slope", 9).alias("slope"), *r6("pearson", "spearman"))


@query(f"""WITH {MEASURE}, q AS (SELECT sample, quantile_cont(intensity, 0.25) AS q1, median(intensity) AS m, quantile_cont(intensity, 0.75) AS q3 FROM measure WHERE intensity IS NOT NULL GROUP BY 1)
SELECT sample, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3, round(min(intensity), 6) AS low, round(max(intensity), 6) AS high FROM measure JOIN q USING (sample) WHERE intensity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def intensity_boxes(spark, sf_dir):
    return figures.intensity_boxes(B.measure(spark, sf_dir)).select("sample", *r6("q1", "median", "q3", "low", "high"))


@query(f"""WITH {MEASURE}, t AS (SELECT feature, var_samp(intensity) AS v FROM measure GROUP BY 1 HAVING v IS NOT NULL ORDER BY v DESC, feature LIMIT 50),
m AS (SELECT feature, sample, intensity, avg(intensity) OVER (PARTITION BY feature) AS a, stddev_samp(intensity) OVER (PARTITION BY feature) AS s FROM measure WHERE feature IN (SELECT feature FROM t)) SELECT feature, sample, round((intensity - a) / s, 6) AS z FROM m""")
def heatmap(spark, sf_dir):
    """The 50 features of largest variance."""
    return figures.heatmap(B.measure(spark, sf_dir), 50).select("feature", "sample", *r6("z"))


@query(f"""WITH {MEASURE}, {SAMPLES}, {STATS}, s AS (SELECT feature::VARCHAR AS feature, stat AS log2fc, 1 / (1 + abs(stat) * 40) AS fdr FROM stats)
SELECT feature, round(-log10(fdr), 6) AS neg_log10_fdr, CASE WHEN fdr < 0.05 AND abs(log2fc) >= 0.6 THEN 'sig_' || CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END WHEN fdr < 0.05 THEN 'almost_' || CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END ELSE 'ns' END AS category FROM s""")
def volcano_categories(spark, sf_dir):
    own = B.part_stats(spark, sf_dir).select(c("feature").cast("string").alias("feature"), c("stat").alias("log2fc"), (1 / (1 + F.abs("stat") * 40)).alias("fdr"))
    return figures.volcano(own, 0.05, 0.6).select("feature", *r6("neg_log10_fdr"), "category")


@query(f"WITH {MEASURE}, {SAMPLES} SELECT sample, condition, round(intensity, 6) AS intensity FROM measure JOIN samples USING (sample) WHERE feature = (SELECT min(p_partkey) FROM part)")
def site_abundance(spark, sf_dir):
    first = table(spark, sf_dir, "part").agg(F.min("p_partkey")).first()[0]
    return figures.site_abundance(B.measure(spark, sf_dir), B.samples(spark, sf_dir), first).select("sample", "condition", *r6("intensity"))


# ---- proteome


@query("""WITH w AS (SELECT DISTINCT 'a_' || ['A', 'B', 'C'][s_nationkey % 3 + 1] || (s_nationkey % 12 + 1) AS sample FROM supplier) SELECT sample, 'p' || substr(sample, 2) || '_x' AS protein_sample FROM w""")
def pair_by_well(spark, sf_dir):
    well = _text(F.get(F.array(*map(F.lit, "ABC")), (c("s_nationkey") % 3).cast("int")), (c("s_nationkey") % 12 + 1).cast("int"))
    own = table(spark, sf_dir, "supplier").select(_text("a_", well).alias("sample"), _text("p_", well, "_x").alias("other")).distinct()
    return proteome.pair_samples(own, own.select(c("other").alias("sample")))


@query("""WITH g AS (SELECT DISTINCT p_brand FROM part), f AS (SELECT p_partkey AS feature, 'none;' || p_brand AS a FROM part) SELECT feature, split_part(a, ';', 2) || ';y' AS protein FROM f""")
def pair_proteins(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    features = part.select(c("p_partkey").alias("feature"), F.concat(F.lit("none;"), "p_brand").alias("protein_group_id"))
    groups = part.select(F.concat("p_brand", F.lit(";y")).alias("feature"), F.lit(1.0).alias("intensity")).distinct()
    return proteome.pair_proteins(features, groups)


# ---- networks, sets, sequences, modules


@query("SELECT p_brand AS source, p_size::VARCHAR AS target, max(p_retailprice) AS weight FROM part GROUP BY 1, 2")
def network_pairs(spark, sf_dir):
    return enrichment.validate_network(table(spark, sf_dir, "part").select(c("p_brand").alias("source"), c("p_size").cast("string").alias("target"), c("p_retailprice").alias("weight")))


def _ptm_db(spark, sf_dir):
    own = B.features(spark, sf_dir)
    null = F.lit(None).cast("string")
    return own.select(
        c("gene").alias("substrate_gene"), c("protein").alias("substrate_uniprot"), "residue", c("site_position").alias("position"), F.lit("phospho").alias("modification"), F.when(c("feature") % 4 > 0, F.concat(F.lit("K"), (c("feature") % 7).cast("string"))).alias("enzyme_gene"),
        null.alias("enzyme_uniprot"), null.alias("effect"), F.when(c("feature") % 3 == 0, "induces_ppi").when(c("feature") % 3 == 1, "no such effect").alias("effect_canonical"), F.when(c("feature") % 6 == 0, "ClinVar;MC3_TCGA_cancer").when(c("feature") % 6 == 1, "x;TCGA").alias("ADB_disease_variant"), (c("feature") % 101).cast("double").alias("Ochoa_functional_score"),
        (c("feature") % 5).cast("double").alias("curation_confidence"), (c("feature") % 2 == 0).alias("is_curated"), (c("feature") % 11 == 0).alias("chemistry_warning_flag"),
    )


_NET = f"WITH {FEATURES}, n AS (SELECT 'K' || (feature % 7) AS source, protein || '_' || residue || site_position AS target, max((feature % 5)::DOUBLE) AS confidence FROM features WHERE feature % 4 > 0 AND feature % 2 = 0 GROUP BY 1, 2)"


@query(f"{_NET} SELECT source, target, confidence FROM n")
def ptm_network(spark, sf_dir):
    return enrichment.ptm_network(_ptm_db(spark, sf_dir)).select("source", "target", "confidence")


@query(f"{_NET}, s AS (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM n) SELECT source AS set_name, target AS member FROM s WHERE c >= 5")
def kinase_substrate_sets(spark, sf_dir):
    return enrichment.kinase_substrate_sets(_ptm_db(spark, sf_dir)).select("set_name", "member")


@query(f"""WITH {FEATURES}, o AS (SELECT *, protein || '_' || residue || site_position AS member FROM features WHERE feature % 11 <> 0), s AS (SELECT member, min((feature % 101)::DOUBLE) AS s FROM o GROUP BY 1), q AS (SELECT quantile_cont(s, 0.25) AS a, quantile_cont(s, 0.75) AS b FROM s),
l AS (SELECT 'FUNCTIONAL_EFFECT' AS library, 'induces_ppi' AS set_name, member FROM o WHERE feature % 3 = 0 UNION SELECT 'DISEASE_VARIANT', 'clinvar_site', member FROM o WHERE feature % 6 = 0 UNION SELECT 'DISEASE_VARIANT', 'cancer_TCGA_site', member FROM o WHERE feature % 6 < 2
  UNION SELECT 'FUNCTIONAL_SCORE_BIN', 'ochoa_top_quartile', member FROM s, q WHERE s >= b UNION SELECT 'FUNCTIONAL_SCORE_BIN', 'ochoa_bottom_quartile', member FROM s, q WHERE s <= a)
SELECT library, set_name, count(*) AS n_sites FROM l GROUP BY 1, 2""")
def site_libraries(spark, sf_dir):
    return enrichment.libraries_manifest(enrichment.ptm_libraries(_ptm_db(spark, sf_dir))).drop("description")


@query(f"""WITH {MEASURE}, {SAMPLES}, {STATS}, r AS (SELECT *, row_number() OVER (ORDER BY stat DESC, feature) AS place, count(*) OVER () AS total FROM stats),
m AS (SELECT p_type AS set_name, place, total, abs(stat) AS w, row_number() OVER (PARTITION BY p_type ORDER BY place) AS i, count(*) OVER (PARTITION BY p_type) AS n, sum(abs(stat)) OVER (PARTITION BY p_type) AS sw, sum(abs(stat)) OVER (PARTITION BY p_type ORDER BY place) AS cum FROM r JOIN part ON feature = p_partkey),
e AS (SELECT set_name, max(n) AS size, max(cum / sw - (place - i) / greatest(total - n, 1)) AS top, min((cum - w) / sw - (place - i) / greatest(total - n, 1)) AS bottom,
  arg_max(i, cum / sw - (place - i) / greatest(total - n, 1)) AS up_to, arg_min(i, (cum - w) / sw - (place - i) / greatest(total - n, 1)) AS from_ FROM m GROUP BY 1)
SELECT set_name, size, round(CASE WHEN top >= -bottom THEN top ELSE bottom END, 6) AS es, (CASE WHEN top >= -bottom THEN up_to ELSE size - from_ + 1 END)::INT AS n_edge FROM e""")
def gsea_leading_edge(spark, sf_dir):
    out = enrichment.gsea(B.part_stats(spark, sf_dir), B.part_sets(spark, sf_dir), max_set_size=1 << 30, n_permutations=50)
    return out.select("set_name", "size", *r6("es"), F.size("leading_edge").alias("n_edge"))


@query(f"WITH {FEATURES}, a AS (SELECT DISTINCT feature AS n, {'protein'} || '|' || gene || '|' || residue || site_position || '|M1' AS feature, protein || '_' || residue || site_position AS site_id FROM features) SELECT DISTINCT feature, site_id FROM a")
def attached_site_ids(spark, sf_dir):
    own = B.features(spark, sf_dir).select(keys.full_key(c("protein"), c("gene"), c("residue"), c("site_position"), F.lit(1)).alias("feature")).distinct()
    return enrichment.attach_site_ids(own, _ptm_db(spark, sf_dir)).select("feature", "site_id")


@query(f"WITH {MEASURE}, {SAMPLES}, {STATS} SELECT p_type AS gene, round(max_by(stat, abs(stat)), 6) AS stat FROM stats JOIN part ON feature = p_partkey GROUP BY 1")
def sites_to_genes(spark, sf_dir):
    own = B.part_stats(spark, sf_dir).join(B.features(spark, sf_dir), "feature").select(keys.full_key(c("protein"), c("gene"), c("residue"), c("site_position"), c("feature") % 100000).alias("feature"), "stat")
    return enrichment.sites_to_genes(own, "stat").select("gene", *r6("stat"))


_KINASES = """w AS (SELECT p_partkey AS feature, ['A', 'R', 'P'][p_size % 3 + 1] || ['K', 'D'][p_partkey % 2 + 1] AS l, ['P', 'E', 'L', 'G'][p_size % 4 + 1] AS r FROM part),
m AS (SELECT 'K' || k AS kinase, o, a, 0.5 + ((k * 13 + o * 5 + ascii(a)) % 17) / 10.0 AS value, k FROM range(6) x(k), (VALUES (-2), (-1), (1)) y(o), (SELECT unnest(['A', 'R', 'P', 'K', 'D', 'E', 'L', 'G']) AS a) z),
s AS (SELECT feature, kinase, round_even(sum(log2(value)), 3) AS score FROM (SELECT feature, -2 AS o, l[1] AS a FROM w UNION ALL SELECT feature, -1, l[2] FROM w UNION ALL SELECT feature, 1, r FROM w) c JOIN m USING (o, a) GROUP BY 1, 2)"""


def _kinase_scores(spark, sf_dir):
    place = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    window = F.concat(F.lit("_"), place("ARP", c("p_size") % 3), place("KD", c("p_partkey") % 2), F.lit("*S*"), place("PELG", c("p_size") % 4), F.lit("_"))
    features = table(spark, sf_dir, "part").select(c("p_partkey").alias("feature"), window.alias("kinase_sequence"))
    cells = [(f"K{k}", o, a, 0.5 + ((k * 13 + o * 5 + ord(a)) % 17) / 10.0) for k in range(6) for o in (-2, -1, 1) for a in "ARPKDELG"]
    return sequences.score_kinases(features, spark.createDataFrame(cells, "kinase string, offset int, aa string, value double"))


@query(f"WITH {_KINASES} SELECT feature, kinase, score FROM s")
def kinase_scores(spark, sf_dir):
    return _kinase_scores(spark, sf_dir)


@query(f"WITH {_KINASES}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, kinase) AS n FROM s) SELECT feature, string_agg(kinase, ',' ORDER BY n) AS kinases FROM r WHERE n <= 3 GROUP BY 1")
def predicted_kinases(spark, sf_dir):
    return sequences.predict_kinases(_kinase_scores(spark, sf_dir), 3, "score").select("feature", F.array_join("kinases", ",").alias("kinases"))


_ASSIGNED = """s AS (SELECT vec_id AS feature, 'k' || (unnest(range(len(embedding)))) AS kinase, unnest(embedding)::DOUBLE AS score FROM embeddings),
t AS (SELECT feature, kinase FROM (SELECT *, max(score) OVER (PARTITION BY feature) AS top FROM s) WHERE score = top),
a AS (SELECT feature, 'p' || (feature % 37) AS protein, 'm' || (feature % 37 % 5) AS module, string_agg(kinase, ',' ORDER BY kinase) AS top_kinases, 1.0 / count(*) AS weight FROM t GROUP BY 1),
v AS (SELECT module, kinase, sum(weight) AS w FROM a JOIN t USING (feature) GROUP BY 1, 2), k AS (SELECT module, arg_min(kinase, {'w': -w, 'k': kinase}) AS module_kinase FROM v GROUP BY 1)"""


@query(f"WITH {_ASSIGNED} SELECT feature, protein, module, top_kinases, round(weight, 6) AS weight, module_kinase FROM a JOIN k USING (module)")
def module_assignments(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    sites = scores.select("feature").distinct().select("feature", _text("p", c("feature") % 37).alias("protein"))
    modules = sites.select("protein", _text("m", F.substr("protein", F.lit(2)).cast("int") % 5).alias("module")).distinct()
    return signalome.module_assignments(scores, sites, modules).select("feature", "protein", "module", F.array_join("top_kinases", ",").alias("top_kinases"), *r6("weight"), "module_kinase")


@query(f"""WITH {MEASURE}, {SAMPLES}, i AS (SELECT sample, CASE WHEN intensity IS NULL THEN 'missing' ELSE 'seen' END AS strategy FROM measure) SELECT sample, strategy, count(*) AS n FROM i GROUP BY 1, 2""")
def imputation_summary(spark, sf_dir):
    return qc.imputation_summary(B.measure(spark, sf_dir).select("sample", F.when(c("intensity").isNull(), "missing").otherwise("seen").alias("strategy")))
