"""Queries over the driver's tables: each operator, and the same in SQL where SQL can say it.

Values that went through sums of floats are rounded to 6 digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import fdr, keys, peptides
from quantloom.operators import collapse, dimred, enrichment, impute, masks, proteome, qc, sequences, signalome, stats
from quantloom.plans import base as B
from quantloom.plans.base import CELLS, DENSE, FEATURES, GATED, MEASURE, SAMPLES, STATS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---- collapse


def _collapsed(how: str, sql: str):
    def run(spark, sf_dir):
        return collapse.aggregate_sites(B.cells(spark, sf_dir), how, None).select("feature", "sample", *r6("quant", "loc_prob"))

    run.__name__ = f"collapse_{how}"
    query(f"WITH {CELLS} SELECT feature, sample, round({sql}, 6) AS quant, round(max(loc_prob), 6) AS loc_prob FROM cells GROUP BY 1, 2")(run)


_collapsed("sum", "sum(quant)")
_collapsed("mean", "avg(quant)")
_collapsed("median", "median(quant)")


@query("""WITH r AS (SELECT p_brand AS feature, l_suppkey AS sample, l_extendedprice AS q, row_number() OVER (PARTITION BY p_brand, l_suppkey ORDER BY l_extendedprice DESC) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT feature, sample, round(log2(sum(CASE WHEN n <= 3 THEN q END)), 6) AS intensity, count(*) AS n_precursors FROM r GROUP BY 1, 2""")
def collapse_top3(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = line.join(part, line.l_partkey == part.p_partkey)
    return collapse.collapse_proteome(own, "p_brand", "l_suppkey", "l_extendedprice", "top3").select("feature", "sample", *r6("intensity"), "n_precursors")


@query(f"WITH {GATED} SELECT feature, sample, round(intensity, 6) AS intensity, round(loc_prob, 6) AS loc_prob FROM gated")
def precursor_gate(spark, sf_dir):
    return B.gated(spark, sf_dir).select("feature", "sample", *r6("intensity", "loc_prob"))


@query(f"WITH {MEASURE} SELECT feature, sample, round(intensity, 6) AS intensity FROM measure")
def log2_noise_floor(spark, sf_dir):
    return B.measure(spark, sf_dir).select("feature", "sample", *r6("intensity"))


@query(f"WITH {GATED} SELECT feature, sample, round(CASE WHEN loc_prob >= 0.75 THEN intensity END, 6) AS intensity FROM gated")
def mask_per_run(spark, sf_dir):
    return masks.mask_per_run(B.gated(spark, sf_dir)).select("feature", "sample", *r6("intensity"))


@query(f"WITH {GATED}, m AS (SELECT *, max(loc_prob) OVER (PARTITION BY feature) AS best FROM gated) SELECT feature, sample, round(intensity, 6) AS intensity FROM m WHERE best >= 0.95")
def mask_global_max(spark, sf_dir):
    return masks.filter_by_global_max(B.gated(spark, sf_dir), 0.95).select("feature", "sample", *r6("intensity"))


_DECISION = f"""WITH {GATED}, {SAMPLES},
z AS (SELECT condition, count(*) AS n_samples FROM (SELECT DISTINCT sample FROM gated) JOIN samples USING (sample) GROUP BY 1),
c AS (SELECT g.*, condition, n_samples, sum(CASE WHEN loc_prob >= 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY feature, condition) AS n_class1
  FROM gated g JOIN samples USING (sample) JOIN z USING (condition))"""


@query(f"{_DECISION} SELECT feature, sample, round(CASE WHEN n_class1 / n_samples >= 0.1 OR loc_prob >= 0.75 THEN intensity END, 6) AS intensity FROM c")
def mask_condition(spark, sf_dir):
    return masks.mask_condition_aware(B.gated(spark, sf_dir), B.samples(spark, sf_dir), 0.75, 0.1)[0].select("feature", "sample", *r6("intensity"))


@query(f"{_DECISION} SELECT DISTINCT feature, condition, n_class1::BIGINT AS n_class1, n_samples, round(n_class1 / n_samples, 6) AS fraction, n_class1 / n_samples >= 0.1 AS passed FROM c")
def decision_table(spark, sf_dir):
    return masks.mask_condition_aware(B.gated(spark, sf_dir), B.samples(spark, sf_dir), 0.75, 0.1)[1].select("feature", "condition", "n_class1", "n_samples", *r6("fraction"), "passed")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS sample, l_partkey || (CASE WHEN l_returnflag = 'R' THEN '[Phospho (STY)]' ELSE '' END) AS p FROM lineitem)
SELECT sample, count(*) AS n_precursors, count(*) FILTER (WHERE p LIKE '%[Phospho (STY)]%') AS n_phospho, round(100.0 * count(*) FILTER (WHERE p LIKE '%[Phospho (STY)]%') / count(*), 6) AS pct FROM p GROUP BY 1""")
def selectivity(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("R.FileName"), F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", "[Phospho (STY)]").otherwise("")).alias("EG.PrecursorId"))
    out = collapse.selectivity(own)
    return out.select("sample", "n_precursors", "n_phospho", F.round(100.0 * F.col("n_phospho") / F.col("n_precursors"), 6).alias("pct"))


@query(f"""WITH {MEASURE} SELECT feature, count(intensity) AS n_samples_detected, round(avg(CASE WHEN intensity IS NOT NULL THEN loc_prob END), 9) AS mean_loc_prob, round(max(CASE WHEN intensity IS NOT NULL THEN loc_prob END), 9) AS max_loc_prob,
  round(min(CASE WHEN intensity IS NOT NULL THEN loc_prob END), 9) AS min_loc_prob, count(*) FILTER (WHERE intensity IS NOT NULL AND loc_prob >= 0.75) AS n_class1_samples FROM measure GROUP BY 1""")
def site_qc(spark, sf_dir):
    return collapse.site_qc(B.measure(spark, sf_dir)).select("feature", "n_samples_detected", *(F.round(c, 9).alias(c) for c in ("mean_loc_prob", "max_loc_prob", "min_loc_prob")), "n_class1_samples")


@query("""WITH p AS (SELECT '_AS[Phospho (STY)]C[Carbamidomethyl (C)]' || repeat('G', (p_size % 4)::INT) || (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'T[Phospho (STY)]' END) || 'K_.' || (p_size % 3 + 1) AS s, p_partkey, p_size FROM part),
e AS (SELECT p_partkey, s, 2 AS position, 'S' AS residue FROM p UNION ALL SELECT p_partkey, s, (4 + p_size % 4)::INT, 'T' FROM p WHERE p_partkey % 3 <> 0)
SELECT p_partkey AS feature, position, residue, 'ASC' || repeat('G', (p_size % 4)::INT) || (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'T' END) || 'K' AS sequence FROM e JOIN part USING (p_partkey)""")
def explode_positions(spark, sf_dir):
    size = (F.col("p_size") % 4).cast("int")
    text = F.concat(F.lit("_AS[Phospho (STY)]C[Carbamidomethyl (C)]"), F.expr("repeat('G', cast(p_size % 4 as int))"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("T[Phospho (STY)]"), F.lit("K_."), (F.col("p_size") % 3 + 1).cast("string"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), text.alias("precursor"), size.alias("n"))
    own = own.withColumn("sequence", peptides.clean_sequence(F.col("precursor"))).withColumn("position", F.explode(peptides.phospho_positions(F.col("precursor"))))
    return own.select("feature", "position", peptides.residue_at(F.col("sequence"), F.col("position")).alias("residue"), "sequence")


@query("""WITH p AS (SELECT p_partkey AS feature, (p_size % 50)::DOUBLE AS a FROM part)
SELECT feature, unnest([2, 5]) AS position, round(unnest([(50 + a) / 100, (50 - a) / 100]), 6) AS prob FROM p""")
def localization_map(spark, sf_dir):
    a = (F.col("p_size") % 50).cast("int")
    text = F.concat(F.lit("_AS[Phospho (STY): "), (50 + a).cast("string"), F.lit("%]C[Carbamidomethyl (C): 100%]PT[Phospho (STY): "), (50 - a).cast("string"), F.lit("%]K_"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), F.explode(peptides.localization(text)).alias("c"))
    return own.select("feature", F.col("c.pos").alias("position"), F.round("c.prob", 6).alias("prob"))


_KEY = "protein || '|' || gene || '|' || residue || site_position || '|M' || multiplicity"


@query(f"WITH {FEATURES} SELECT feature, {_KEY} AS full_key, gene || '|' || residue || site_position || '|M' || multiplicity AS short_key, protein || '_' || residue || site_position AS site_id FROM features")
def key_build(spark, sf_dir):
    c = F.col
    own = B.features(spark, sf_dir)
    key = (c("residue"), c("site_position"), c("multiplicity"))
    return own.select("feature", keys.full_key(c("protein"), c("gene"), *key).alias("full_key"), keys.short_key(c("gene"), *key).alias("short_key"), keys.canonical_id(keys.full_key(c("protein"), c("gene"), *key)).alias("site_id"))


@query(f"WITH {FEATURES} SELECT feature, protein, gene, residue, site_position AS position, multiplicity FROM features")
def key_parse(spark, sf_dir):
    c = F.col
    own = B.features(spark, sf_dir)
    own = own.select("feature", keys.parse_key(keys.full_key(c("protein"), c("gene"), c("residue"), c("site_position"), c("multiplicity"))).alias("k"))
    return own.select("feature", "k.protein", "k.gene", "k.residue", "k.position", "k.multiplicity")


@query(f"""WITH {FEATURES}, k AS (SELECT feature, gene || '|' || residue || site_position || '|M' || multiplicity AS s, {_KEY} || feature AS f FROM features),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY f) AS n FROM k) SELECT feature, CASE WHEN n > 1 THEN s || '#' || n ELSE s END AS short_key, n > 1 AS collision FROM n""")
def short_key_collisions(spark, sf_dir):
    c = F.col
    own = B.features(spark, sf_dir)
    key = (c("residue"), c("site_position"), c("multiplicity"))
    own = own.select("feature", keys.short_key(c("gene"), *key).alias("short_key"), F.concat(keys.full_key(c("protein"), c("gene"), *key), c("feature").cast("string")).alias("full_key"))
    return keys.resolve_collisions(own).select("feature", "short_key", "collision")


# ---- completeness and on/off


def _complete(strategy: str, sql: str):
    def run(spark, sf_dir):
        out = masks.filter_by_completeness(B.measure(spark, sf_dir), B.samples(spark, sf_dir), min_valid_n=12, group_column=None if strategy == "all" else "condition", keep_strategy=strategy)
        return out.groupBy("feature").agg(F.count("intensity").alias("n"))

    run.__name__ = f"completeness_{strategy}"
    query(f"""WITH {MEASURE}, {SAMPLES}, g AS (SELECT feature, {"'all'" if strategy == "all" else "condition"} AS grp, count(intensity) AS n FROM measure JOIN samples USING (sample) GROUP BY 1, 2)
SELECT feature, sum(n)::BIGINT AS n FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE n >= 12) >= {sql}""")(run)


_complete("all", "1")
_complete("any", "1")
_complete("each", "(SELECT count(DISTINCT condition) FROM samples)")


@query(f"""WITH {MEASURE}, {SAMPLES}, c AS (SELECT feature, count(intensity) FILTER (WHERE condition = 'c1') AS n_treatment, count(intensity) FILTER (WHERE condition = 'c0') AS n_control FROM measure LEFT JOIN samples USING (sample) GROUP BY 1)
SELECT *, CASE WHEN n_treatment >= 9 AND n_control >= 9 THEN 'both' WHEN n_treatment >= 9 AND n_control = 0 THEN 'on_in_treatment' WHEN n_control >= 9 AND n_treatment = 0 THEN 'on_in_control' ELSE 'absent' END AS status FROM c""")
def on_off_detection(spark, sf_dir):
    return stats.on_off(B.measure(spark, sf_dir), B.samples(spark, sf_dir), ("c1", "c0"), min_observed=9)


# ---- quality control


@query(f"WITH {MEASURE}, t AS (SELECT count(DISTINCT feature) AS n FROM measure) SELECT sample, (SELECT n FROM t) - count(intensity) AS n_missing, round(100.0 * ((SELECT n FROM t) - count(intensity)) / (SELECT n FROM t), 6) AS pct_missing FROM measure GROUP BY 1")
def missingness(spark, sf_dir):
    return qc.missingness(B.measure(spark, sf_dir)).select("sample", F.col("n_missing").cast("long").alias("n_missing"), *r6("pct_missing"))


def _share_sql(column: str, values: str, expression: str) -> str:
    return f"""WITH {MEASURE}, {FEATURES}, c AS (SELECT sample, {expression} AS v, count(*) AS n FROM measure JOIN features USING (feature) WHERE intensity IS NOT NULL GROUP BY 1, 2),
s AS (SELECT DISTINCT sample, unnest({values}) AS v FROM measure)
SELECT s.sample, s.v AS {column}, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.sample), 6) AS pct FROM s LEFT JOIN c ON c.sample = s.sample AND c.v = s.v"""


@query(_share_sql("residue", "['S', 'T', 'Y']", "residue"))
def sty_ratio(spark, sf_dir):
    return qc.sty_ratio(B.measure(spark, sf_dir), B.features(spark, sf_dir)).select("sample", "residue", "n", *r6("pct"))


@query(_share_sql("multiplicity", "['1', '2', '3+']", "CASE WHEN multiplicity >= 3 THEN '3+' ELSE multiplicity::VARCHAR END"))
def multiplicity_distribution(spark, sf_dir):
    return qc.multiplicity_distribution(B.measure(spark, sf_dir), B.features(spark, sf_dir)).select("sample", "multiplicity", "n", *r6("pct"))


@query(f"WITH {MEASURE} SELECT sample, count(*) FILTER (WHERE loc_prob >= 0.75) AS n_class1, count(*) AS n FROM measure WHERE intensity IS NOT NULL GROUP BY 1")
def class1_counts(spark, sf_dir):
    return qc.class1_per_sample(B.measure(spark, sf_dir)).select("sample", "n_class1", "n")


@query(f"""WITH {MEASURE}, {SAMPLES}, {FEATURES} SELECT feature, condition, any_value(residue) AS residue, round(stddev_samp(2.0 ** intensity) / avg(2.0 ** intensity), 6) AS cv
FROM measure JOIN samples USING (sample) JOIN features USING (feature) WHERE intensity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def cv_by_condition(spark, sf_dir):
    return qc.cv_by_condition(B.measure(spark, sf_dir), B.features(spark, sf_dir), B.samples(spark, sf_dir)).select("feature", "condition", "residue", *r6("cv"))


@query(f"WITH {MEASURE} SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS n_shared, round(corr(a.intensity, b.intensity), 6) AS r FROM measure a JOIN measure b ON a.feature = b.feature AND a.sample < b.sample WHERE a.intensity IS NOT NULL AND b.intensity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")
def replicate_correlation(spark, sf_dir):
    return qc.replicate_correlation(B.measure(spark, sf_dir)).select("sample_a", "sample_b", "n_shared", *r6("r"))


def _psm(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = line.join(part, line.l_partkey == part.p_partkey)
    return own.select(F.col("l_suppkey").alias("sample"), F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("precursor"), F.col("p_brand").alias("protein"), F.col("l_extendedprice").alias("intensity"), "p_type")


_Z = """SELECT {cols}, round(CASE WHEN d > 0 THEN ({x} - m) / (1.4826 * d) ELSE 0 END, 6) AS z FROM (SELECT *, median(abs({x} - m)) OVER () AS d FROM (SELECT *, median({x}) OVER () AS m FROM t))"""


@query("WITH t AS (SELECT l_suppkey AS sample, count(*) AS n_psms, count(DISTINCT l_partkey || '/' || l_returnflag) AS n_unique_precursors, count(DISTINCT p_brand) AS n_unique_proteins FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) " + _Z.format(cols="sample, n_psms, n_unique_precursors, n_unique_proteins", x="n_unique_precursors"))
def psm_counts(spark, sf_dir):
    return qc.psm_counts(_psm(spark, sf_dir)).select("sample", "n_psms", "n_unique_precursors", "n_unique_proteins", *r6("z"))


@query("WITH o AS (SELECT l_suppkey AS sample, l_partkey || '/' || l_returnflag AS p, min(l_extendedprice) AS q FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2), t AS (SELECT sample, sum(q) AS tic, median(q) AS median_intensity, count(*) AS n_precursors, log2(sum(q)) AS l FROM o GROUP BY 1) " + _Z.format(cols="sample, round(tic, 2) AS tic, round(median_intensity, 4) AS median_intensity, n_precursors", x="l"))
def run_tic(spark, sf_dir):
    return qc.run_tic(_psm(spark, sf_dir)).select("sample", F.round("tic", 2).alias("tic"), F.round("median_intensity", 4).alias("median_intensity"), "n_precursors", *r6("z"))


@query("SELECT l_suppkey AS sample, round(sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS fraction FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def contaminant_fraction(spark, sf_dir):
    return qc.contaminant_share(_psm(spark, sf_dir), F.col("p_type").startswith("PROMO")).select("sample", *r6("fraction"))


@query("SELECT p_type AS gene, count(*) AS n_rows FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def contaminant_breakdown(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return qc.contaminant_breakdown(line.join(part, line.l_partkey == part.p_partkey).withColumn("gene", F.col("p_type")), F.col("p_size") > 10)


@query("""WITH o AS (SELECT user_id AS sample, event_type AS precursor, median(value) AS rt FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, count(*) OVER (PARTITION BY precursor) AS n, median(rt) OVER (PARTITION BY precursor) AS cohort FROM o)
SELECT sample, count(*) AS n_precursors, round(median(rt - cohort), 6) AS median_offset, round(quantile_cont(rt - cohort, 0.75) - quantile_cont(rt - cohort, 0.25), 6) AS iqr_offset FROM c WHERE n >= 3 GROUP BY 1""")
def retention_drift(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("precursor"), F.col("value").alias("rt"))
    return qc.retention_drift(own).select("sample", "n_precursors", *r6("median_offset", "iqr_offset"))


# ---- proteome


@query(f"""WITH {MEASURE}, prot AS (SELECT p_brand AS protein, l_suppkey AS sample, log2(sum(l_extendedprice)) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT m.feature, m.sample, round(m.intensity - p, 6) AS intensity FROM measure m JOIN part ON m.feature = p_partkey LEFT JOIN prot ON prot.protein = p_brand AND prot.sample = m.sample""")
def pair_normalise(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = collapse.collapse_proteome(line.join(part, line.l_partkey == part.p_partkey), "p_brand", "l_suppkey", "l_extendedprice").withColumn("sample", F.col("sample").cast("string"))
    phospho = B.measure(spark, sf_dir).withColumn("sample", F.col("sample").cast("string"))
    names = {r[0]: r[0] for r in phospho.select("sample").distinct().collect()}  # samples of an experiment
    features = B.features(spark, sf_dir).select("feature", F.col("protein").alias("protein_group_id"))
    out = proteome.phospho_over_proteome(phospho, features, own, names)
    return out.select("feature", F.col("sample").cast("long").alias("sample"), *r6("intensity"))


# ---- enrichment


@query(f"WITH {MEASURE}, {SAMPLES}, {STATS} SELECT p_type AS key, round(max_by(stat, abs(stat)), 6) AS stat FROM stats JOIN part ON feature = p_partkey GROUP BY 1")
def abs_max_dedup(spark, sf_dir):
    own = B.part_stats(spark, sf_dir).join(B.features(spark, sf_dir).select("feature", F.col("gene").alias("key")), "feature")
    return enrichment.dedup_abs_max(own, "key", "stat").select("key", *r6("stat"))


_HITS = f"""WITH {MEASURE}, {SAMPLES}, {STATS}, u AS (SELECT count(*) AS n, count(*) FILTER (WHERE stat > 0.3) AS k FROM stats),
c AS (SELECT p_type AS set_name, count(*) AS s, count(*) FILTER (WHERE stat > 0.3) AS o FROM stats JOIN part ON feature = p_partkey GROUP BY 1)"""


@query(f"{_HITS} SELECT 'type' AS library, set_name, s AS set_size, o AS overlap FROM c")
def ora_counts(spark, sf_dir):
    own = B.part_stats(spark, sf_dir)
    return enrichment.set_counts(B.part_sets(spark, sf_dir), own.select("feature"), own.where("stat > 0.3").select("feature")).select("library", "set_name", "set_size", "overlap")


@query(f"""{_HITS}, t AS (SELECT c.*, n, k, unnest(range(greatest(0, s + k - n), least(s, k) + 1)) AS i FROM c, u WHERE s >= 5 AND o >= 1),
l AS (SELECT *, lgamma(s + 1) - lgamma(i + 1) - lgamma(s - i + 1) + lgamma(n - s + 1) - lgamma(k - i + 1) - lgamma(n - s - k + i + 1) - (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) AS lp FROM t)
SELECT set_name, any_value(o) AS overlap, round(least(1, sum(exp(lp)) FILTER (WHERE i >= o)), 6) AS p_value FROM l GROUP BY 1""")
def ora_fisher(spark, sf_dir):
    own = B.part_stats(spark, sf_dir)
    out = enrichment.ora(own.where("stat > 0.3").select("feature"), own.select("feature"), B.part_sets(spark, sf_dir), alternative="greater")
    return out.select("set_name", "overlap", *r6("p_value"))


@query("""WITH p AS (SELECT l_partkey AS feature, avg(l_discount) * 10 AS p FROM lineitem GROUP BY 1), r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM p)
SELECT feature, round(least(1, min(p * n / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS fdr FROM r""")
def bh_fdr(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg((F.avg("l_discount") * 10).alias("p_value"))
    return fdr.adjust(own).select("feature", *r6("fdr"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS s, p_size AS m FROM part), n AS (SELECT s, count(*) AS n FROM m GROUP BY 1)
SELECT a.s AS set_a, b.s AS set_b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard FROM m a JOIN m b ON a.m = b.m AND a.s < b.s JOIN n x ON x.s = a.s JOIN n y ON y.s = b.s GROUP BY 1, 2""")
def library_jaccard(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.lit("brand").alias("library"), F.col("p_brand").alias("set_name"), F.col("p_size").alias("member"))
    return enrichment.library_redundancy(own).select("set_a", "set_b", *r6("jaccard"))


@query(f"""WITH {MEASURE}, {SAMPLES}, {STATS}, r AS (SELECT *, row_number() OVER (ORDER BY stat DESC, feature) AS place, count(*) OVER () AS total FROM stats),
m AS (SELECT p_type AS set_name, place, total, abs(stat) AS w, row_number() OVER (PARTITION BY p_type ORDER BY place) AS i, count(*) OVER (PARTITION BY p_type) AS n, sum(abs(stat)) OVER (PARTITION BY p_type) AS sw, sum(abs(stat)) OVER (PARTITION BY p_type ORDER BY place) AS cum FROM r JOIN part ON feature = p_partkey),
e AS (SELECT set_name, max(n) AS size, max(cum / sw - (place - i) / greatest(total - n, 1)) AS top, min((cum - w) / sw - (place - i) / greatest(total - n, 1)) AS bottom FROM m GROUP BY 1)
SELECT set_name, size, round(CASE WHEN top >= -bottom THEN top ELSE bottom END, 6) AS es FROM e""")
def gsea_es(spark, sf_dir):
    return enrichment.enrichment_score(B.part_stats(spark, sf_dir), B.part_sets(spark, sf_dir)).select("set_name", "size", *r6("es"))


@query(f"""WITH {MEASURE}, {SAMPLES}, {STATS}, g AS (SELECT avg(stat) AS m, stddev_samp(stat) AS s FROM stats)
SELECT p_type AS source, count(*) AS n, round((avg(stat) - any_value(m)) * sqrt(count(*)) / any_value(s), 6) AS z FROM stats JOIN part ON feature = p_partkey, g GROUP BY 1 HAVING count(*) >= 3""")
def ksea_z(spark, sf_dir):
    own = B.part_stats(spark, sf_dir).withColumnRenamed("feature", "target")
    net = B.part_sets(spark, sf_dir).select(F.col("set_name").alias("source"), F.col("member").alias("target"))
    return enrichment.ksea_z(own, net).select("source", "n", *r6("z"))


@query(f"""WITH {MEASURE}, {SAMPLES}, {STATS}, g AS (SELECT count(*) AS n, sum(stat) AS t, sum(stat * stat) AS q FROM stats),
w AS (SELECT p_type AS source, p_size::DOUBLE AS w, stat FROM stats JOIN part ON feature = p_partkey), k AS (SELECT source, count(*) AS c, sum(w) AS sw, sum(w * w) AS ww, sum(w * stat) AS wy FROM w GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT source, c, n, (wy - sw * t / n) / sqrt((ww - sw * sw / n) * (q - t * t / n)) AS r FROM k, g) SELECT source, c AS n_substrates, round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) AS score FROM r""")
def ulm_score(spark, sf_dir):
    own = B.part_stats(spark, sf_dir).withColumnRenamed("feature", "target")
    net = table(spark, sf_dir, "part").select(F.col("p_type").alias("source"), F.col("p_partkey").alias("target"), F.col("p_size").cast("double").alias("weight"))
    return enrichment.kinase_activity(own, net).select("source", "n_substrates", *r6("score"))


@query(f"""WITH {FEATURES}, n AS (SELECT p_brand AS p, p_type AS g, floor(p_retailprice)::INT % 50 + 1 AS n FROM part), d AS (SELECT *, CASE n % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'T' ELSE 'Y' END AS r FROM n),
q AS (SELECT DISTINCT protein, gene, residue, site_position FROM features),
m AS (SELECT q.*, EXISTS (SELECT 1 FROM d WHERE d.p = q.protein AND d.r = q.residue AND d.n = q.site_position) AS a, EXISTS (SELECT 1 FROM d WHERE d.g = q.gene AND d.r = q.residue AND d.n = q.site_position) AS b FROM q)
SELECT protein || '|' || gene || '|' || residue || site_position || '|M1' AS key, CASE WHEN a THEN 'protein' ELSE 'gene' END AS tier FROM m WHERE a OR b""")
def tiered_match(spark, sf_dir):
    """All features against a database of all parts, whose positions are another column: the price in whole units, modulo 50."""
    c = F.col
    position = (F.floor("p_retailprice") % 50 + 1).cast("int")
    residue = F.when(c("position") % 3 == 0, "S").when(c("position") % 3 == 1, "T").otherwise("Y")
    db = table(spark, sf_dir, "part").select(c("p_brand").alias("substrate_uniprot"), c("p_type").alias("substrate_gene"), position.alias("position")).withColumn("residue", residue)
    asked = B.features(spark, sf_dir).select(keys.full_key(c("protein"), c("gene"), c("residue"), c("site_position"), F.lit(1)).alias("key"))
    return enrichment.match_sites(asked, db)[0].select("key", "tier")


# ---- distances, network, modules


@query(f"WITH {DENSE} SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS n_shared, round(sqrt(sum((a.intensity - b.intensity) ** 2) / count(*)), 6) AS distance FROM dense a JOIN dense b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2")
def sample_distance(spark, sf_dir):
    return dimred.sample_distance(B.dense(spark, sf_dir)).select("sample_a", "sample_b", "n_shared", *r6("distance"))


_ALL_SCORES = "s AS (SELECT vec_id AS feature, 'k' || (unnest(range(len(embedding)))) AS kinase, unnest(embedding)::DOUBLE AS score FROM embeddings)"


@query(f"WITH {_ALL_SCORES} SELECT a.kinase AS source, b.kinase AS target, count(*) AS n, round(corr(a.score, b.score), 6) AS r FROM s a JOIN s b ON a.feature = b.feature AND a.kinase < b.kinase GROUP BY 1, 2")
def kinase_network(spark, sf_dir):
    return signalome.kinase_network(_scores(spark, sf_dir), 0.2)[2].select("source", "target", "n", *r6("r"))


def _scores(spark, sf_dir):
    """Every component of every vector."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature"), F.posexplode("embedding").alias("k", "score"))
    return own.select("feature", F.concat(F.lit("k"), F.col("k").cast("string")).alias("kinase"), F.col("score").cast("double").alias("score"))


@query(f"WITH {_ALL_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, kinase) AS rank FROM s) SELECT feature, kinase, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3")
def topk_per_site(spark, sf_dir):
    return enrichment.top_k(_scores(spark, sf_dir), "feature", "score", 3, "kinase").select("feature", "kinase", *r6("score"), "rank")


@query(f"""WITH {_ALL_SCORES}, c AS (SELECT 'm' || (feature % 5) AS module, kinase, count(DISTINCT 'p' || (feature % 37))::DOUBLE AS amount FROM s WHERE score > 0.1 GROUP BY 1, 2)
SELECT module, kinase, amount, round(100 * amount / sum(amount) OVER (PARTITION BY module), 6) AS percent FROM c""")
def module_table(spark, sf_dir):
    return _module_table(_scores(spark, sf_dir))


def _module_table(scores):
    sites = scores.select("feature").distinct().select("feature", F.concat(F.lit("p"), (F.col("feature") % 37).cast("string")).alias("protein"), F.concat(F.lit("m"), (F.col("feature") % 5).cast("string")).alias("module"))
    out = signalome.module_table(sites, signalome.kinase_substrates(scores, 0.1))
    return out.select("module", "kinase", "amount", F.round(100 * F.col("amount") / F.sum("amount").over(W.partitionBy("module")), 6).alias("percent"))


# ---- sequences


def _proteins(spark, sf_dir):
    own = table(spark, sf_dir, "part")
    return own.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("accession"), F.col("p_brand").alias("gene"), F.lit(True).alias("reviewed"), F.upper(F.regexp_replace(F.concat("p_name", "p_type"), "[^A-Za-z]", "")).alias("sequence"))


_WINDOWS = """p AS (SELECT p_partkey, upper(regexp_replace(p_name || p_type, '[^A-Za-z]', '', 'g')) AS s FROM part),
i AS (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS position FROM p),
w AS (SELECT 'P' || p_partkey AS uniprot, position, substr(s, position, 1) AS residue, substr('_______' || s || '_______', position, 15) AS w FROM i WHERE substr(s, position, 1) IN ('S', 'T', 'Y'))"""


@query(f"WITH {_WINDOWS} SELECT uniprot, position::INT AS position, residue, w AS \"window\" FROM w")
def phospho_windows(spark, sf_dir):
    return sequences.phospho_windows(_proteins(spark, sf_dir)).select("uniprot", "position", "residue", "window")


@query(f"""WITH {_WINDOWS}, u AS (SELECT DISTINCT w FROM w)
SELECT q.w AS query, u.w AS hit, (SELECT count(*) FROM range(1, 16) t(i) WHERE substr(q.w, i, 1) <> substr(u.w, i, 1))::INT AS mismatches FROM u q JOIN u ON (substr(q.w, 8, 1) = 'Y') = (substr(u.w, 8, 1) = 'Y')
  AND (SELECT count(*) FROM range(1, 16) t(i) WHERE substr(q.w, i, 1) <> substr(u.w, i, 1)) <= 2""")
def hamming_join(spark, sf_dir):
    own = sequences.phospho_windows(_proteins(spark, sf_dir))
    index = own.groupBy("window").agg(*(F.min(c).alias(c) for c in ("uniprot", "gene", "position", "residue", "reviewed")))
    asked = index.select(F.col("window").alias("query"), "window")
    return sequences.fuzzy_join(asked, index).select("query", F.col("tw").alias("hit"), "mismatches")


@query("""WITH m AS (SELECT o_orderkey AS query, (o_orderkey % 3)::INT AS mismatches, floor(o_totalprice)::BIGINT % 7 = 0 AS is_decoy FROM orders),
f AS (SELECT *, least(1.0, sum(is_decoy::INT) OVER w / greatest(sum((NOT is_decoy)::INT) OVER w, 1)) AS f FROM m WINDOW w AS (ORDER BY mismatches, query ROWS UNBOUNDED PRECEDING))
SELECT query, round(min(f) OVER (ORDER BY mismatches DESC, query DESC ROWS UNBOUNDED PRECEDING), 6) AS q_value FROM f""")
def qvalue_decoy(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 3).cast("int").alias("mismatches"), (F.floor("o_totalprice") % 7 == 0).alias("is_decoy"))
    return sequences.target_decoy_q(own).select("query", *r6("q_value"))


# ---- models


@query(f"""WITH {DENSE}, g AS (SELECT feature, avg(intensity) FILTER (WHERE substr(sample, 2)::INT % 3 = 1) - avg(intensity) FILTER (WHERE substr(sample, 2)::INT % 3 = 0) AS lfc, avg(intensity) AS m FROM dense GROUP BY 1)
SELECT feature, round(lfc, 6) AS log2fc, round(m, 6) AS ave_expr FROM g""")
def limma_contrast(spark, sf_dir):
    return stats.diff_exp_contrasts(B.dense(spark, sf_dir), B.dense_samples(spark, sf_dir), [("g1", "g0")]).select("feature", *r6("log2fc", "ave_expr"))


@query()
def limma_moderated_t(spark, sf_dir):
    return stats.diff_exp_contrasts(B.dense(spark, sf_dir), B.dense_samples(spark, sf_dir), [("g1", "g0"), ("g2", "g0")])


@query()
def anova_moderated_f(spark, sf_dir):
    return stats.diff_exp_anova(B.dense(spark, sf_dir), B.dense_samples(spark, sf_dir))


@query()
def impute_knn(spark, sf_dir):
    own = B.dense(spark, sf_dir).withColumn("intensity", F.when(F.crc32(F.concat("feature", "sample").cast("binary")) % 5 != 0, F.col("intensity")))
    return impute.impute_knn(own, B.dense_samples(spark, sf_dir))


@query()
def impute_hybrid(spark, sf_dir):
    own = B.dense(spark, sf_dir).withColumn("intensity", F.when(F.crc32(F.concat("feature", "sample").cast("binary")) % 5 != 0, F.col("intensity")))
    return impute.impute_hybrid(own, B.dense_samples(spark, sf_dir))


@query()
def batch_combat(spark, sf_dir):
    return impute.combat(B.dense(spark, sf_dir), B.dense_samples(spark, sf_dir))


@query()
def consolidate(spark, sf_dir):
    own = B.cells(spark, sf_dir).withColumn("feature", F.col("feature").cast("string")).withColumn("sample", F.col("sample").cast("string"))
    return collapse.aggregate_sites(own, "consolidate", None)


@query()
def pca_scores(spark, sf_dir):
    return dimred.pca(B.dense(spark, sf_dir), 5)[0]


@query()
def ward_order(spark, sf_dir):
    order = dimred.hierarchical_cluster(dimred.sample_distance(B.dense(spark, sf_dir)), "ward")[1]
    return spark.createDataFrame([(i, s) for i, s in enumerate(order)], "place int, sample string")


@query()
def signalome_clusters(spark, sf_dir):
    return signalome.cluster_sites(_scores(spark, sf_dir))
