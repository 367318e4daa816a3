"""The driver's tables in the roles of an experiment, as DataFrames and as SQL.

feature: part; sample: supplier; precursor: part x flag x status; quantity: price; localization: 1 - 5 * discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import collapse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, sample, precursor, position, quant, loc_prob."""
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("precursor"), "l_extendedprice", (1 - 5 * F.col("l_discount")).alias("loc")
    )
    return own.groupBy("feature", "sample", "precursor").agg(F.sum("l_extendedprice").alias("quant"), F.max("loc").alias("loc_prob"), F.lit(1).alias("position"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, sample, intensity (linear), loc_prob: sites after the precursor gate."""
    return collapse.aggregate_sites(cells(spark, sf_dir)).withColumnRenamed("quant", "intensity")


def measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).withColumn("intensity", collapse.log2_intensity(F.col("intensity")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.concat(F.lit("c"), (F.col("s_nationkey") % 2).cast("string")).alias("condition"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    residue = F.when(F.col("p_size") % 3 == 0, "S").when(F.col("p_size") % 3 == 1, "T").otherwise("Y")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), residue.alias("residue"), (F.col("p_size") % 5 + 1).cast("int").alias("multiplicity"), F.col("p_brand").alias("protein"), F.col("p_type").alias("gene"), F.col("p_size").cast("int").alias("site_position"))


#: Samples of the matrix without gaps.
DENSE_SAMPLES = 10


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature (part), sample (nation of the supplier modulo 10), intensity: every part, a matrix without gaps (log2 of 1 + sum)."""
    line, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "supplier"))
    own = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(F.col("l_partkey").alias("feature"), (F.col("s_nationkey") % DENSE_SAMPLES).alias("k"), "l_extendedprice")
    sums = own.groupBy("feature").agg(*(F.sum(F.when(F.col("k") == k, F.col("l_extendedprice"))).alias(f"_{k}") for k in range(DENSE_SAMPLES)))
    cells = F.array(*(F.struct(F.lit(f"n{k}").alias("sample"), F.log2(1 + F.coalesce(F.col(f"_{k}"), F.lit(0.0))).alias("intensity")) for k in range(DENSE_SAMPLES)))
    return sums.select("feature", F.inline(cells))


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, condition (g0 to g2), batch (b0, b1)."""
    return spark.createDataFrame([(f"n{k}", f"g{k % 3}", f"b{k % 2}") for k in range(DENSE_SAMPLES)], "sample string, condition string, batch string")


def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("type").alias("library"), F.col("p_type").alias("set_name"), F.col("p_partkey").alias("member"))


def part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, stat, fdr: the log2 ratio of the parts' mean prices in the two conditions."""
    own = measure(spark, sf_dir).join(samples(spark, sf_dir), "sample").where("intensity is not null")
    return own.groupBy("feature").agg((F.avg(F.when(F.col("condition") == "c1", F.col("intensity"))) - F.avg(F.when(F.col("condition") == "c0", F.col("intensity")))).alias("stat")).where("stat is not null")


CELLS = """
cells AS (SELECT l_partkey AS feature, l_suppkey AS sample, l_returnflag || l_linestatus AS precursor, sum(l_extendedprice) AS quant, max(1 - 5 * l_discount) AS loc_prob
  FROM lineitem GROUP BY 1, 2, 3)"""
GATED = CELLS + """,
flagged AS (SELECT *, max(CASE WHEN loc_prob >= 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY feature, sample) AS any_good FROM cells),
gated AS (SELECT feature, sample, sum(CASE WHEN loc_prob >= 0.75 OR any_good = 0 THEN quant END) AS intensity, max(loc_prob) AS loc_prob FROM flagged GROUP BY 1, 2)"""
MEASURE = GATED + """,
measure AS (SELECT feature, sample, CASE WHEN intensity > 0 AND log2(intensity) NOT IN (0, 1) THEN log2(intensity) END AS intensity, loc_prob FROM gated)"""
SAMPLES = "samples AS (SELECT s_suppkey AS sample, 'c' || (s_nationkey % 2) AS condition FROM supplier)"
FEATURES = """
features AS (SELECT p_partkey AS feature, CASE p_size % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'T' ELSE 'Y' END AS residue, (p_size % 5 + 1)::INT AS multiplicity, p_brand AS protein, p_type AS gene, p_size::INT AS site_position FROM part)"""
DENSE = f"""
dense AS (SELECT feature, 'n' || unnest(range({DENSE_SAMPLES})) AS sample, log2(1 + unnest([{", ".join(f"coalesce(c{k}, 0)" for k in range(DENSE_SAMPLES))}])) AS intensity FROM (
  SELECT l_partkey AS feature, {", ".join(f"sum(CASE WHEN s_nationkey % {DENSE_SAMPLES} = {k} THEN l_extendedprice END) AS c{k}" for k in range(DENSE_SAMPLES))}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1))"""
STATS = """
stats AS (SELECT feature, avg(CASE WHEN condition = 'c1' THEN intensity END) - avg(CASE WHEN condition = 'c0' THEN intensity END) AS stat
  FROM measure JOIN samples USING (sample) WHERE intensity IS NOT NULL GROUP BY 1 HAVING stat IS NOT NULL)"""
