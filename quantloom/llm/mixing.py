"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in Spark expressions only.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150% of all sizes;
a target stops at twice its source's size and the excess goes to the others by weight. That is water
filling: one division over the sources in the order of cap / weight gives the level.

Selection: a source's complete epochs take every document; the rest of its target is filled in the
order of exponential keys -ln(u) / quality weight. A prefix sum of sizes finds how many documents fit.
Keys are dealt to buckets that grow in number with the table, so a prefix sum is one over bucket totals
and one inside each bucket; no source is ever in one task. What the next document leaves unfilled goes to
later documents that still fit, for a fixed number of rounds; the last round may round up. A round after the
first takes only the rows that may still fit, so the table is written twice, not once a round. What is known
of a source joins by broadcast as long as a count finds few sources, by a shuffle beyond that.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own; a
null weight counts as 1, weights below 0.001 as 0.001; ties of keys (and repeated rows) are ordered by
doc_id and size; an empty table gives an empty table; other columns are not read. mixed_documents() counts
rows that are equal in all columns one by one and returns as many of them as the mix takes together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import drop_scratch, read_table, scratch, sized_broadcast

WEIGHTS = (3, 1, 2)
SHARE, CAP, ROUNDS = 1.5, 2.0, 4
BUCKET_ROWS = 20_000
SEED = "mix"
#: Quality weights of documents by their label; documents without one weigh 1.
LABEL_WEIGHTS = {0: 0.5, 1: 2.0}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) with 48 bits, from the document's id and a seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed)).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """src, source_size, target from one row per source: src, source, source_size."""
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("w", weight).withColumn("cap", cap * F.col("source_size"))
    ranked = ranked.withColumn("total", share * F.sum("source_size").over(every))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    ahead = F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap")
    behind = F.sum("w").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    leveled = ranked.withColumn("level", (F.col("total") - ahead) / behind)
    free = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))
    level = F.min(free).over(every)["level"]  # of the first source in that order that stays below its cap
    return leveled.withColumn("level", level).select(
        "src", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target")
    )


def _running(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds `upto`: the sum of sizes of a source's rows up to this one, in the order of keys."""
    bucketed = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)))
    totals = bucketed.groupBy("src", "bucket").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("held")
    offsets = totals.select("src", "bucket", before.alias("before"))
    inside = W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return bucketed.join(offsets, ["src", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(inside)).drop("bucket", "before")


def mix(frame: DataFrame, size: Column, weight: Column | None = None, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, rounds: int = ROUNDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, selected, taken: how much of each row the mix takes.

    size and weight are expressions over frame. A row is taken epochs times, and once more if selected.
    """
    weight = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(0.001))
    slim = frame.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size"), weight.alias("weight"))
    slim = scratch(slim.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight")).drop("weight"), "mix-rows")
    sizes = slim.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = scratch(source_targets(sizes, weights, share, cap), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.withColumn("epochs", epochs).withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size"))
    buckets = max(16, slim.count() // BUCKET_ROWS)
    todo, done, gaps = slim, [], scratch(budgets.select("src", "gap"), "mix-gaps")
    for k in range(rounds):
        near = F.col("size") / 2 if k == rounds - 1 else F.lit(0)
        fits = todo.join(sized_broadcast(gaps), "src")
        opened = (F.col("size") > 0) & (F.col("size") - near <= F.col("gap"))
        chosen = _running(fits.where(opened), buckets).select(*slim.columns, (F.col("upto") - near <= F.col("gap")).alias("selected"))
        state = scratch(chosen.unionByName(fits.where(~opened).select(*slim.columns, F.lit(False).alias("selected"))), f"mix-round{k}")
        taken = state.where("selected").groupBy("src").agg(F.sum("size").alias("held"))
        gaps = scratch(gaps.join(taken, "src", "left").select("src", (F.col("gap") - F.coalesce("held", F.lit(0))).alias("gap")), "mix-gaps")
        if k == rounds - 1:
            done.append(state)
            break
        # gaps only shrink: a row of which half is more than what is left is never taken
        judged = state.join(sized_broadcast(gaps), "src").withColumn("over", F.col("selected") | (F.col("size") == 0) | (F.col("size") / 2 > F.col("gap")))
        done.append(judged.where("over").select(*slim.columns, "selected"))
        todo = judged.where("not over").select(*slim.columns)
    rows = reduce(DataFrame.unionAll, done)
    drop_scratch(frame.sparkSession, slim)
    taken = (F.col("epochs") * F.col("size") + F.when(F.col("selected"), F.col("size")).otherwise(0)).cast("long")
    return rows.join(sized_broadcast(budgets), "src").select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "selected", taken.alias("taken"))


def label_weight(quality: Column) -> Column:
    out = F.lit(1.0)
    for label, weight in LABEL_WEIGHTS.items():
        out = F.when(quality == label, F.lit(weight)).otherwise(out)
    return out


def with_label_weight(docs: DataFrame, labels: DataFrame, *columns: Column | str) -> DataFrame:
    """doc_id and the chosen columns of docs beside `_quality`: the best label of the document, or null."""
    best = labels.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max("quality").alias("_quality"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    return slim.join(best, F.col("doc_id") == F.col("_label_id"), "left").drop("_label_id")


def mixed_documents(frame: DataFrame, labels: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The rows of frame as often as the mix takes them, with all columns."""
    row = F.concat_ws("/", F.xxhash64("*"), F.xxhash64(F.lit(seed), "*")).alias("key")  # 128 bits
    slim = frame.select(F.col(id_col).alias("doc_id"), row, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    taken = mix(with_label_weight(slim, labels, "key", "source", "size"), F.col("size"), label_weight(F.col("_quality")), "key", "source", seed)
    copies = taken.groupBy(F.col("doc_id").alias("key")).agg(F.sum(F.col("epochs") + F.col("selected").cast("int")).cast("int").alias("copies")).where("copies > 0")
    held = frame.select(F.struct("*").alias("row"), row).join(copies, "key").dropDuplicates(["key"])  # equal rows are one row, taken as often as all of them
    out = held.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in frame.columns))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_label_weight(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "source", word_count(F.col("text")).alias("size"))
    return mix(docs, F.col("size"), label_weight(F.col("_quality"))).select("doc_id", "size", "source_size", "target", "taken")


def _round_sql(k: int) -> str:
    near = "size / 2.0" if k == ROUNDS - 1 else "0"
    return f"""
f{k} AS (SELECT r.*, b.gap - coalesce((SELECT sum(q.size) FROM r{k} q WHERE q.selected AND q.src = r.src), 0) AS left_
  FROM r{k} r JOIN b USING (src)),
c{k} AS (SELECT *, NOT selected AND size > 0 AND size - {near} <= left_ AS open_ FROM f{k}),
u{k} AS (SELECT *, sum(CASE WHEN open_ THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c{k}),
r{k + 1} AS (SELECT doc_id, src, size, key, selected OR (open_ AND upto - {near} <= left_) AS selected FROM u{k})"""


ORACLE_SQL = {
    "op6_mix_sources": rf"""
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, coalesce('s' || source, 'n') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '{SEED}'), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE)
      / (CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT src, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
v AS (SELECT *, (total - (sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
t AS (SELECT src, source_size, coalesce(least(cap, (SELECT arg_min(own, cap / w) FROM v WHERE cap / w > own) * w), cap) AS target FROM v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS gap FROM t),
r0 AS (SELECT doc_id, src, size, key, false AS selected FROM d),{",".join(map(_round_sql, range(ROUNDS)))}
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN selected THEN size ELSE 0 END)::BIGINT AS taken
FROM r{ROUNDS} JOIN b USING (src)"""
}
QUERIES = {"op6_mix_sources": op6_mix_sources}
