"""Sharding by balanced label propagation, in Spark expressions only.

Documents with equal texts are linked. Every document starts in a shard of its own hash. In each round a
linked document asks to move to the shard that holds most of its group; a shard admits no more movers
than its quota of linked documents leaves room for (movers are admitted by a hash threshold, so no group
is ever ranked in one task). A group larger than a shard's quota is first split into chunks of at most a
shard, so that a hot group fills whole shards instead of fighting for one.

Then the law `rows` is made exact: within a shard, linked documents come first; what exceeds the quota
(numbers of documents at most one apart) overflows, in order, into the free slots of the other shards.
Ranks come from bucket totals and a window inside each bucket; buckets grow in number with the table.

Rounds are written to the shared folder: lost executors repeat tasks, not rounds.

Defined results: a null text is the empty text (size 16, crc32 0), equal to other empty texts; null or
repeated doc_ids are rows of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import drop_scratch, read_table, scratch

SHARDS, ROUNDS = 40, 3
OVERHEAD = 16
BUCKET_ROWS = 20_000


def _hash01(*columns: Column, salt: str) -> Column:
    """Uniform in [0, 1) by value."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(salt)), 11) / float(1 << 53)


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """linked: row id `rid`, `hub` (the documents of a hub are linked), `shard`. Returns rid, hub and the new shard."""
    now = linked
    for k in range(rounds):
        held = now.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        # most of the group; of equal shards the one that a hash of the hub prefers, so that ties spread
        wish = held.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("best")).select("hub", F.col("best.shard").alias("wish"))
        wish = scratch(wish, f"shard-wish{k}")  # joined to many rows of a hub: the other side can be split
        asked = now.join(wish, "hub")
        flows = asked.groupBy("shard", "wish").agg(F.count("*").alias("n"))  # at most shards x shards rows
        stay = flows.groupBy("shard").agg(F.sum(F.when(F.col("shard") == F.col("wish"), F.col("n")).otherwise(0)).alias("stay"))
        come = flows.where("shard <> wish").groupBy(F.col("wish").alias("shard")).agg(F.sum("n").alias("come"))
        # those who wish to leave may be refused, so only room that stays free for certain is given away
        full = flows.groupBy("shard").agg(F.sum("n").alias("now"))
        rates = come.join(full, "shard", "left").select(
            F.col("shard").alias("wish"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(quota) - F.coalesce("now", F.lit(0))) / F.col("come"))).alias("rate")
        )
        moved = asked.join(F.broadcast(rates), "wish", "left")  # a row per shard
        go = (F.col("wish") != F.col("shard")) & (_hash01(F.col("rid"), salt=f"round{k}") < F.col("rate"))
        after = scratch(moved.select("rid", "hub", F.when(go, F.col("wish")).otherwise(F.col("shard")).alias("shard")), f"shard-round{k}")
        drop_scratch(after.sparkSession, now, wish)
        now = after
    return now


def shard_documents(frame: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, start_shard: one row per row of frame."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = frame.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
    )
    # a name for every row, whatever the order they come in; only fully repeated rows need their number
    number = F.row_number().over(W.partitionBy("doc_id", "text_key").orderBy(F.lit(0)))
    rid = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("text_key"), number.cast("string")))
    rows = scratch(slim.withColumn("rid", rid), "shard-rows")
    total = rows.count()
    quota = -(-total // shards)  # rounded up
    # written before it is joined, so that adaptive execution can split the rows of a hot text
    groups = scratch(rows.groupBy("text_key").agg(F.count("*").alias("members")).where("members > 1"), "shard-groups")
    start = F.floor(_hash01(F.col("rid"), salt="start") * shards).cast("int")
    placed = scratch(
        rows.join(groups, "text_key", "left").select("doc_id", "size", "text_crc32", "rid", "text_key", "members", start.alias("start_shard")), "shard-placed"
    )
    chunk = F.floor(_hash01(F.col("rid"), salt="chunk") * F.ceil(F.col("members") / F.lit(max(quota, 1))))
    linked = placed.where("members is not null").select("rid", F.xxhash64("text_key", chunk).alias("hub"), F.col("start_shard").alias("shard"))
    moved = propagate(linked, shards, quota, rounds)
    labeled = placed.join(moved.select("rid", "hub", F.col("shard").alias("new_shard")), "rid", "left").withColumn("shard", F.coalesce("new_shard", "start_shard"))

    # ranks inside shards: linked documents first, a group's side by side
    buckets = max(8, 2 * total // (shards * BUCKET_ROWS))
    place = F.when(F.col("hub").isNotNull(), _hash01(F.col("hub"), salt="order")).otherwise(1 + _hash01(F.col("rid"), salt="order"))
    # a chunk of a hot group can be a whole shard: its rows are spread over buckets of their own
    fine = F.when(F.col("members") > BUCKET_ROWS, F.floor(_hash01(F.col("rid"), salt="fine") * F.ceil(F.col("members") / F.lit(BUCKET_ROWS)))).otherwise(0)
    ordered = scratch(labeled.select("doc_id", "size", "text_crc32", "start_shard", "shard", "rid", "hub", F.floor(place * buckets).alias("bucket"), fine.alias("fine")), "shard-ordered")
    drop_scratch(ordered.sparkSession, rows, placed, moved, groups)
    counts = ordered.groupBy("shard", "bucket", "fine").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket", "fine").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    inside = F.row_number().over(W.partitionBy("shard", "bucket", "fine").orderBy("hub", "rid"))
    ranked = ordered.join(counts.select("shard", "bucket", "fine", before.alias("before")), ["shard", "bucket", "fine"]).withColumn("rank", F.col("before") + inside - 1)

    # per shard (as many rows as shards): its own quota, its overflow and its free slots as ranges of all overflow
    held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    own = [total // shards + (k < total % shards) for k in range(shards)]
    over_from, takers, over, free = [], [], 0, 0
    for k in range(shards):
        n, room = held.get(k, 0), max(0, own[k] - held.get(k, 0))
        over_from.append(over)
        over += max(0, n - own[k])
        if room:
            takers.append(F.struct(*(F.lit(v).cast("long").alias(name) for name, v in (("free_from", free), ("free", room), ("shard", k), ("n", n)))))
        free += room

    def of_shard(values: list[int]) -> Column:
        return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard"))

    cells = ranked.withColumn("own", of_shard(own))
    spill = F.when(F.col("rank") >= F.col("own"), of_shard(over_from) + F.col("rank") - F.col("own"))
    cells = cells.withColumn("spill", spill)
    kind = "struct<free_from:long,free:long,shard:long,n:long>"
    taker = F.get(F.filter(F.array(*takers).cast(f"array<{kind}>"), lambda t: (t["free_from"] <= F.col("spill")) & (F.col("spill") < t["free_from"] + t["free"])), F.lit(0))
    out = cells.withColumn("taker", F.when(F.col("spill").isNotNull(), taker))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.coalesce(F.col("taker.shard"), F.col("shard")).cast("int").alias("shard"),
        F.coalesce(F.col("taker.n") + F.col("spill") - F.col("taker.free_from"), F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start_shard",
    )


def op3_shard_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_shard_balanced": op3_shard_balanced}
ORACLE_SQL: dict[str, str] = {}
