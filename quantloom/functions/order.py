"""Places in a global order and running extremes, without one task that sees all rows.

Rows are sorted by range (every partition a piece of the order) and kept; an id that counts within the
partition and one number for each partition, summed over the partitions, give the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.storage import kept

_BITS = 33  # of a monotonically increasing id, within a partition


def placed(frame: DataFrame, *order: Column | str, place: str = "place") -> DataFrame:
    """frame with `place` (from 1) in the given order, which should be one without ties, and `_piece`."""
    own = kept(frame.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    own = own.withColumn("_piece", F.shiftright("_at", _BITS)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)))
    counts = own.groupBy("_piece").agg(F.count("*").alias("_n"))  # a row per partition
    before = F.sum("_n").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    return own.join(F.broadcast(counts.select("_piece", before.alias("_before"))), "_piece").withColumn(place, F.col("_before") + F.col("_at") + 1).drop("_at", "_before")


def least_from_here(frame: DataFrame, value: str, out: str, by: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """Adds the least value of this and all later places (of the same group); frame comes from placed(), groups in a row."""
    inside = W.partitionBy("_piece", *by).orderBy(F.col(place).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = frame.groupBy("_piece", *by).agg(F.min(value).alias("_least"))  # a row per partition and group
    later = F.min("_least").over(W.partitionBy(*by).orderBy(F.col("_piece").desc()).rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select("_piece", *by, later.alias("_later"))
    own = frame.withColumn("_own", F.min(value).over(inside))
    met = own.alias("a").join(pieces.alias("b"), [F.col("a._piece") == F.col("b._piece"), *(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by)])
    return met.select("a.*", "_later").withColumn(out, F.least("_own", "_later")).drop("_own", "_later")


def sums_so_far(frame: DataFrame, values: dict[str, Column], place: str = "place") -> DataFrame:
    """Adds running sums (this place included) of expressions, by name; frame comes from placed()."""
    named = frame.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    inside = W.partitionBy("_piece").orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = named.groupBy("_piece").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(values))))
    earlier = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("_piece", *(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(values))))
    own = named.withColumns({f"_v{i}": F.sum(f"_v{i}").over(inside) for i in range(len(values))}).join(F.broadcast(pieces), "_piece")  # a row per partition
    return own.withColumns({name: F.col(f"_v{i}") + F.col(f"_b{i}") for i, name in enumerate(values)}).drop(*(f"_{k}{i}" for k in "vb" for i in range(len(values))))


def value_at(values: DataFrame, share: float, buckets: int = 4096, few: int = 20000) -> float | None:
    """The exact percentile of one column of numbers, between two of them in proportion; None without any.

    The range that holds the rank is cut into buckets and counted until few values are left in it, or one value.
    """
    name = values.columns[0]
    x = F.col(name)
    own = values.where(x.isNotNull())
    total, low, high = own.agg(F.count("*"), F.min(name), F.max(name)).first()
    if not total:
        return None
    at = share * (total - 1)
    below, left = 0, total  # values under low, and from low to high
    while low < high and left > few:
        width = (high - low) / buckets
        bucket = F.least(F.floor((x - low) / width), F.lit(buckets - 1)) if width > 0 else F.when(x > low, 1).otherwise(0)
        counts = own.where((x >= low) & (x <= high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).orderBy("b").collect()  # a row per bucket
        for i, c in enumerate(counts):
            if below + c["n"] > int(at):
                break
            below += c["n"]
        low, high, left = c["low"], c["high"], c["n"]
        after = counts[i + 1]["low"] if i + 1 < len(counts) else None
        if int(at) == below + left - 1 < at:  # the next value lies in another bucket
            after = own.where(x > high).agg(F.min(name)).first()[0] if after is None else after
            return high + (at - int(at)) * (after - high)
    if low == high:
        return float(low)
    rest = sorted(r[0] for r in own.where((x >= low) & (x <= high)).collect())
    first, second = rest[int(at) - below], rest[min(int(at) + 1 - below, len(rest) - 1)]
    return float(first + (at - int(at)) * (second - first))
