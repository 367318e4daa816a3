"""QC counters over a stream of precursor rows: an extension, nothing in the batch operators needs it.

The counters are sums, so the batch tables and the windows of a stream agree once the watermark has passed.
State is one row per window and sample; late rows beyond the watermark are dropped by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(rows: DataFrame, time: str = "ts", sample: str = "user_id", value: str = "value", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, sample, n_rows, n_valued, total: works on a stream and on a table."""
    watched = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = watched.groupBy(F.window(time, every).alias("w"), F.col(sample).alias("sample")).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_valued"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), "sample", "n_rows", "n_valued", "total")
