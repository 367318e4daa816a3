"""Frames that several plans read are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def kept(frame: DataFrame) -> DataFrame:
    """Written to the cluster's checkpoint folder, if it names one; else persisted (lost parts are computed again)."""
    if frame.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return frame.checkpoint()
    return frame.persist(StorageLevel.MEMORY_AND_DISK)
