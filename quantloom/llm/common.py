"""What the corpus operators share: table access, scratch tables in the shared folder, sized broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_scratch: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, so that extra columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session whose executors are threads of the driver gets one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_path(spark: SparkSession, path: str) -> None:
    if _scratch.pop(path, None) is not None:
        _delete(spark, path)


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes tables that scratch() wrote and that no later plan reads."""
    for frame in frames:
        if path := getattr(frame, "_scratch_path", None):
            drop_path(spark, path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_scratch.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster then
            pass


def own_scratch(spark: SparkSession, path: str) -> str:
    """Marks a path in the shared folder for deletion when the driver ends."""
    _scratch[path] = spark
    return path


def scratch(frame: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before them, and
    a plan that reads the table twice doesn't compute it twice.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._scratch_path = path
    own_scratch(spark, path)
    return out


def sized_broadcast(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast only if a count shows that it is small; the join shuffles otherwise.

    Meant for materialised, narrow frames, whose count costs a scan of their footers.
    """
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, and after it what it has freed goes back to the system: workers are reused, and idle ones would hold it."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped
