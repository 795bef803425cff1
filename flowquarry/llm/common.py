"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where that is unset the warehouse; a temporary
    folder only in a session whose executors are the driver itself."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _MADE:
        _MADE.append(tempfile.mkdtemp(prefix="flowquarry-"))
        atexit.register(shutil.rmtree, _MADE[0], ignore_errors=True)
    return f"file://{_MADE[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/flowquarry/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a stashed table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        p = jvm.org.apache.hadoop.fs.Path(parent)
        p.getFileSystem(conf).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no table refers to: it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """``df``, whose whole texts Python is about to read: a session that still has Spark's Arrow batches of 10,000 rows
    gets smaller ones, since a batch of texts is held several times over in the executor and in its workers."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(rows))
    return df


def trim() -> None:
    """Give memory that is no longer used back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n (null ids count as the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser for uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(lengths: list[int], most: int):
    """Index ranges of consecutive rows holding about ``most`` characters each."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)
