"""Helpers shared by the training-data operators: hashing, shared scratch tables, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A value that so small a part of all rows has, or a larger one, is joined by broadcast: there are at most as many.
HOT = 1000


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key() -> Column:
    """A 64-bit hash of the whole text, which tells rows of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and the master is local."""
    conf = spark.sparkContext.getConf()
    if found := (spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")):
        return found.rstrip("/")
    if (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared checkpoint folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """For tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_labels(rows: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``labels``, which has a row for each value of ``on`` that rows have, and the number ``n`` of
    those. Values that a HOT-th of all rows have are at most HOT: they are broadcast, so that no task gets all rows of
    one value; the rest meet by a shuffle. ``labels`` is read three times, so it should be a written table."""
    total = labels.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT >= total
    hot = F.broadcast(labels.where(is_hot).drop("n"))
    rest = rows.join(F.broadcast(labels.where(is_hot).select(on)), on, "left_anti").join(labels.where(~is_hot).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> SparkSession:
    """Bounds the bytes of an Arrow batch in this session, as texts may be long; returns the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if int(now.rstrip("kmg") or 0) * scale > limit or int(now.rstrip("kmg") or 0) <= 0:
        spark.conf.set(key, str(limit))
    return spark


def trim() -> None:
    """Gives a Python worker's freed memory back to the machine, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sha_of(spans: Column) -> Column:
    return F.sha2(spans.cast("binary"), 256)
