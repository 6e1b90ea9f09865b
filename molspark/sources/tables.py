"""Typed scans and sinks. Paths are any that Spark reads; a missing one raises Spark's PATH_NOT_FOUND."""

from __future__ import annotations

import ast
import csv
import logging
import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger("molspark")


@dataclass(frozen=True)
class Config:
    """Settings of the training and clustering plans; ``from_env`` reads literals, never code. The defaults are fixed values."""

    hidden_sizes: tuple[int, ...] = (16, 8)
    epochs: int = 256
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    step_size: int = 10
    gamma: float = 0.5
    test_share: float = 0.3
    seed: int = 42
    som_epochs: int = 128
    batch_size: int = 32
    steps: int = 0  # instead of batches, so many synchronous steps an epoch
    column_encoder: dict = field(default_factory=dict)
    dataset: str = ""
    model_path: str = ""

    @classmethod
    def from_env(cls) -> Config:
        found = {k: ast.literal_eval(v) for k, v in (("hidden_sizes", os.getenv("AUTOENCODER_HIDDEN_SIZE")), ("column_encoder", os.getenv("COLUMN_ENCODER"))) if v}
        found |= {k: v for k, v in (("dataset", os.getenv("TRAIN_DATASET_PATH")), ("model_path", os.getenv("AUTOENCODER_MODEL_PATH"))) if v}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = held.get()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/molspark-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table at the path: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, store = _path(spark, path)
    return store.exists(own)


def remove(spark: SparkSession, path: str) -> None:
    own, store = _path(spark, path)
    store.delete(own, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; of one that isn't there, none."""
    own, store = _path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(own)) if store.exists(own) else []


def _found(read, path: str | list[str]):
    try:
        return read()
    except AnalysisException as e:
        LOG.error("can't read %s: %s", path, e.getCondition())
        raise


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """A typed scan of CSV files with a header. A missing path is logged and raises Spark's PATH_NOT_FOUND at once."""
    return _found(lambda: spark.read.schema(schema).option("header", True).csv(path), path)


def read_csv_in_order(spark: SparkSession, path: str | list[str], schema: T.StructType | str, name: str = "row", group: tuple[str, str] | None = None) -> DataFrame:
    """``read_csv`` with each row's place in the file, from 0; files follow one another by path. group: a column's name and a
    pattern whose first group finds that column's number in a file's path; places then start anew in each of these groups, all of
    which are read in one scan.

    A scan's partition holds pieces of files, each whole and in its order, so a row's place in its piece is its number in the
    partition less the piece's first one. One pass counts the pieces; a row a piece is broadcast; rows aren't shuffled.
    """
    scan = read_csv(spark, path, schema)
    rows = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_number", F.monotonically_increasing_id())
    pieces = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_number").alias("_first"))
    of = F.regexp_extract("_file", group[1], 1).cast("int") if group else F.lit(0)
    before = Window.partitionBy(of).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    own = [of.alias(group[0])] if group else []
    starts = pieces.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(starts), ["_file", "_block"]).select((F.col("_number") + F.col("_shift")).alias(name), *own, *(f"`{c}`" for c in scan.columns))


def log_to(path: str) -> logging.Handler:
    """Sends what the package logs to a file of the driver as well; returns the handler, for ``LOG.removeHandler``."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    return handler


def write_csv(df: DataFrame, path: str, index: bool = False) -> None:
    """Overwrites. index: with a leading row number from 0 in the order of the columns, as for spreadsheets; that is for
    small results, which go to one file."""
    if index:
        order = Window.orderBy(*df.columns)
        df = df.select((F.row_number().over(order) - 1).cast("long").alias("index"), "*").coalesce(1).sortWithinPartitions("index")
    df.write.mode("overwrite").option("header", True).csv(path)


def write_groups(df: DataFrame, path: str, key: str) -> None:
    """One folder for each value of the key."""
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def read_groups(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """All groups in one scan, whose key is a partition column: a filter or a join on it leaves out the other groups' files."""
    held = T.StructType([f for f in schema.fields if f.name != key] + [T.StructField(key, T.IntegerType())])
    return read_csv(spark, path, held)


def read_csv_first_named(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV table whose header names some columns twice or more: the first of each name, in the header's order, as ``types`` says
    and as a string else. Columns are read by their place, so neither names that differ in case only nor empty ones clash."""
    header = _found(lambda: spark.read.text(path).first(), path)
    names = next(csv.reader([header.value])) if header else []
    whole = ", ".join(f"_{i} {types.get(c, 'string')}" for i, c in enumerate(names))
    rows = spark.read.schema(whole).option("header", True).option("enforceSchema", True).csv(path) if names else spark.createDataFrame([], T.StructType([]))
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c not in names[:i]))


def write_report(df: DataFrame, path: str) -> None:
    """A small text report: one line a row."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns))).coalesce(1).write.mode("overwrite").text(path)
