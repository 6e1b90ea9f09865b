"""A training history that grows by one row an epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "epoch int, train_loss double, val_loss double"


def append_history(spark: SparkSession, path: str, rows: list[tuple[int, float, float]]) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
