"""Half-open ranges of a score and profiles of the rows in each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES


def limits(edges: Sequence[float] = EDGES, least: float | None = 0.0, most: float | None = 1.0) -> list[tuple[int, float | None, float | None]]:
    """(number, from, to) between the edges; None: without an end."""
    every = [least, *edges, most]
    return [(k, a, b) for k, (a, b) in enumerate(zip(every, every[1:], strict=False))]


def limits_table(spark: SparkSession, edges: Sequence[float] = EDGES, least: float | None = 0.0, most: float | None = 1.0) -> DataFrame:
    return spark.createDataFrame(limits(edges, least, most), "bucket int, lo double, hi double")


#: The level of ranges without an end, which all rows meet.
OPEN = 9999


def by_limits(rows: DataFrame, score: str, limits: DataFrame) -> DataFrame:
    """The rows with the ``bucket`` of each range [lo, hi) of the table (bucket, lo, hi) that holds their score, whatever their
    number and lengths; a null end is open. Ranges may overlap; a row in none is left out.

    A range lies in two cells at most of a grid whose step is the power of 2 from twice its length on. Rows look up
    their cell in the grids that occur, of which doubles allow some two thousand: an equality join, then the exact limits.
    """
    level = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.lit(OPEN)).otherwise(F.ceil(F.log2(F.col("hi") - F.col("lo"))).cast("int") + 1)
    held = limits.select("bucket", "lo", "hi").where("coalesce(lo < hi, true)").withColumn("_level", level)
    cell = lambda x: F.when(F.col("_level") == OPEN, F.lit(0)).otherwise(F.floor(x / F.pow(F.lit(2.0), F.col("_level"))))
    held = held.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("lo")), cell(F.col("hi"))))))
    steps = [r._level for r in held.select("_level").distinct().collect()]
    if not steps:
        return rows.join(held.select("bucket"), F.lit(False))
    x = F.col(score).cast("double")
    asked = rows.withColumn("_level", F.explode(F.array(*map(F.lit, steps)))).withColumn("_cell", cell(x))
    inside = (F.col("lo").isNull() | (x >= F.col("lo"))) & (F.col("hi").isNull() | (x < F.col("hi"))) & x.isNotNull() & ~F.isnan(x)
    return asked.join(held, ["_level", "_cell"]).where(inside).drop("_level", "_cell", "lo", "hi")


def bucket(score: Column, edges: Sequence[float] = EDGES) -> Column:
    """The range that holds the score; null below 0, from 1 on, and for null."""
    out = F.lit(None).cast("int")
    for k, lo, hi in reversed(limits(edges)):
        out = F.when((score >= lo) & (score < hi), F.lit(k)).otherwise(out)
    return out


def profile(df: DataFrame, score: Column, value: str) -> DataFrame:
    """(bucket, n, mean, std) in one pass over the rows."""
    own = df.withColumn("bucket", bucket(score)).where("bucket is not null")
    return own.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
