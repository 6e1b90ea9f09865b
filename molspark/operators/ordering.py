"""Order-dependent operators without one task that holds all rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that deal rows into parts: 65,536 of them.
DIGITS = 4


def numbered(df: DataFrame, key: Column, part: Column, name: str = "row") -> DataFrame:
    """Adds the row's place (from 1) by ``part``, then ``key``: ranks within parts plus the rows of the parts before.

    ``part`` must not fall as ``key`` rises; give it enough values to spread the rows (a prefix of a hash, a
    place between quantiles). Only the parts' counts meet in one task.
    """
    rows = df.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    return ranked.join(starts, F.col("_part") == F.col("_p")).withColumn(name, F.col("_k") + F.col("_start")).drop("_part", "_p", "_k", "_start")


def shuffled(df: DataFrame, id_col: str, *salt: str, name: str = "row") -> DataFrame:
    """Numbers rows in the order of md5(id, salt ...): a shuffle that any engine repeats."""
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), *map(F.lit, salt)).cast("binary"))
    out = df.withColumn("_h", h)
    return numbered(out, F.struct("_h", id_col), F.substring("_h", 1, DIGITS), name).drop("_h")


def exact_split(df: DataFrame, id_col: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: exactly ceil(share * rows) of them."""
    n = df.count()
    return shuffled(df, id_col, str(seed)).withColumn("is_test", F.col("row") <= -int(-share * n // 1)).drop("row")


def minibatches(df: DataFrame, id_col: str, epoch: int, size: int = 32, seed: int = 42) -> DataFrame:
    """Adds ``batch``, from 0; the last may be smaller. Another epoch is another order."""
    return shuffled(df, id_col, str(seed), str(epoch)).withColumn("batch", F.floor((F.col("row") - 1) / size).cast("int")).drop("row")


def by_position(df: DataFrame, key: str, rows: int = 1_000_000, most: int = 10_000) -> DataFrame:
    """Adds ``row``: the place by a whole-number key, however its values lie. Parts of about ``rows`` rows, ``most`` at
    most, are cut at quantiles of the key, which alone come to the driver."""
    n = df.count()
    parts = min(most, -(-n // rows))
    if parts < 2:
        return numbered(df, F.col(key), F.lit(0), "row")
    at = [i / parts for i in range(1, parts)]
    bounds = sorted({float(x) for x in df.agg(F.percentile_approx(F.col(key).cast("double"), at, 10 * parts)).first()[0]})
    held = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_key", outputCol="_bin").transform(held).drop("_key")
    return numbered(cut, F.col(key), F.col("_bin"), "row").drop("_bin")


def running_best(df: DataFrame, order: str, loss: str) -> DataFrame:
    """Adds the least loss before and whether this is less. For histories: one row an epoch."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("best_before", F.min(loss).over(before))
    return out.withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def steplr(spark, epochs: int = 256, rate: float = 1e-3, step: int = 10, gamma: float = 0.5) -> DataFrame:
    return spark.range(epochs).select(F.col("id").cast("int").alias("epoch"), (F.lit(rate) * F.pow(F.lit(gamma), F.floor(F.col("id") / step).cast("double"))).alias("lr"))
