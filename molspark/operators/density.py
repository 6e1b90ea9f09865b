"""Densities of one column: equal-width histogram, valleys, range edges, kernel density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, col: str, bins: int = 125) -> DataFrame:
    """(bin, lo, n, density) of every bin, empty ones too; the last bin holds the maximum. Nulls are left out."""
    spark = df.sparkSession
    x = F.col(col).cast("double")
    lo, hi, total = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, n long, density double")
    step = (hi - lo) / bins or 1.0
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    found = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(found), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(step)).alias("lo"), "n", (F.col("n") / F.lit(total * step)).alias("density"))


def valleys(hist: DataFrame) -> DataFrame:
    """(bin): strict local minima of ``n``; a flat one reports the floor of its middle, and neither end counts.

    The windows run over the bins, whose number is fixed, not over the data.
    """
    w = Window.orderBy("bin")
    runs = hist.withColumn("new", (F.coalesce(F.lag("n").over(w) != F.col("n"), F.lit(True))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("run").agg(F.min("bin").alias("l"), F.max("bin").alias("u"), F.first("n").alias("n"))
    r = Window.orderBy("run")
    near = runs.withColumn("before", F.lag("n").over(r)).withColumn("after", F.lead("n").over(r))
    return near.where("before > n and after > n").select(F.floor((F.col("l") + F.col("u")) / 2).cast("int").alias("bin"))


def valley_edges(hist: DataFrame, picks: list[int]) -> DataFrame:
    """(pick, edge): the right edges of the valleys with these numbers, from 0; an error where there are fewer."""
    found = valleys(hist)
    if (n := found.count()) <= max(picks):
        raise ValueError(f"{n} valleys; number {max(picks)} was asked for")
    numbered = found.withColumn("pick", F.row_number().over(Window.orderBy("bin")) - 1).where(F.col("pick").isin(*picks))
    right = hist.select((F.col("bin") - 1).alias("bin"), F.col("lo").alias("edge"))
    return numbered.join(right, "bin").select("pick", "edge")


#: Bins to a bandwidth, moments kept of each, and the kernel's reach in bandwidths, beyond which it is below 1e-16 of its peak.
FINE, MOMENTS, REACH = 32, 6, 8.6


def kde(spark: SparkSession, df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """(point, x, density) on an even grid over the data: Gaussian kernels of Scott's bandwidth.

    One pass over the rows sums their number and moments by bins of 1/FINE bandwidth, in each task first; the kernel's Taylor
    series about a bin's middle then stands for the bin's rows, so the work on the grid doesn't grow with them. Its
    error is below 1e-12 of a kernel's peak. Bins and points meet by cells of the kernel's reach.
    """
    x = F.col(col).cast("double")
    lo, hi, sd, n = df.agg(F.min(x), F.max(x), F.stddev_samp(x), F.count(x)).first()
    if not n or not sd:
        return spark.createDataFrame([], "point int, x double, density double")
    h, step = sd * n ** (-1 / 5), (hi - lo) / (points - 1)
    z = (x - F.lit(lo)) / F.lit(h)
    at = F.floor(z * F.lit(float(FINE)))
    off = z - (at + F.lit(0.5)) / F.lit(float(FINE))
    held = df.where(x.isNotNull()).select(at.alias("bin"), off.alias("u"))
    bins = held.groupBy("bin").agg(*(F.sum(F.pow("u", F.lit(j)) if j else F.lit(1.0)).alias(f"m{j}") for j in range(MOMENTS)))
    bins = bins.withColumn("mid", (F.col("bin") + F.lit(0.5)) / F.lit(float(FINE))).withColumn("cell", F.floor(F.col("mid") / F.lit(REACH)))
    grid = spark.range(points).select(F.col("id").cast("int").alias("point"), (F.lit(lo) + F.col("id") * F.lit(step)).alias("x"))
    g = (F.col("x") - F.lit(lo)) / F.lit(h)
    near = F.explode(F.array(*(F.floor(g / F.lit(REACH)) + F.lit(k) for k in (-1, 0, 1))))
    met = grid.withColumn("g", g).withColumn("cell", near).join(bins, "cell")
    t = F.col("g") - F.col("mid")
    hermite = [F.lit(1.0), t]  # the kernel's derivatives by the bin's middle, over the kernel
    for j in range(2, MOMENTS):
        hermite.append(t * hermite[j - 1] - F.lit(float(j - 1)) * hermite[j - 2])
    series = sum((F.col(f"m{j}") * hermite[j] / F.lit(float(math.factorial(j))) for j in range(MOMENTS)), F.lit(0.0))
    sums = met.groupBy("point").agg(F.sum(F.exp(F.lit(-0.5) * t * t) * series).alias("s"))
    density = F.coalesce(F.col("s"), F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))
    return grid.join(sums, "point", "left").select("point", "x", F.greatest(density, F.lit(0.0)).alias("density"))
