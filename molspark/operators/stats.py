"""Column statistics over vectors: scaling, correlation, profiles. Feature matrices are (id, v array<double>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *keep)


def long_form(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("id", *keep, F.posexplode("v").alias("dim", "x"))


def width(df: DataFrame) -> int:
    return df.agg(F.max(F.size("v"))).first()[0] or 0


def per_dim(df: DataFrame, n: int, **made) -> DataFrame:
    """(dim, statistics ...) from one pass and one row: ``made`` maps a name to a function of a column."""
    aggs = [F.struct(F.lit(i).alias("dim"), *(f(F.get("v", F.lit(i))).alias(k) for k, f in made.items())) for i in range(n)]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def scaler_stats(df: DataFrame, n: int) -> DataFrame:
    """(dim, mu, sd): mean and population deviation; a constant column's deviation counts as 1."""
    return per_dim(df, n, mu=F.avg, sd=F.stddev_pop).withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def standardized(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, dim, z): a broadcast join on as many rows as there are features."""
    return long_form(df).join(F.broadcast(stats), "dim").select("id", "dim", ((F.col("x") - F.col("mu")) / F.col("sd")).alias("z"))


def restored(z: DataFrame, stats: DataFrame) -> DataFrame:
    return z.join(F.broadcast(stats), "dim").select("id", "dim", (F.col("z") * F.col("sd") + F.col("mu")).alias("x"))


def unscaled(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """The rows with v = z * sd + mu."""
    mu, sd = (F.array(*(F.lit(r[c]) for r in scale.orderBy("dim").collect())) for c in ("mu", "sd"))
    return rows.withColumn("v", F.zip_with(F.zip_with("v", sd, lambda x, s: x * s), mu, lambda x, m: x + m))


def correlation(df: DataFrame, n: int) -> DataFrame:
    """(i, j, corr) for i <= j, over the rows that have both; null where a column is constant on them, but for rounding.
    Sums about the columns' means, a row a pair and task."""
    mean = np.array([r.mu if r.mu is not None else 0.0 for r in per_dim(df, n, mu=F.avg).orderBy("dim").collect()], float)
    i, j = np.triu_indices(n)

    def partial(batches):
        s, rows = np.zeros((6, len(i))), 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([[np.nan if c is None else c for c in v] for v in pdf["v"]], float) - mean
            there = np.isfinite(x)
            x, t = np.where(there, x, 0.0), there.astype(float)
            full = (t.T @ t, x.T @ t, t.T @ x, (x * x).T @ t, t.T @ (x * x), x.T @ x)
            s, rows = s + np.stack([f[i, j] for f in full]), rows + len(x)
        if rows:
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), **dict(zip("n a b aa bb ab".split(), s, strict=True))})

    sums = df.select("v").mapInPandas(partial, "i int, j int, n double, a double, b double, aa double, bb double, ab double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")))
    va, vb, cov = (F.col(xy) - F.col(x) * F.col(y) / F.col("n") for x, y, xy in (("a", "a", "aa"), ("b", "b", "bb"), ("a", "b", "ab")))
    noise = F.array(*(F.lit((4.5e-16 * m) ** 2) for m in mean.tolist()))  # of a value next to its column's mean, squared
    varies = (va > F.element_at(noise, F.col("i") + 1) * F.col("n")) & (vb > F.element_at(noise, F.col("j") + 1) * F.col("n"))
    return sums.select("i", "j", F.when(varies, cov / (F.sqrt(va) * F.sqrt(vb))).alias("corr"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation, or null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_with(df: DataFrame, n: int, target: str) -> DataFrame:
    """(dim, corr) with one column: no more pairs than asked for."""
    return per_dim(df, n, corr=lambda x: safe_corr(x, F.col(target).cast("double")))


def nonconstant(df: DataFrame, n: int) -> DataFrame:
    return per_dim(df, n, sd=F.stddev_pop).where("sd > 0").select("dim")


def group_mean_std(df: DataFrame, n: int, group: str) -> DataFrame:
    """(group, dim, mean, std): sample deviations (null for one row), by group in one shuffle of partial sums."""
    aggs = [F.struct(F.lit(i).alias("dim"), F.avg(F.get("v", F.lit(i))).alias("mean"), F.stddev_samp(F.get("v", F.lit(i))).alias("std")) for i in range(n)]
    return df.groupBy(group).agg(F.array(*aggs).alias("s")).select(group, F.inline("s"))


def surviving_means(means: DataFrame, group: str, name: str, least: float = 0.05) -> DataFrame:
    """Means rounded half to even at 2 digits; features with any group's mean not above ``least`` are left out."""
    from ..functions.scalar import round_half_even

    rounded = means.withColumn("mean", round_half_even(F.col("mean")))
    masked = rounded.withColumn("mean", F.when(F.col("mean") > least, F.col("mean")))
    whole = masked.groupBy(name).agg(F.sum(F.col("mean").isNull().cast("int")).alias("gone")).where("gone = 0").select(name)
    return masked.join(F.broadcast(whole), name).select(group, name, "mean")
