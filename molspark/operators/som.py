"""Batch self-organizing maps: neurons are a small table, rows stay distributed; maps of many groups are trained together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metric import closest
from .stats import per_dim

RADIUS = math.sqrt(61)
#: Rows compared at a time.
SLICE = 2048
Maps = dict[int, np.ndarray]


def first_rows(df: DataFrame, n: int) -> np.ndarray:
    return np.array([r.v for r in df.orderBy("id").limit(n).collect()], float)


def starting(df: DataFrame, n: int, how: str = "first", seed: int = 42) -> np.ndarray:
    """Neurons to start from. ``first``: the first rows; ``kde``: draws from a Gaussian density estimate, that is, rows that a hash
    picks, moved by noise of Scott's width in each dimension. Fewer rows repeat."""
    if how == "first":
        return first_rows(df, n)
    rows = np.array([r.v for r in df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()], float)
    count = df.count()
    spread = np.array([r.sd or 0.0 for r in per_dim(df, rows.shape[1], sd=F.stddev_samp).orderBy("dim").collect()])
    return moved(np.resize(rows, (n, rows.shape[1])), spread, count, seed)


def moved(rows: np.ndarray, spread: np.ndarray, count: int, seed: int) -> np.ndarray:
    return rows + np.random.default_rng(seed).standard_normal(rows.shape) * spread * count ** (-1 / (rows.shape[1] + 4))


def starting_groups(df: DataFrame, group: str, n: int, how: str = "first", seed: int = 42) -> Maps:
    """``starting`` of every group at once: a ranking that keeps n rows a group, and for ``kde`` one aggregate by group."""
    order = ["id"] if how == "first" else [F.xxhash64("id", F.lit(seed)), "id"]
    ranked = df.select(group, "id", "v").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
    picked: dict[int, list] = {}
    for r in ranked.orderBy(group, "rank").collect():  # n rows a group
        picked.setdefault(r[group], []).append(r.v)
    out = {g: np.resize(np.array(v, float), (n, len(v[0]))) for g, v in picked.items()}
    if how == "first" or not out:
        return out
    width = next(iter(out.values())).shape[1]
    sd = F.array(*(F.coalesce(F.stddev_samp(F.get("v", F.lit(i))), F.lit(0.0)) for i in range(width)))
    facts = df.groupBy(group).agg(F.count("*").alias("n"), sd.alias("sd")).collect()  # a row a group
    return {r[group]: moved(out[r[group]], np.array(r.sd), r.n, seed) for r in facts}


def _units(pdf: pd.DataFrame, maps: Maps, group: str | None):
    """(rows, vectors, neurons, squared distances) of a batch, by group and slice."""
    parts = [(0, np.arange(len(pdf)))] if group is None else list(pdf.groupby(group).indices.items())
    for g, rows in parts:
        for at in range(0, len(rows) if g in maps else 0, SLICE):
            some = rows[at : at + SLICE]
            x = np.stack(pdf["v"].iloc[some].to_numpy())
            yield g, some, x, *closest(x, maps[g])


def bmu(df: DataFrame, neurons: np.ndarray | Maps, *keep: str, group: str | None = None) -> DataFrame:
    """(id, keep ..., neuron, d2): the closest neuron (ties: the first), in Arrow batches. With a group, that of the group's
    own map; rows whose group has none are left out."""
    maps = {0: neurons} if group is None else neurons
    held = list(dict.fromkeys([*keep, *([group] if group else [])]))

    def run(batches):
        for pdf in batches:
            near, dist = np.full(len(pdf), -1, np.int32), np.zeros(len(pdf))
            for _, rows, _, n, d in _units(pdf, maps, group):
                near[rows], dist[rows] = n, d
            out = pdf[["id", *held]].copy()
            out["neuron"], out["d2"] = near, dist
            yield out[out["neuron"] >= 0]

    types = dict(df.dtypes)
    return df.select("id", "v", *held).mapInPandas(run, ", ".join(["id long", *(f"`{c}` {types[c]}" for c in held), "neuron int", "d2 double"]))


def kernel(m: int, n: int, radius: float) -> np.ndarray:
    g = np.stack(np.meshgrid(np.arange(m), np.arange(n), indexing="ij"), -1).reshape(-1, 2)
    return np.exp(-((g[:, None] - g[None]) ** 2).sum(-1) / (2 * radius**2))


def packed(df: DataFrame, group: str | None = None) -> DataFrame:
    """(g, v): the bytes of the vectors of a group, SLICE of them at most. Every epoch reads the rows, and reads bytes as they are."""

    def run(batches):
        for pdf in batches:
            for g, rows in [(0, np.arange(len(pdf)))] if group is None else pdf.groupby(group).indices.items():
                for at in range(0, len(rows), SLICE):
                    x = np.stack(pdf["v"].iloc[rows[at : at + SLICE]].to_numpy()).astype(float)
                    yield pd.DataFrame({"g": [g], "v": [x.tobytes()]})

    return df.select("v", *([group] if group else [])).mapInPandas(run, "g long, v binary")


def sums(rows: DataFrame, maps: Maps) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each group the sums and numbers of its ``packed`` rows by closest neuron, and its rows' mean distance: one pass over all
    groups, of which a task sends one row for each neuron that it met."""
    k, dim = next(iter(maps.values())).shape

    def run(batches):
        total = {g: np.zeros((k, dim + 2)) for g in maps}
        for pdf in batches:
            for g, v in zip(pdf["g"], pdf["v"], strict=True):
                if g in maps:
                    x = np.frombuffer(v).reshape(-1, dim)
                    near, d = closest(x, maps[g])
                    np.add.at(total[g], near, np.concatenate([x, np.ones((len(x), 1)), np.sqrt(d)[:, None]], 1))
        for g, t in total.items():
            own = np.flatnonzero(t[:, dim])
            yield pd.DataFrame({"g": np.full(len(own), g), "neuron": own.astype("int32"), "s": pd.Series(list(t[own]), dtype=object)})

    sent = rows.mapInPandas(run, "g long, neuron int, s array<double>")
    total = sent.select("g", "neuron", F.posexplode("s").alias("i", "x")).groupBy("g", "neuron", "i").agg(F.sum("x").alias("x")).toArrow()  # groups times neurons times width
    g, neuron, i, x = (c.to_numpy() for c in total.columns)
    out = {own: np.zeros((k, dim + 2)) for own in maps}
    for own, held in out.items():
        held[neuron[g == own], i[g == own]] = x[g == own]
    return {g: (t[:, :dim], t[:, dim], float(t[:, dim + 1].sum() / max(t[:, dim].sum(), 1))) for g, t in out.items()}


def means(s: np.ndarray, c: np.ndarray, neurons: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Neighbourhood means; a neuron that no row reaches stays."""
    weight = h @ c
    return np.where(weight[:, None] > 0, (h @ s) / np.maximum(weight, 1e-300)[:, None], neurons)


def epoch(df: DataFrame, neurons: np.ndarray, m: int = 10, n: int = 10, radius: float = RADIUS) -> np.ndarray:
    """One batch step."""
    s, c, _ = sums(packed(df), {0: neurons})[0]
    return means(s, c, neurons, kernel(m, n, radius))


def neuron_table(spark: SparkSession, neurons: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, d, float(x)) for i, w in enumerate(neurons) for d, x in enumerate(w)], "neuron int, dim int, w double")


def train_groups(df: DataFrame, group: str | None, start: Maps, m: int = 10, n: int = 10, epochs: int = 10, radius: float = RADIUS, rate: float = 1.0) -> tuple[Maps, dict[int, list[float]]]:
    """The maps of all groups after ``epochs`` steps with a shrinking radius, and each one's mean quantization error before
    each step. An epoch is one pass over (group, v), whatever the number of groups, which yields the sums and the errors
    together. Fewer starting neurons than m * n repeat. rate: how far the first step moves the neurons towards their
    means; the rate falls to 0 with the epochs, and at 1 stays 1. ``df`` is packed once and held as bytes, which every
    epoch reads: give a written table, from which a lost executor's rows are read again."""
    maps = {g: np.resize(w, (m * n, w.shape[1])) for g, w in start.items()}
    errors: dict[int, list[float]] = {g: [] for g in maps}
    held = packed(df, group).persist()
    try:
        for e in range(epochs if maps else 0):
            pace, h = 1.0 if rate >= 1 else rate * (1 - e / epochs), kernel(m, n, max(0.5, radius * (1 - e / epochs)))
            for g, (s, c, error) in sums(held, maps).items():
                errors[g].append(error)
                maps[g] = maps[g] + pace * (means(s, c, maps[g], h) - maps[g])
    finally:
        held.unpersist()
    return maps, errors


def train(df: DataFrame, m: int = 10, n: int = 10, epochs: int = 10, radius: float = RADIUS, start: np.ndarray | None = None, rate: float = 1.0) -> tuple[np.ndarray, list[float]]:
    """``train_groups`` of one map; ``start``: neurons, as from ``starting`` or another map; else the first rows."""
    df = df.persist()
    try:
        maps, errors = train_groups(df, None, {0: first_rows(df, m * n) if start is None else start}, m, n, epochs, radius, rate)
    finally:
        df.unpersist()
    return maps[0], errors[0]
