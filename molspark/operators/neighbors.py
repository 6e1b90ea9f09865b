"""Exact nearest neighbours, the fuzzy neighbour graph, and its layout."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from . import knnindex
from .metric import merged, nearest_k
from .ordering import numbered

#: Queries that every task may hold, by number and bytes; more go through the index.
BLOCK, BYTES = 5_000, 8 << 20
SCHEMA = "query long, id long, d2 double"


def _held(base: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, other_only: bool) -> DataFrame:
    """Few queries: every task has them all and keeps their k best of its rows."""
    held = base.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = held.value
        d, i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                some = pdf.iloc[at : at + 2048]
                own, x = some["id"].to_numpy(), np.stack(some["v"].to_numpy())
                found = [nearest_k(ids[n : n + 512], q[n : n + 512], own, x, k, other_only) for n in range(0, len(ids), 512)]
                d, i = merged(d, i, *(np.concatenate(p) for p in zip(*found, strict=True)), k)
        there = np.isfinite(d)
        yield pd.DataFrame({"query": np.repeat(ids, there.sum(axis=1)), "id": i[there], "d2": d[there]})

    return base.select("id", "v").mapInPandas(run, SCHEMA)


def nearest(base: DataFrame, queries: DataFrame, k: int = 1, other_only: bool = False) -> DataFrame:
    """(query, rank, id, d2): squared Euclidean distance, ties to the smaller id. Both sides are (id, v).

    Up to BLOCK queries of BYTES together, which are checked first, go to every task, and the last shuffle has k rows a query and
    task; more are searched through the index of ``knnindex``, which compares no pair that its bounds rule out.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("v")).first()
    if size.n > BLOCK or 8 * size.v > BYTES:
        return knnindex.nearest(base, queries, k, other_only)[0]
    rows = queries.select("id", "v").orderBy("id").collect()
    if not rows:
        return base.sparkSession.createDataFrame([], "query long, rank int, id long, d2 double")
    found = _held(base, np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], float), k, other_only)
    w = Window.partitionBy("query").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "d2")


def smooth_weights(graph: DataFrame, rounds: int = 64) -> DataFrame:
    """(query, id, w) of a graph of (query, id, d2): w = exp(-(d - rho) / sigma), 1 up to rho. rho is a query's least distance
    above 0; sigma, found by halving, makes its weights sum to log2 of its number of neighbours."""

    def run(batches):
        for pdf in batches:
            size = pdf["near"].map(len).to_numpy(int)
            there = np.arange(size.max(initial=1)) < size[:, None]
            d = np.zeros(there.shape)
            d[there] = np.sqrt([x["d2"] for near in pdf["near"] for x in near])
            rho = np.where(there & (d > 0), d, np.inf).min(axis=1)
            over = np.where(there, np.maximum(d - np.where(np.isinf(rho), 0.0, rho)[:, None], 0), np.inf)
            lo, hi, sigma, goal = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.log2(np.maximum(size, 2))
            for _ in range(rounds):
                high = np.exp(-over / sigma[:, None]).sum(axis=1) > goal
                lo, hi = np.where(high, lo, sigma), np.where(high, sigma, hi)
                sigma = np.where(np.isinf(hi), 2 * sigma, (lo + hi) / 2)
            sigma = np.maximum(sigma, np.maximum(1e-3 * d.sum(axis=1) / np.maximum(size, 1), 1e-12))
            w = np.exp(-over / sigma[:, None])[there]
            ids = np.array([x["id"] for near in pdf["near"] for x in near], np.int64)
            yield pd.DataFrame({"query": np.repeat(pdf["query"].to_numpy(), size), "id": ids, "w": w})

    own = graph.groupBy("query").agg(F.collect_list(F.struct("id", "d2")).alias("near"))  # as many as neighbours were asked for
    return own.mapInPandas(run, "query long, id long, w double")


def fuzzy_union(graph: DataFrame) -> DataFrame:
    """(a, b, w) for a < b: the weights of both directions (those given, else exp(-d2)) joined as w1 + w2 - w1 w2."""
    own = F.col("w") if "w" in graph.columns else F.exp(-F.col("d2"))
    w = graph.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), own.alias("w"))
    return w.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)).alias("w"))


def chance(*cols) -> Column:
    """A number in (0, 1) that a hash of the columns picks."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def hashed(*cols, seed: int = 42) -> np.ndarray:
    """xxhash64() of columns of longs, as the expression has it."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    cols, h = np.broadcast_arrays(*(np.asarray(c, np.int64) for c in cols)), np.uint64(seed)
    for c in cols:
        h = h + p[4] + np.uint64(8)
        h = turn(h ^ (turn(c.view(np.uint64) * p[1], 31) * p[0]), 27) * p[0] + p[3]
        h = (h ^ (h >> np.uint64(33))) * p[1]
        h = (h ^ (h >> np.uint64(29))) * p[2]
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def numbered_points(points: DataFrame, seed: int) -> DataFrame:
    """(id, slot, x, y) of distinct ids: numbered from 0 in the order of a hash, at normal places that a hash picks."""
    unit = lambda k: chance("id", F.lit(seed + k).cast("long"))
    far, turn, h = F.sqrt(F.lit(-2.0) * F.log(unit(0))), F.lit(2 * math.pi) * unit(1), F.xxhash64("id", F.lit(seed + 2).cast("long"))
    out = numbered(points.select("id"), F.struct(h.alias("h"), "id"), F.shiftright(h, 48), "slot")
    return out.select("id", (F.col("slot") - 1).alias("slot"), (far * F.cos(turn)).alias("x"), (far * F.sin(turn)).alias("y"))


def orthonormal(sums: dict) -> np.ndarray:
    """From sums of products with the trivial vector t (tt, tx, ty) and among x and y (xx, xy, yy): the matrix that takes (t, x, y)
    to x and y without their part along t, of length 1, y without its part along x."""
    t, x, y = sums["tx"] / sums["tt"], sums["xx"] - sums["tx"] ** 2 / sums["tt"], sums["xy"] - sums["tx"] * sums["ty"] / sums["tt"]
    x = max(x, 1e-300)
    c = y / x
    rest = max(sums["yy"] - sums["ty"] ** 2 / sums["tt"] - c * y, 1e-300)
    return np.array([[-t, 1.0, 0.0], [c * t - sums["ty"] / sums["tt"], -c, 1.0]]) / np.sqrt([[x], [rest]])


def dealt(df: DataFrame) -> DataFrame:
    """The rows as the side of a join that is shuffled and hashed part by part: points are never broadcast, as that takes all of
    them through the driver, once a step."""
    return df.hint("shuffle_hash")


def spectral_step(edges: DataFrame, points: DataFrame) -> DataFrame:
    """One power step of (id, slot, t, x, y) with half the identity and half the normalized graph (own, other, a): a join, and a row a point and task."""
    there = points.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pulled = edges.join(dealt(there), F.col("other") == F.col("_id")).groupBy("own").agg(*(F.sum(F.col("a") * F.col(f"_{c}")).alias(f"_{c}") for c in "xy"))
    return dealt(points).join(pulled, F.col("id") == F.col("own")).select("id", "slot", "t", *(((F.col(c) + F.col(f"_{c}")) / 2).alias(c) for c in "xy"))


def layout_step(edges: DataFrame, places: DataFrame, epoch: int, n: int, rate: float, negatives: int) -> DataFrame:
    """The places (id, slot, x, y) of n points after a step: of the edges (own, other, w), both ways, those that a hash picks with
    probability w pull ``own`` to ``other``, and as many points as ``negatives``, which a hash picks, push it away from each."""
    there = places.select(*(F.col(c).alias(f"_{c}") for c in places.columns))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    s = dx * dx + dy * dy
    held = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c)) * F.lit(rate)
    at = F.lit(epoch).cast("long")
    used = edges.where(chance("own", "other", at) < F.col("w")).join(dealt(places), F.col("own") == F.col("id"))
    pull = used.join(dealt(there), F.col("other") == F.col("_id"))
    pull = pull.select("id", *(held(F.lit(-2.0) * d / (F.lit(1.0) + s)).alias(k) for k, d in (("mx", dx), ("my", dy))))
    asked = used.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(negatives).cast("long"))))
    push = asked.withColumn("far", F.pmod(F.xxhash64("own", "other", at, "j"), F.lit(n))).join(dealt(there), F.col("far") == F.col("_slot"))
    push = push.select("id", *(held(F.lit(2.0) * d / ((F.lit(0.001) + s) * (F.lit(1.0) + s))).alias(k) for k, d in (("mx", dx), ("my", dy))))
    moves = pull.unionByName(push).groupBy(F.col("id").alias("mover")).agg(F.sum("mx").alias("mx"), F.sum("my").alias("my"))
    moved = places.join(dealt(moves), F.col("id") == F.col("mover"), "left")
    return moved.select("id", "slot", *((F.col(c) + F.coalesce(f"m{c}", F.lit(0.0))).alias(c) for c in "xy"))


def umap_layout(graph: DataFrame, epochs: int = 100, limit: int = 5000, seed: int = 42, power: int = 30, negatives: int = 3, rate: float = 0.3) -> DataFrame:
    """(id, x, y): a layout of the fuzzy graph of (query, id, d2).

    Points start from the two leading non-trivial vectors of the normalized graph, after ``power`` power steps, drawn to
    deviation 10. Each of ``epochs`` steps samples edges in proportion to their weights and points that push. Up to ``limit`` points
    (and 40 edges for each of these) are laid out on the driver. More stay distributed: shuffled joins a step, whose points are
    written to the shared folder, which cuts lineage, and never pass the driver. Both ways take the same steps.
    """
    spark = graph.sparkSession
    root = shared_folder(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    edges = kept(fuzzy_union(smooth_weights(graph)).where("w > 0"), "edges")
    edges = edges.select(F.col("a").alias("own"), F.col("b").alias("other"), "w").unionByName(edges.select(F.col("b").alias("own"), F.col("a").alias("other"), "w"))
    degree = edges.groupBy("own").agg(F.sqrt(F.sum("w")).alias("t"))
    degree = kept(degree.select(F.col("own").alias("id"), "t"), "degree")
    ends = [degree.select(F.col("id").alias(k), F.col("t").alias(t)) for k, t in (("own", "_t"), ("other", "_s"))]
    edges = kept(edges.join(dealt(ends[0]), "own").join(dealt(ends[1]), "other").select("own", "other", "w", (F.col("w") / (F.col("_t") * F.col("_s"))).alias("a")), "both")
    points = kept(numbered_points(degree, seed).join(dealt(degree), "id"), "points-0")
    n = points.count()
    if not n:
        return points.select("id", "x", "y")
    products = {a + b: F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("tt", "tx", "ty", "xx", "xy", "yy")}

    def turned(df: DataFrame) -> DataFrame:
        m = orthonormal(df.agg(*products.values()).first().asDict()).tolist()
        return df.select("id", "slot", "t", *((F.lit(a) * F.col("t") + F.lit(b) * F.col("x") + F.lit(c) * F.col("y")).alias(k) for k, (a, b, c) in zip("xy", m, strict=True)))

    wide = 10.0 * math.sqrt(n)
    if n > limit or edges.count() > 80 * limit:
        for p in range(power):  # of the points, the last two steps' are there at a time
            points = kept(spectral_step(edges, turned(points)), f"points-{(p + 1) % 2}")
        places = kept(turned(points).select("id", "slot", (F.col("x") * F.lit(wide)).alias("x"), (F.col("y") * F.lit(wide)).alias("y")), "places-0")
        for e in range(epochs):
            places = kept(layout_step(edges, places, e, n, rate * (1 - e / epochs), negatives), f"places-{(e + 1) % 2}")
        return places.select("id", "x", "y")
    start, links = points.orderBy("slot").toPandas(), edges.toPandas()
    slot = pd.Series(np.arange(n), index=start["id"].to_numpy())
    own, other = links["own"].to_numpy(), links["other"].to_numpy()
    a, b, w = slot[own].to_numpy(), slot[other].to_numpy(), links["w"].to_numpy()
    v = start[["t", "x", "y"]].to_numpy(float)

    def turn(v: np.ndarray) -> np.ndarray:
        g = v.T @ v
        v[:, 1:] = v @ orthonormal({"tt": g[0, 0], "tx": g[0, 1], "ty": g[0, 2], "xx": g[1, 1], "xy": g[1, 2], "yy": g[2, 2]}).T
        return v

    for _ in range(power):
        v = turn(v)
        v[:, 1:] = (v[:, 1:] + np.stack([np.bincount(a, links["a"].to_numpy() * v[b, c], n) for c in (1, 2)], 1)) / 2
    p = turn(v)[:, 1:] * wide
    for e in range(epochs):
        pace, used = rate * (1 - e / epochs), ((hashed(own, other, e) % (1 << 52)) + 0.5) / float(1 << 52) < w
        i, move = a[used], np.zeros_like(p)
        d = p[i] - p[b[used]]
        np.add.at(move, i, np.clip(-2 * d / (1 + (d**2).sum(1, keepdims=True)), -4, 4) * pace)
        for j in range(1, negatives + 1):
            d = p[i] - p[hashed(own[used], other[used], e, j) % n]
            s = (d**2).sum(1, keepdims=True)
            np.add.at(move, i, np.clip(2 * d / ((0.001 + s) * (1 + s)), -4, 4) * pace)
        p += move
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(start["id"], p, strict=True)], "id long, x double, y double")


def preserved(near: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(kept): the share of pairs (query, id) of ``near`` whose id is among the k points placed nearest to the query."""
    laid = nearest(*[places.select("id", F.array("x", "y").alias("v"))] * 2, k, other_only=True).select("query", "id")
    return near.select("query", "id").join(laid.withColumn("hit", F.lit(1)), ["query", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("kept"))
