"""Centroid clustering by exponion search, exact in integers.

A vector keeps an upper bound on the distance to its centroid and a lower bound on that to any other. Where
they don't settle the assignment, only centroids inside a ball around the vector's centroid are scanned, which a sorted
list of the distances between centroids gives at once. The ball's radius is inclusive, so ties are never lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, small_batches

K, ROUNDS, DIM, SCALE, SALT = 16, 3, 64, 64, "1"
#: Components below it have squared distances that fit 64 bits; larger ones are counted in Python's integers, and scanned in full.
SAFE = 1 << 27
#: Over the rounding of a square root; bounds are widened by it.
SLACK = 1e-9
LONG = (1 << 63) - 1


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers where they are small, Python's else."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 1e15 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


class Centroids:
    """The integer centroids of a round, the distances between them, and how far each moved since the round before."""

    def __init__(self, at: list[list[int]], before: list[list[int]] | None = None):
        self.small = all(abs(v) < SAFE for row in at for v in row)
        self.at = np.array(at, np.int64 if self.small else object).reshape(len(at), -1)
        self.ready = self.small and (before is None or all(abs(v) < SAFE for row in before for v in row))
        if self.small:
            gaps = np.sqrt(np.stack([squared(self.at, c) for c in self.at]).astype(float))
            np.fill_diagonal(gaps, -1.0)
            self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
            np.fill_diagonal(gaps, 0.0)
            self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.moved = np.zeros(len(at))
        if self.ready and before is not None:
            self.moved = np.sqrt(squared(self.at, np.array(before, np.int64)).astype(float)) * (1 + SLACK)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance, upper, lower) from all centroids; ties to the smaller number."""
        d = np.stack([squared(x, c) for c in (self.at if x.dtype != object else self.at.astype(object))], 1)
        near = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64) if d.dtype == object else d.argmin(axis=1)
        best = np.take_along_axis(d, near[:, None], 1)[:, 0]
        if d.dtype == object:  # no bounds: scanned again next time
            return near, best, np.full(len(x), np.inf), np.zeros(len(x))
        second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.full(len(x), LONG)
        return near, best, np.sqrt(best) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)

    def search(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The assignment from that of the round before and its bounds: (centroid, upper, lower, distances computed)."""
        if x.dtype == object or not self.ready:
            near, _, upper, lower = self.scan(x if self.small else x.astype(object))
            return near, upper, lower, x.shape[0] * len(self.at)
        near, upper = near.copy(), upper + self.moved[near]
        top = np.argsort(-self.moved, kind="stable")[:2]
        lower = lower - (np.where(near == top[0], self.moved[top[-1]], self.moved[top[0]]) if len(top) > 1 else 0.0)
        least = self.gaps[:, 0] if self.gaps.shape[1] else np.full(len(self.at), np.inf)
        sure = lambda i: (upper[i] < lower[i]) | (2 * upper[i] < least[near[i]] * (1 - SLACK))
        rows = np.flatnonzero(~sure(slice(None)))
        made, own = len(rows), squared(x[rows], self.at[near[rows]])
        upper[rows] = np.sqrt(own) * (1 + SLACK)
        still = ~sure(rows)
        rows, own = rows[still], own[still]
        was = near[rows]
        radius = (2 * upper[rows] + least[was]) * (1 + SLACK)
        for a in np.unique(was):
            here = np.flatnonzero(was == a)
            i = rows[here]
            inside = np.searchsorted(self.gaps[a], radius[here], side="right")
            best, which, second = own[here].copy(), np.full(len(i), a), np.full(len(i), LONG)
            for t in range(int(inside.max(initial=0))):
                j, on = self.order[a][t], np.flatnonzero(inside > t)
                d = squared(x[i[on]], self.at[j])
                made += len(on)
                closer = (d < best[on]) | ((d == best[on]) & (j < which[on]))
                second[on] = np.where(closer, best[on], np.minimum(second[on], d))
                best[on], which[on] = np.where(closer, d, best[on]), np.where(closer, j, which[on])
            near[i], upper[i], lower[i] = which, np.sqrt(best) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        return near, upper, lower, made

    def distances(self, x: np.ndarray, near: np.ndarray) -> list[int]:
        own = self.at if self.small and x.dtype != object else self.at.astype(object)
        return squared(x, own[near]).tolist()


def _vectors(b: pa.RecordBatch, column: int, dim: int, scale: int) -> np.ndarray:
    return whole(b.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim), scale)


def _assign(now: Centroids, dim: int, scale: int, first: bool):
    """(vec_id, embedding, near, upper, lower) to the same of this round."""

    def run(batches):
        for b in batches:
            x = _vectors(b, 1, dim, scale)
            if not now.small:
                x = x.astype(object)
            if first:
                near, _, upper, lower = now.scan(x)
            else:
                near, upper, lower, _ = now.search(x, *(b.column(i).to_numpy() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec_id", "embedding", "near", "upper", "lower"])

    return run


def _sums(dim: int, scale: int):
    """A task's sums by centroid and component in signed limbs of 32 bits, which add up without overflow; counts at component -1."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, near = _vectors(b, 1, dim, scale), b.column(2).to_numpy()
            for a in np.unique(near).tolist():
                own = np.append(x[near == a].sum(axis=0).astype(object), int((near == a).sum()))
                total[a] = total[a] + own if a in total else own
        rows = []
        for a, own in total.items():
            for d, v in enumerate(own.tolist()):
                sign, rest, limb = (-1 if v < 0 else 1), abs(v), 0
                while rest:
                    rows.append((a, d if d < dim else -1, limb, sign * (rest & 0xFFFFFFFF)))
                    rest, limb = rest >> 32, limb + 1
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["cluster", "dim", "limb", "value"]).astype({"cluster": "int32", "dim": "int32", "limb": "int32", "value": "int64"}), preserve_index=False)

    return run


def _distances(now: Centroids, dim: int, scale: int):
    def run(batches):
        for b in batches:
            near = b.column(2).to_numpy()
            d = now.distances(_vectors(b, 1, dim, scale), near) if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([min(v, LONG) for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def moved_centroids(state: DataFrame, at: list[list[int]], dim: int = DIM, scale: int = SCALE) -> list[list[int]]:
    """Each centroid's componentwise floor of the mean of its vectors; one without vectors stays."""
    sums = state.select("vec_id", "embedding", "near").mapInArrow(_sums(dim, scale), "cluster int, dim int, limb int, value long")
    total: dict[tuple[int, int], int] = {}
    for r in sums.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():  # centroids times components times limbs
        total[r.cluster, r.dim] = total.get((r.cluster, r.dim), 0) + (r.value << (32 * r.limb))
    return [[total.get((a, d), 0) // total[a, -1] for d in range(dim)] if (a, -1) in total else row for a, row in enumerate(at)]


def complete(dim: int = DIM, column: str = "embedding"):
    """A vector of ``dim`` components, none of them null or not finite."""
    c = F.col(column)
    return F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def cluster(spark: SparkSession, table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each row of ``table`` (vec_id, embedding) with a complete vector, and the centroids.

    Components become floor(scale * x). Centroids start as the ``k`` rows with the least sha256 of salt:vec_id (a null id as an
    empty one; ties by the vector) and are as many as there are rows if these are fewer; after ``rounds`` moves each row is
    assigned once more. Incomplete vectors give no row; repeated ids and vectors are rows of their own; without rows
    there are no centroids. Huge components are counted exactly; a distance beyond a long is given as the largest one.
    Other columns are not read. Rows are never shuffled: each round writes them with their bounds, and its sums are
    centroids times components a task.
    """
    scratch = Scratch(small_batches(spark))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(complete(dim))
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    at = [whole(np.array([r.embedding], float), scale)[0].tolist() for r in rows.orderBy(h, "embedding").limit(k).collect()]
    if not at:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    kind = dict(table.dtypes)["embedding"]
    schema = f"vec_id long, embedding {kind}, near int, upper double, lower double"
    state, before = rows, None
    for r in range(rounds + 1):
        state = scratch.save(state.mapInArrow(_assign(Centroids(at, before), dim, scale, r == 0), schema), f"round-{r}")
        if r:
            scratch.drop(f"round-{r - 1}")
        if r < rounds:
            before, at = at, moved_centroids(state, at, dim, scale)
    return state.select("vec_id", "embedding", "near").mapInArrow(_distances(Centroids(at), dim, scale), "vec_id long, cluster int, distance long"), at


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = cluster(spark, load(spark, sf_dir, "embeddings"))
    rows = Scratch(spark).save(found, "assigned")
    most = F.lit(LONG).cast("decimal(38,0)")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    per = rows.groupBy("cluster").agg(total("distance").alias("own")).collect()  # a row a centroid
    whole_, shas = sum(r.own for r in per), {a: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for a, v in enumerate(at)}
    facts = [(r.cluster, min(int(r.own), LONG), min(int(whole_), LONG), shas[r.cluster]) for r in per]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    d2 = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
    parts = [
        "e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1)::INT AS cluster, v FROM (SELECT * FROM e ORDER BY sha256('1:' || vec_id::VARCHAR) LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS rank FROM (SELECT a.vec_id, a.v, b.cluster, {d2}::BIGINT AS d2 FROM e a CROSS JOIN c{r} b)) WHERE rank = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS dim, unnest(v) AS x FROM a{r}) GROUP BY cluster, dim)")
            parts.append(f"m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY dim) AS v FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, a.cluster, d2 AS distance, (sum(d2) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(d2) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLE = _oracle()
