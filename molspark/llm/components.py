"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

EDGES = "u long, v long"
SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Forest:
    """Union-find over arbitrary 64-bit ids; a root is the smallest id of its set."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        top, up = x, self.parent
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x], x = top, p
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        """(root, member) for each member but the roots."""
        pairs = [(self.find(x), x) for x in list(self.parent)]
        return [r for r, x in pairs if r != x], [x for r, x in pairs if r != x]


def local_stars(batches):
    """The spanning stars of the links that one task has: at most one row a node."""
    forest = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(u, v)
    u, v = forest.stars()
    for i in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000], pa.int64()), pa.array(v[i : i + 100_000], pa.int64())], schema=SCHEMA)


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m")
    kept = e.join(low, F.col("v") == F.col("k")).select("m", "u").where("m < u").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return kept.unionByName(low.select(F.col("m").alias("u"), F.col("k").alias("v"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has a link to another node.

    ``edges`` has ``u long, v long``; nulls and loops are left out, repeated links count once, and
    no links give no rows. Each round is written to the shared scratch folder, which cuts lineage.
    """
    tidy = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    now, mark, k = scratch.save(tidy.mapInArrow(local_stars, EDGES), "links-0"), None, 0
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or not got[0]:
            break
        mark, k = tuple(got), k + 1
        now = scratch.save(_small(_large(now)), f"links-{k}")
        scratch.drop(f"links-{k - 1}")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def blocks_of_equal(keys: np.ndarray) -> np.ndarray:
    """The bounds of the runs of equal values in a sorted array."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
