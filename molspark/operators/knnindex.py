"""Exact nearest neighbours through a metric index: pivots, distances to them, and the triangle inequality.

Rows belong to the cell of their nearest pivot; cells are laid into blocks of bounded size. A query is first searched in the
block of its own cell, which bounds how far its k-th neighbour can be; then it goes only to blocks with a cell that
may hold something nearer, and there it is compared only with rows whose distance to their pivot allows it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from .metric import Reached, approximate, closest, merged, nearest_k

#: Pivots at most, and the rows that each is chosen from; bytes of all these; rows of a block at most and at least; queries that one task compares with a block.
PIVOTS, SAMPLED, PIVOT_BYTES, ROWS, LEAST_ROWS, QUERIES = 1024, 8, 64 << 20, 50_000, 512, 40_000
#: Bounds are widened by it, over the rounding of distances.
SLACK = 1e-7
#: Queries and rows of a whole product, and the share of the rows that bounds must leave to queries for one.
TILE, SLICE, MANY = 256, 8192, 0.25
FOUND = "query long, block long, ids array<long>, d2 array<double>, pairs long"


@dataclass
class Index:
    """Pivots; by cell the least and greatest distance to its pivot, the first of its blocks and how many it has."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    block: np.ndarray
    parts: np.ndarray

    def to_pivots(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(approximate(q, self.pivots)[0], 0))

    def bounds(self, to: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What no row of a cell is nearer than, for each query: by its ring around the pivot, and as its rows are nearer to
        their own pivot than to the query's. size: the length scale on which distances are rounded."""
        ring = np.maximum(to - self.high, self.low - to)
        return np.maximum(np.maximum(ring, (to - to.min(axis=1, keepdims=True)) / 2), 0) - SLACK * size[:, None]


def scale_of(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt((q * q).sum(axis=1)) + np.sqrt((pivots * pivots).sum(axis=1).max(initial=0.0)) + 1e-300


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _unpacked(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v)).reshape(len(v), -1)


def _cells(pivots: np.ndarray):
    """The rows with their cell and the distance to its pivot; vectors go on as bytes."""

    def run(batches):
        for pdf in batches:
            near, r, v = np.zeros(len(pdf), np.int32), np.zeros(len(pdf)), []
            for at in range(0, len(pdf), 2048):
                x = _stack(pdf["v"].iloc[at : at + 2048])
                n, d2 = closest(x, pivots)
                near[at : at + 2048], r[at : at + 2048] = n, np.sqrt(d2)
                v += [y.tobytes() for y in x]
            yield pdf.assign(v=pd.Series(v, index=pdf.index, dtype=object), cell=near, r=r)

    return run


def spread_out(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """n rows at most, each drawn in proportion to its squared distance from those drawn before, so that every group of rows has some."""
    rng, d, picked = np.random.default_rng(seed), np.full(len(x), np.inf), [0]
    while len(picked) < n:
        d = np.minimum(d, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        if not d.any():
            break
        picked.append(int(np.searchsorted(np.cumsum(d), rng.random() * d.sum(), side="right").clip(max=len(x) - 1)))
    return np.unique(x[picked], axis=0)


def lay_out(count: np.ndarray, pivots: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: neighbouring cells share a block until it is full; a larger cell has several."""
    line = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(pivots.shape[1])
    block, parts, at, held = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), 0, 0
    for c in np.argsort(pivots @ line, kind="stable"):
        parts[c] = max(1, -(-int(count[c]) // rows))
        if held and held + count[c] > rows:
            at, held = at + 1, 0
        block[c], held = at, held + int(count[c])
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
    return block, parts


def search_block(index: Index, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, own: np.ndarray, x: np.ndarray, cell: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared distances, ids, pairs compared) of the k nearest rows of a block for each query, among those within ``reach``."""
    d, i, pairs, reach = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), np.zeros(len(q), np.int64), reach.copy()
    order = np.lexsort((r, cell))
    own, x, cell, r = own[order], x[order], cell[order], r[order]
    to, size = index.to_pivots(q), scale_of(q, index.pivots)
    least = index.bounds(to, size)
    there, starts = np.unique(cell, return_index=True)
    stops = np.append(starts[1:], len(cell))
    home = to[:, there].argmin(axis=1)
    for n in np.unique(home[np.isinf(reach)]) if len(there) > 1 else ():  # rows of a query's own cell bound how far it must look
        rows, more = np.flatnonzero((home == n) & np.isinf(reach)), max(0, k - int(stops[n] - starts[n]))
        s, e = max(0, starts[n] - more), min(len(own), stops[n] + more)
        reach[rows] = np.sqrt(nearest_k(ids[rows], q[rows], own[s:e], x[s:e], k)[0][:, k - 1]) * (1 + SLACK)
        pairs[rows] += e - s
    few, tiles, whole = np.ones(len(q), bool), np.argsort(home, kind="stable"), None
    for at in range(0, len(q), TILE):  # where bounds leave many rows, whole products cost less than choosing
        some = tiles[at : at + TILE]
        if ((least[some][:, there] <= reach[some, None]) @ (stops - starts)).mean() < MANY * len(own):
            continue
        whole = whole or Reached(own, x, index.pivots.mean(axis=0))
        few[some], ready = False, whole.asked(q[some])
        for a in (0, *range(1024, len(own), SLICE)):
            b = min(a + SLICE if a else 1024, len(own))
            got = whole.nearest_k(ids[some], q[some], ready, (reach[some] * (1 + SLACK)) ** 2, a, b, k)
            if np.isfinite(got[0]).any():
                d[some], i[some] = merged(d[some], i[some], *got, k)
                reach[some] = np.minimum(reach[some], np.sqrt(d[some, k - 1]) * (1 + SLACK))
            pairs[some] += b - a
    for n in np.argsort(least[:, there].min(axis=0), kind="stable") if few.any() else ():
        c, rc = there[n], r[starts[n] : stops[n]]
        rows = np.flatnonzero(few & (least[:, c] <= reach))
        rows = rows[np.argsort(to[rows, c], kind="stable")]
        for at in range(0, len(rows), 128):  # queries at like distances have like windows
            some = rows[at : at + 128]
            wide = reach[some] + SLACK * size[some]
            s, e = np.searchsorted(rc, (to[some, c] - wide).min()), np.searchsorted(rc, (to[some, c] + wide).max(), side="right")
            for a in range(starts[n] + s, starts[n] + e, 8192):
                b = min(a + 8192, starts[n] + e)
                d[some], i[some] = merged(d[some], i[some], *nearest_k(ids[some], q[some], own[a:b], x[a:b], k), k)
                pairs[some] += b - a
            reach[some] = np.minimum(reach[some], np.sqrt(d[some, k - 1]) * (1 + SLACK))
    return d, i, pairs


def _search(index: Index, k: int, whole: bool):
    """whole: a row for each query with its vector; else one for each that found something, and one for all the others' pairs."""

    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("query", "block", "ids", "d2", "pairs", *(["v"] if whole else []))}
        x = _unpacked(rows["v"]) if len(rows) else None
        for at in range(0, len(asked), 2048):
            some = asked.iloc[at : at + 2048]
            d, i, pairs = np.full((len(some), k), np.inf), np.zeros((len(some), k), np.int64), np.zeros(len(some), np.int64)
            if len(rows):
                d, i, pairs = search_block(index, some["query"].to_numpy(), _unpacked(some["v"]), some["reach"].to_numpy(), rows["id"].to_numpy(), x, rows["cell"].to_numpy(), rows["r"].to_numpy(), k)
            near = np.isfinite(d)
            kept = np.arange(len(some)) if whole else np.flatnonzero(near.any(axis=1))
            out["query"] += some["query"].to_numpy()[kept].tolist()
            out["ids"] += [i[n][near[n]] for n in kept]
            out["d2"] += [d[n][near[n]] for n in kept]
            out["pairs"] += pairs[kept].tolist()
            if whole:
                out["v"] += list(some["v"])
            elif len(kept) < len(some):
                out["query"].append(int(some["query"].iloc[0]))
                out["ids"].append(np.zeros(0, np.int64))
                out["d2"].append(np.zeros(0))
                out["pairs"].append(int(pairs.sum() - pairs[kept].sum()))
        out["block"] = [key[0]] * len(out["query"])
        return pd.DataFrame(out).astype({"query": "int64", "block": "int64", "ids": object, "d2": object, "pairs": "int64"})

    return run


def _meet(asked: DataFrame, homes: DataFrame, index: Index, k: int, whole: bool) -> DataFrame:
    """Queries (query, v, block, reach) with the rows of their blocks, which are sent once for every QUERIES queries of the block."""
    turns = F.broadcast(asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns")))  # a row a block of rows
    left = asked.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).drop("turns")
    right = homes.join(turns, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(_search(index, k, whole), FOUND + (", v binary" if whole else ""))


def _further(index: Index, k: int):
    """What round one found, to the other blocks where something as near may be."""

    def run(batches):
        first, last = index.block, index.block + index.parts
        spread = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        of = np.repeat(np.arange(len(first)), index.parts)
        blocks = np.unique(spread)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                q = _unpacked(some["v"])
                reach = np.array([np.sqrt(d[k - 1]) if len(d) >= k else np.inf for d in some["d2"]])
                near = index.bounds(index.to_pivots(q), scale_of(q, index.pivots)) <= reach[:, None]
                go = np.zeros((len(q), len(blocks)), bool)
                np.logical_or.at(go, (slice(None), np.searchsorted(blocks, spread)), near[:, of])
                go[np.arange(len(q)), np.searchsorted(blocks, some["block"].to_numpy())] = False
                row, b = np.nonzero(go)
                yield pd.DataFrame({"query": some["query"].to_numpy()[row], "v": some["v"].iloc[row].to_numpy(), "block": blocks[b], "reach": reach[row]})

    return run


def nearest(base: DataFrame, queries: DataFrame, k: int = 1, other_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query, rank, id, d2) of the k nearest rows of ``base`` for each row of ``queries``, both (id, v) with distinct ids, and
    (pairs): how many distances between a query and a row were computed. Ties go to the smaller id.

    Exact on any rows; how many pairs it saves depends on them: most where rows lie in groups, none where all are about
    equally far apart. Of equal vectors k + 1 rows can be near something, and equal queries are searched once, so a
    large group of copies costs what one row does. Blocks, queries to a block and pivots are bounded; a query is sent to
    each block at most once. Base is shuffled by its vectors and by block. Tables are written to the shared folder.
    """
    spark = base.sparkSession
    at = tables.shared_folder(spark)
    ask = k + 1 if other_only else k
    copies = Window.partitionBy("v").orderBy("id")
    thin = tables.written(base.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).withColumn("n", F.row_number().over(copies)).where(F.col("n") <= ask).drop("n"), f"{at}/base")
    asked = queries.select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    alike = asked.groupBy("v").agg(F.min("id").alias("query"))
    alike = tables.written(alike, f"{at}/queries")
    n = thin.count()
    if not n:
        none = spark.createDataFrame([], "query long, rank int, id long, d2 double")
        return none, spark.createDataFrame([(0,)], "pairs long")
    width = len(thin.select("v").first().v)
    most = min(PIVOTS, max(1, int(n**0.5)), max(1, PIVOT_BYTES // (8 * SAMPLED * max(width, 1))))
    pivots = spread_out(np.array([r.v for r in thin.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLED * most).collect()], float), most)
    rows = tables.written(thin.mapInPandas(_cells(pivots), "id long, v binary, cell int, r double"), f"{at}/cells")
    facts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).toPandas()  # a row a pivot
    count, low, high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    count[facts["cell"]], low[facts["cell"]], high[facts["cell"]] = facts["n"], facts["low"], facts["high"]
    index = Index(pivots, low, high, *lay_out(count, pivots, min(ROWS, max(LEAST_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))))
    where = F.broadcast(spark.createDataFrame([(c, int(b), int(p)) for c, (b, p) in enumerate(zip(index.block, index.parts, strict=True))], "cell int, first long, parts long"))
    part = lambda c: (F.col("first") + F.pmod(F.xxhash64(c), F.col("parts"))).alias("block")
    homes = rows.join(where, "cell").select(part("id"), "id", "v", "cell", "r")
    own = alike.mapInPandas(lambda b: _cells(pivots)(b), "v binary, query long, cell int, r double")
    own = own.join(where, "cell").select("query", "v", part("query"), F.lit(float("inf")).alias("reach"))
    one = tables.written(_meet(own, homes, index, ask, True), f"{at}/first")
    rest = tables.written(one.select("query", "v", "block", "d2").mapInPandas(_further(index, ask), "query long, v binary, block long, reach double"), f"{at}/asked")
    two = tables.written(_meet(rest, homes, index, ask, False), f"{at}/second")
    both = one.select("query", "ids", "d2", "pairs").unionByName(two.select("query", "ids", "d2", "pairs"))
    near = both.select("query", F.inline(F.arrays_zip("ids", "d2"))).withColumnRenamed("ids", "id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= ask)
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("near"))  # k + 1 at most
    names = asked.join(alike, "v").select(F.col("id").alias("own"), "query")  # each query and the one that stands for it
    kept = F.filter("near", lambda x: x["id"] != F.col("own")) if other_only else F.col("near")
    out = near.join(names, "query").select(F.col("own").alias("query"), F.posexplode(F.slice(kept, 1, k)).alias("rank", "x"))
    return out.select("query", (F.col("rank") + 1).cast("int").alias("rank"), "x.id", "x.d2"), both.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
