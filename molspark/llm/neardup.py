"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. As a window that holds a pair at the threshold holds a large
share of all unrelated vectors too, projections come in groups: the windows of a group are laid out as a randomly shifted
grid, and rows are sorted by cell, so that vectors whose projections collide throughout a group lie next to each other.
Around each row, window collisions over one projection of every group are counted for each pair in its cell, first on
at most FILTER of these projections rounded to a byte, which alone travel. Vectors follow to the cells where they have a partner that
reaches the count which pairs at the threshold reach almost surely; there the pairs are counted and verified exactly.
A pair counts in the first group in which it shares a cell, so each link counts once; therefore a cell must leave out no
pair for reasons of its own group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, mix64, small_batches, trim, with_labels
from .components import Forest, blocks_of_equal, connected_components

THRESHOLD, MISS, SEED = 0.9, 0.002, 20
#: Cell width; vectors of a cell that one block compares; half-width of a counting window in standard deviations of a pair at the threshold.
WIDTH, BLOCK, SPAN = 2.0, 4096, 2.5
#: Projections that travel with a vector to each of its cells: groups grow with the table, so all of them would make bytes a vector grow with their square.
FILTER = 64
FAR = 0.45  # the share of unrelated pairs that meet in one projection's cell
#: Width of a rounded projection's step (a byte reaches to 6.35, and what lies beyond counts as nearer), and the size up to which cells are compared together.
STEP, SHORT = 0.05, 64


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections in a group, groups): cells hold about 30 unrelated vectors, and a pair at the threshold
    meets in no group with probability MISS at most."""
    gap = math.sqrt(2 - 2 * threshold)
    t = WIDTH / gap
    meet = math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))
    k = max(4, math.ceil(math.log(max(n, 2) / 30, 1 / FAR)))
    return k, math.ceil(math.log(MISS) / math.log(1 - meet**k))


def least_count(groups: int) -> int:
    """Collisions over ``groups`` windows that a pair at the threshold has with probability 1 - MISS / 10 at least."""
    p, below = math.erf(SPAN / math.sqrt(2)), 0.0
    for c in range(groups + 1):
        below += math.comb(groups, c) * p**c * (1 - p) ** (groups - c)
        if below > MISS / 10:
            return c
    return groups


class Projections:
    def __init__(self, dim: int, k: int, groups: int):
        rng = np.random.default_rng([SEED, dim])
        self.k, self.groups = k, groups
        self.lines, self.shift = rng.standard_normal((dim, k * groups)), rng.random(k * groups) * WIDTH
        self.firsts = np.ascontiguousarray(self.lines[:, ::k])
        self.coef = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def along(self, unit: np.ndarray) -> np.ndarray:
        """One projection of each group."""
        return unit @ self.firsts

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """[vector, group]: 64-bit names of the cells."""
        at = np.floor((unit @ self.lines + self.shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), self.groups, self.k)
        h = (at * self.coef).sum(axis=2, dtype=np.uint64)
        return mix64(h + mix64(np.arange(1, self.groups + 1, dtype=np.uint64))[None, :] + np.uint64(self.lines.shape[0]))


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as doubles at length one, and the lengths before."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), x


def valid(column: str = "embedding"):
    """A vector that takes part: not null, not empty, all components finite, not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def _deal(k: int, groups: int, whole: bool, most: int = FILTER):
    """Rows by cell: with the first ``most`` rounded projections, or only the cell's name."""

    def run(batches):
        by_dim: dict[int, Projections] = {}
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy()) if len(b) else np.zeros(0, int)
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                own = by_dim.setdefault(int(dim), Projections(int(dim), k, groups))
                for at in range(0, len(part), 1024):
                    some = part.slice(at, 1024)
                    unit = units(some.column(1))[0]
                    cells = own.cells(unit).view(np.int64)
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel())], names=["cell"])
                        continue
                    rounded = np.clip(np.rint(own.along(unit)[:, :most] / STEP), -127, 127).astype(np.int8)
                    codes = pa.array([r.tobytes() for r in rounded], pa.binary())
                    for g in range(groups):
                        yield pa.RecordBatch.from_arrays([pa.array(cells[:, g]), pa.array(np.full(len(some), g, np.int32)), some.column(0), codes], names=["cell", "g", "rep", "code"])

    return run


def close_pairs(cell: np.ndarray, side: np.ndarray, along: np.ndarray, reach: float, need: int):
    """Of rows sorted by (cell, side): pairs (left, right) of places in one cell, of other sides if it has sides, whose
    projections collide in a window at least ``need`` times. In pieces of bounded size."""
    bounds = blocks_of_equal(cell)
    size = np.diff(bounds)
    short = np.repeat(size <= SHORT, size)
    for k in range(1, min(SHORT, int(size.max(initial=1)))):
        at = np.flatnonzero((cell[k:] == cell[:-k]) & short[k:] & ~((side[k:] > 0) & (side[k:] == side[:-k])))
        for i in range(0, len(at), 65536):
            some = at[i : i + 65536]
            some = some[(np.abs(along[some] - along[some + k]) <= reach).sum(axis=1) >= need]
            yield some, some + k
    for c in np.flatnonzero(size > SHORT):
        lo, hi = bounds[c], bounds[c + 1]
        for i0 in range(lo, hi, 256):
            left, right = np.arange(i0, min(hi, i0 + 256)), np.arange(i0, hi)
            count = np.zeros((len(left), len(right)), np.int16)
            for line in along.T:
                count += np.abs(line[left][:, None] - line[right][None, :]) <= reach
            a, b = np.nonzero((count >= need) & (right[None, :] > left[:, None]) & ~((side[left][:, None] > 0) & (side[left][:, None] == side[right][None, :])))
            yield left[a], right[b]


def whole_cells(batches, least: int = 20_000):
    """Tables of whole cells, from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if len(b) else []
        if sum(map(len, held)) < least:
            continue
        rows = pa.Table.from_batches(held)
        at = int(blocks_of_equal(rows.column("cell").to_numpy())[-2])  # the last cell may go on
        if at:
            yield rows.slice(0, at)
        held = rows.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _candidates(reach: float, need: int):
    """Rows (cell, side, g, rep, code) sorted by (cell, side): those that have a partner, without the code. Rounding lets
    more pairs pass, but no fewer."""

    def run(batches):
        for rows in whole_cells(batches):
            cell, side = (rows.column(c).to_numpy() for c in ("cell", "side"))
            width = np.array([len(c) for c in rows.column("code").to_pylist()[:1]])[0]
            along = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(rows), width).astype(np.int16)
            met = np.zeros(len(rows), bool)
            for a, b in close_pairs(cell, side, along, int(reach / STEP) + 1, need):
                met[a] = met[b] = True
            yield from rows.select(["cell", "side", "g", "rep"]).filter(pa.array(met)).combine_chunks().to_batches()
        trim()

    return run


def _pairs(k: int, groups: int, threshold: float, reach: float, need: int):
    """Rows (cell, side, g, rep, embedding, n) sorted by (cell, side): per task, links' weights by vector, and the spanning stars of its links."""

    def run(batches):
        forest, weight, by_dim = Forest(), {}, {}

        def settle(rows: pa.Table) -> None:
            vectors = rows.column("embedding").combine_chunks()
            unit, _ = units(vectors)
            own = by_dim.setdefault(unit.shape[1], Projections(unit.shape[1], k, groups))
            cell, side, rep, n, g = (rows.column(c).to_numpy() for c in ("cell", "side", "rep", "n", "g"))
            for left, right in close_pairs(cell, side, own.along(unit), reach, need):
                for i in range(0, len(left), 32768):
                    a, b = left[i : i + 32768], right[i : i + 32768]
                    near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                    a, b = a[near], b[near]
                    if not len(a):
                        continue
                    at, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                    names = own.cells(unit[at])
                    same = names[back[: len(a)]] == names[back[len(a) :]]
                    first = same.argmax(axis=1) == g[a]
                    a, b = a[first], b[first]
                    for x, y, p, q in zip(rep[a].tolist(), rep[b].tolist(), n[a].tolist(), n[b].tolist(), strict=True):
                        weight[x] = weight.get(x, 0) + q
                        weight[y] = weight.get(y, 0) + p
                        forest.join(x, y)

        for rows in whole_cells(batches):
            sizes = np.diff(rows.column("embedding").combine_chunks().offsets.to_numpy())
            for dim in np.unique(sizes):
                settle(rows.filter(pa.array(sizes == dim)))
        trim()
        u, v = forest.stars()
        rows = [(a, b, 0) for a, b in zip(u, v, strict=True)] + [(a, a, c) for a, c in weight.items()]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 100_000], strict=True)], names=["u", "v", "n"])

    return run


def near_duplicates(spark: SparkSession, table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table`` (vec_id, embedding).

    Vectors that are null, empty, zero or not finite link with nothing and stay by themselves. Equal
    vectors, however many, are compared as one and count each; only vectors of one length compare. An empty table
    gives no rows. Repeated or null ids stay as rows; a component's id is its least non-null one. Other columns are not read.
    """
    scratch = Scratch(small_batches(spark))
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"  # floats travel as they are
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding"))
    good = rows.where(valid())
    reps = good.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    reps = scratch.save(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    k, groups = shape(reps.count(), threshold)
    vectors = reps.select("rep", "embedding", "n")
    names = vectors.mapInArrow(_deal(k, groups, False), "cell long")
    large = names.groupBy("cell").count().where(F.col("count") > BLOCK)
    large = scratch.save(large.select(F.col("cell").alias("big"), F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "large")
    dealt = vectors.mapInArrow(_deal(k, groups, True, FILTER), "cell long, g int, rep long, code binary")
    split = dealt.join(large, F.col("cell") == F.col("big"), "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pairs = F.expr("transform(sequence(0, parts - 1), j -> named_struct('cell', xxhash64(cell, least(j, own), greatest(j, own)), 'side', if(j = own, 0, if(own < j, 1, 2))))")
    at = F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.col("cell"), F.lit(0).alias("side")))).otherwise(pairs))
    blocks = split.select(at.alias("x"), "g", "rep", "code").select("x.cell", "x.side", "g", "rep", "code")
    reach, need = SPAN * math.sqrt(2 - 2 * threshold), least_count(groups)
    met = blocks.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_candidates(reach, least_count(min(groups, FILTER))), "cell long, side int, g int, rep long")
    met = scratch.save(met, "candidates")
    met = met.join(vectors.withColumnRenamed("rep", "own"), F.col("rep") == F.col("own")).select("cell", "side", "g", "rep", "embedding", "n")
    found = met.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_pairs(k, groups, threshold, reach, need), "u long, v long, n long")
    found = scratch.save(found, "links")
    weight = found.where("u = v").groupBy(F.col("u").alias("w")).agg(F.sum("n").alias("others"))
    roots = connected_components(spark, found.where("u <> v").select("u", "v"), scratch)
    of = reps.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).join(weight, F.col("rep") == F.col("w"), "left")
    least = of.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    label = of.join(least, F.col("root") == F.col("r")).select("embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", "n")
    linked = with_labels(good, scratch.save(label, "labels"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, load(spark, sf_dir, "embeddings"))
