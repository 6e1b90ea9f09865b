"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into balanced parts that keep neighbours
together; a small classifier learns a vector's part. It deals every vector to its most probable part
and routes each query to several; how many is calibrated on sampled queries. A part of more than LEAF vectors
is cut again in the same way, on a sample of its own, so parts stay of one size however many vectors there are. Every
fit runs in a task. Parts are reranked exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, small_batches, trim
from .neardup import valid

#: Vectors that the graph, parts and classifier of one cut are fitted on at most.
SAMPLE, SEED = 8000, 11
#: Vectors a part and parts a cut; a part above LEAF is cut again, LEVELS times at most (what is larger then is compared in blocks).
NEIGHBOURS, PER_PART, MOST_PARTS, LEAF, LEVELS = 10, 250, 128, 1000, 5
#: Classifiers of so many bytes together are broadcast; beyond it they meet the rows of their part in a shuffle.
HELD_BYTES = 64 << 20
#: Up to so many parts their sizes are broadcast.
MANY_PARTS = 50_000
TOP, EVERY, RECALL = 5, 50, 0.97
#: Candidates and queries that one block of the rerank compares.
BLOCK, QUERIES = 20_000, 4_000
#: More than rounding can part the matrix product from the exact score.
MARGIN = 1e-9


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, max(len(x) - 1, 0))), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """Halves along principal directions, then moves vectors to the part that most of their neighbours are in, while it has room."""
    part = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                line = np.linalg.svd(x[own] - x[own].mean(0), full_matrices=False)[2][0]
                part[own[np.argsort(x[own] @ line, kind="stable")[len(own) // 2 :]]] += part.max() + 1 + p - part[own[0]]
        part = np.unique(part, return_inverse=True)[1]
    room = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int16)
        for c in range(graph.shape[1]):  # edges both ways
            np.add.at(votes, (np.arange(len(x)), part[graph[:, c]]), 1)
            np.add.at(votes, (graph[:, c], part), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            to = int(np.argmax(votes[i]))
            if gain[i] <= 0:
                break
            if size[to] < room:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer over unit vectors of one length, fitted by Adam."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40):
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        w = [rng.standard_normal((d, hidden)) * (2 / d) ** 0.5 * d**0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * hidden**-0.5, np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs if parts > 1 else 0):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(rows)), part[rows]] -= 1
                z /= len(rows)
                back = (z @ w[2].T) * (h > 0)
                grad, t = [x[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ z + 1e-4 * w[2], z.sum(0)], t + 1
                for a, g, b, c in zip(w, grad, m, v, strict=True):
                    b += 0.1 * (g - b)
                    c += 0.001 * (g * g - c)
                    a -= 0.003 * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
        self.w, self.parts, self.probes = w, parts, parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def calibrate(self, queries: np.ndarray, base: np.ndarray, recall: float) -> None:
        """The least number of parts that holds ``recall`` of the queries' true neighbours in ``base``."""
        home = np.argmax(self.logits(base), axis=1)
        rank = np.argsort(np.argsort(-self.logits(queries), axis=1), axis=1)
        sims = queries @ base.T
        near = np.argpartition(-sims, min(TOP, len(base) - 1), axis=1)[:, :TOP]
        seen = np.take_along_axis(rank, home[near], axis=1)
        self.probes = next((p for p in range(1, self.parts) if (seen < p).mean() >= recall), self.parts)


def fit(x: np.ndarray, total: int, most: int | None = None, per_part: int | None = None) -> Router:
    """x: sampled unit vectors. total: vectors that will be searched. Of the sample a tenth only calibrates."""
    parts, most, per_part = 1, most or MOST_PARTS, per_part or PER_PART
    while parts * 2 <= min(most, total / per_part, len(x) / 40):
        parts *= 2
    if parts == 1:
        return Router(x, np.zeros(len(x), int), 1)
    held = len(x) // 10
    base = x[held:]
    router = Router(base, balanced_parts(base, neighbour_graph(base, NEIGHBOURS), parts), parts)
    router.calibrate(x[:held], base, RECALL)
    return router


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, at length one."""
    return unit(np.array(column.to_pylist(), np.float64))


def _fit(sample: int, most: int, per_part: int):
    """A part's sample (part, n, u, vec_id, embedding) to its classifier; none where nearly all of it would stay together."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "vec_id"]).head(sample)
        x, made = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64)), []
        router = fit(x, int(pdf["n"].iloc[0]), most, per_part)
        if router.parts > 1 and np.bincount(np.argmax(router.logits(x), axis=1)).max() <= 0.9 * len(x):
            made = [pickle.dumps(router)]
        del x, router
        trim()
        return pd.DataFrame({"part": pd.Series([key[0]] * len(made), dtype="int64"), "model": made})

    return run


def children(x: np.ndarray, router: Router | None, probes: bool) -> np.ndarray:
    """[vector, choice]: numbers of the most probable parts, one or as many as are calibrated; without a classifier 0."""
    take = router.probes if router and probes else 1
    return np.argsort(-router.logits(x), axis=1, kind="stable")[:, :take] if router else np.zeros((len(x), 1), int)


def _route(held, most: int, probes: bool):
    """(part, id, embedding, ...): rows with the parts below that they go to."""

    def run(batches):
        for b in batches:
            part = b.column(0).to_numpy()
            for p in np.unique(part):
                own, router = b.filter(pa.array(part == p)), held.value.get(int(p))
                best = children(vectors_of(own.column(2)) if router else np.zeros((len(own), 0)), router, probes)
                for c in range(best.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(best[:, c] + int(p) * most, pa.int64()), *own.columns[1:]], names=own.schema.names)

    return run


def _route_part(most: int, probes: bool):
    """As _route(), for some rows (part, id, embedding, ..., slice) of one part and its classifier."""

    def run(key: tuple, rows: pa.Table, models: pa.Table) -> pa.Table:
        rows, router = rows.drop_columns(["slice"]), pickle.loads(models.column("model")[0].as_py()) if len(models) else None
        best = children(vectors_of(rows.column("embedding")), router, probes) if len(rows) else np.zeros((0, 1), int)
        out = [rows.set_column(0, "part", pa.array(best[:, c] + key[0].as_py() * most, pa.int64())) for c in range(best.shape[1])]
        trim()
        return pa.concat_tables(out)

    return run


def _size_hint(spark: SparkSession, sizes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """broadcast(), where a table of a row a part is small enough for it."""
    return F.broadcast if sizes.count() <= MANY_PARTS else lambda t: t


def cut(spark: SparkSession, scratch: Scratch, base: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (vec_id, embedding) and queries (query_id, embedding, qkey) with the parts they are in and go to. At first a part
    holds all vectors of one length; parts above LEAF are cut until none is left."""
    first = F.size("embedding").cast("long")
    homes, asked = base.select(first.alias("part"), "vec_id", "embedding"), asked.select(first.alias("part"), "query_id", "embedding", "qkey")
    for level in range(LEVELS):
        sizes = scratch.save(homes.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).withColumnRenamed("part", "p"), f"parts-{level}")
        small = _size_hint(spark, sizes)
        u = F.shiftrightunsigned(F.xxhash64("vec_id", "embedding", F.lit(SEED + level)), 1).cast("double") / F.lit(2.0**63)
        some = homes.join(small(sizes), F.col("part") == F.col("p")).withColumn("u", u).where(F.col("u") * F.col("n") <= 1.25 * SAMPLE)
        models = scratch.save(some.select("part", "n", "u", "vec_id", "embedding").groupBy("part").applyInPandas(_fit(SAMPLE, MOST_PARTS, PER_PART), "part long, model binary"), f"models-{level}")
        size = models.agg(F.sum(F.octet_length("model"))).first()[0]
        if not size:
            break
        held = spark.sparkContext.broadcast({r.part: pickle.loads(r.model) for r in models.collect()}) if size <= HELD_BYTES else None
        down = []
        for rows, name in ((homes, "index"), (asked, "asked")):
            if held is not None:
                got = rows.mapInArrow(_route(held, MOST_PARTS, name == "asked"), rows.schema)
            else:
                of = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices")).withColumnRenamed("part", "p")
                of = scratch.save(of.join(models.select(F.col("part").alias("own")), F.col("p") == F.col("own"), "left"), f"{name}-slices-{level}")
                dealt = rows.join(_size_hint(spark, of)(of), F.col("part") == F.col("p"))
                sliced = dealt.where("own is not null").withColumn("slice", F.pmod(F.xxhash64(*rows.columns[1:]), F.col("slices")).cast("int")).select(*rows.columns, "slice")
                there = models.join(of, F.col("part") == F.col("p")).select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "model")
                got = sliced.groupBy("part", "slice").cogroup(there.groupBy("part", "slice")).applyInArrow(_route_part(MOST_PARTS, name == "asked"), rows.schema)
                got = got.unionByName(dealt.where("own is null").select((F.col("part") * MOST_PARTS).alias("part"), *rows.columns[1:]))
            down.append(scratch.save(got, f"{name}-{level}"))
            if level:
                scratch.drop(f"{name}-{level - 1}")
        homes, asked = down
    return homes, asked


def _rerank(key: tuple, queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    out = {"qkey": [], "query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(base):
        q0, b0 = np.stack(queries["embedding"].to_numpy()), np.stack(base["embedding"].to_numpy())
        q, b = unit(q0), unit(b0)
        keys, own, ids = queries["qkey"].to_numpy(), queries["query_id"].to_numpy(), base["vec_id"].to_numpy()
        length_b = np.sqrt((b0 * b0).sum(axis=1))
        kth = min(len(ids), TOP) - 1
        for i in range(0, len(q), 256):
            sims = q[i : i + 256] @ b.T
            sims[own[i : i + 256][:, None] == ids[None, :]] = -np.inf
            least = -np.partition(-sims, kth, axis=1)[:, kth] - MARGIN
            for r in range(len(sims)):
                at = np.flatnonzero((sims[r] >= least[r]) & np.isfinite(sims[r]))
                x = q0[i + r]
                score = (b0[at] * x).sum(axis=1) / (length_b[at] * np.sqrt((x * x).sum()))
                at, score = at[order := np.lexsort((ids[at], -score))[:TOP]], score[order]
                out["qkey"] += [keys[i + r]] * len(at)
                out["query_id"] += [own[i + r]] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += score.tolist()
    trim()
    return pd.DataFrame(out).astype({"qkey": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(spark: SparkSession, table: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``table`` (vec_id, embedding) whose id divides by ``every``
    its nearest other rows by cosine, ties to the smaller id.

    Null ids and vectors that are null, empty, zero or not finite take no part. Of equal vectors those of the
    ``top`` + 1 least ids, and of each id ``top`` rows, can be among a query's nearest, so those alone are
    candidates; no row that could be a result is left out. Repeated ids: each query row has its own ranks. An empty
    table gives no rows. Other columns are not read. A part's candidates are dealt into blocks, and are sent as often as
    QUERIES goes into the queries routed to that part.
    """
    scratch = Scratch(small_batches(spark))
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid() & F.col("vec_id").isNotNull())
    # copies are counted within tasks first, and of one vector's ids each task sends on top + 1, so no task gets a common vector's rows
    ids = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("n"))
    thin = ids.withColumn("k", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("k") <= top + 1)
    base = scratch.save(thin.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(top)))).alias("n")).drop("n"), "candidates")
    queries = scratch.save(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.monotonically_increasing_id().alias("qkey"), F.col("vec_id").alias("query_id"), "embedding"), "queries")
    homes, asked = cut(spark, scratch, base, queries)
    sizes = homes.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")), "part")
    sizes = scratch.save(sizes, "sizes")  # a row a part
    block, turn = F.pmod(F.xxhash64("vec_id", "embedding"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("qkey"), F.col("turns")).cast("int")
    small = _size_hint(spark, sizes)
    own, theirs = small(sizes), small(sizes.withColumnsRenamed({"part": "to", "nb": "blocks", "nq": "turns"}))
    homes = homes.join(own, "part").withColumn("b", block).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("part", "b", "q", "vec_id", "embedding")
    asked = asked.join(theirs, F.col("part") == F.col("to")).withColumn("q", turn).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "b", "q", "query_id", "qkey", "embedding")
    pairs = asked.groupBy("part", "b", "q").cogroup(homes.groupBy("part", "b", "q")).applyInPandas(_rerank, "qkey long, query_id long, vec_id long, score double")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, load(spark, sf_dir, "embeddings"))
