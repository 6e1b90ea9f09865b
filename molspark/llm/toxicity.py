"""Toxicity: logistic regression over character n-grams scaled by naive Bayes log-count ratios.

A document's features are its hashed character n-grams, and again, as features of their own, those that
it has at least twice and at least three times: a rare stem that recurs says more than one. Each feature's weight is its log-count ratio
times a coefficient fitted by L2-penalised logistic regression on labelled documents, so that a
feature that says nothing about the labels carries nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, load, small_batches, text_key, trim

ORDERS, BITS, TIERS = (4, 7), 20, 3
#: Labelled documents that the classifier is fitted on at most (those with the least hash of their id),
#: and the characters of the longest one among them. Scoring reads every text whole.
SAMPLE, LONGEST = 3000, 30_000
LEAST_DOCS, THRESHOLD = 3, 0.3


def features(text: bytes) -> np.ndarray:
    """Hashes of the n-grams of each order at each place, of characters (code points); letters A-Z folded, white space alike."""
    raw = np.frombuffer(f" {text.decode()} ".encode("utf-32-le"), "<u4").copy()
    raw[(raw >= 65) & (raw <= 90)] += np.uint32(32)
    raw[(raw >= 9) & (raw <= 13)] = 32
    h, out = raw + np.uint32(1), []
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in ORDERS:
            x = h * np.uint32(0x9E3779B1) + np.uint32(n)
            x ^= x >> np.uint32(15)
            out.append((x * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def tiered(text: bytes, useful: np.ndarray | None = None) -> np.ndarray:
    """The document's features: hash + (tier - 1) * 2**BITS for each count reached up to TIERS. useful: hashes to look at."""
    h = features(text)
    own, n = np.unique(h if useful is None else h[useful[h]], return_counts=True)
    own = own.astype(np.int32)
    return np.concatenate([own[n > k] + (k << BITS) for k in range(TIERS)])


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 40, penalty: float = 3.0, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights by hash, bias). Without texts or with one class only, no weights and the smoothed base rate."""
    size, y = TIERS << BITS, np.asarray(labels, np.float64)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    if not 0 < y.sum() < len(y):
        return np.zeros(size, np.float32), float(prior)
    own = [tiered(t) for t in texts]
    df, toxic = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for x, t in zip(own, y, strict=True):
        df[x] += 1
        toxic[x] += int(t)
    keep = df >= LEAST_DOCS
    if not keep.any():
        return np.zeros(size, np.float32), float(prior)
    p, q = toxic[keep] + alpha, (df - toxic)[keep] + alpha
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    compact = (np.cumsum(keep) - 1).astype(np.int32)
    for i, x in enumerate(own):
        own[i] = compact[x[keep[x]]]

    def times(w: np.ndarray, weigh: np.ndarray = ratio) -> np.ndarray:
        by = weigh * w
        return np.array([by[x].sum() for x in own])

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratio))
        for x, v in zip(own, g.tolist(), strict=True):
            out[x] += v  # a document has a feature once
        return out * ratio

    scale = np.sqrt(times(np.ones(len(ratio)), ratio**2).mean())
    w, b = np.zeros(len(ratio)), prior
    past: list[tuple[np.ndarray, np.ndarray]] = []
    z = times(w)

    def at(z: np.ndarray, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        s = 1 / (1 + np.exp(-np.clip(z + b, -30, 30)))
        loss = np.mean(np.logaddexp(0, -(2 * y - 1) * (z + b))) + penalty / len(y) * scale**2 * 1e-2 * (w @ w)
        g = (s - y) / len(y)
        return loss, np.append(back(g) + 2 * penalty / len(y) * scale**2 * 1e-2 * w, g.sum())

    x = np.append(w, b)
    loss, grad = at(z, w, b)
    for _ in range(rounds):  # L-BFGS with backtracking
        d, a = grad.copy(), []
        for s, t in reversed(past):
            a.append((s @ d) / (s @ t))
            d -= a[-1] * t
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(grad), 1e-12)
        for (s, t), c in zip(past, reversed(a), strict=True):
            d += (c - (t @ d) / (s @ t)) * s
        step, zd = 1.0, times(d[:-1])
        while step > 1e-6:
            new = x - step * d
            l2, g2 = at(z - step * zd, new[:-1], new[-1])
            if l2 <= loss - 1e-4 * step * (grad @ d):
                break
            step /= 2
        else:
            break
        if (grad @ d) * step < 1e-7:
            break
        s, t = new - x, g2 - grad
        if s @ t > 1e-14:
            past = [*past[-7:], (s, t)]
        x, z, loss, grad = new, z - step * zd, l2, g2
    weights = np.zeros(size, np.float32)
    weights[np.flatnonzero(keep)] = ratio * x[:-1]
    return weights, float(x[-1])


def fit_calibrated(texts: list[bytes], labels: np.ndarray, part: int = 4) -> tuple[np.ndarray, float]:
    """As fit(), with its margins scaled as those of documents it hasn't seen ask for: a model of three
    quarters of the documents scores the rest, and a logistic curve is fitted to these scores."""
    y, own = np.asarray(labels, np.float64), np.arange(len(labels)) % part == 0
    weights, bias = fit(texts, y)
    if min(y[own].sum(), (1 - y)[own].sum(), y[~own].sum()) < 3:
        return weights, bias
    w, b = fit([t for t, o in zip(texts, own, strict=True) if not o], y[~own])
    p = scores([t for t, o in zip(texts, own, strict=True) if o], w, b)
    z = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1))
    x, at, goal = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0]), y[own]
    for _ in range(30):  # Newton steps, held near the identity
        q = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (q - goal) + (at - [1.0, 0.0]) * 0.1
        at = at - np.clip(np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), grad), -1, 1)
    scale = float(np.clip(at[0], 0.2, 5))
    return (weights * scale).astype(np.float32), bias * scale + float(at[1])


def scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probabilities that the label is 1."""
    useful = (weights.reshape(TIERS, -1) != 0).any(axis=0)
    out = np.array([weights[tiered(t, useful)].sum(dtype=np.float64) + bias for t in texts], np.float64)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, longest: int = LONGEST, may_learn=None) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents, the same in every run: those with the least hash of
    their id among the labelled ones that ``docs`` has a text for. A document with several labels is toxic if one says
    so, and of several texts under one id the shortest counts; null labels, ids and texts are left out."""
    known = labels.where("toxic is not null and doc_id is not null")
    if may_learn is not None:
        known = known.where(may_learn)
    small_batches(docs.sparkSession)
    one = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string")).where(F.length("text") <= longest)
    keys = rows.select("doc_id", F.struct(F.length("text").alias("n"), text_key().alias("key")).alias("first"))  # not the texts themselves
    there = keys.join(one, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("first").alias("first"))
    chosen = there.orderBy(F.xxhash64("_id"), "_id").limit(limit).select("_id", "_y", F.col("first.key").alias("_key"))
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "_id long, _y int, _key long")  # at most ``limit`` rows
    return rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (text_key() == F.col("_key"))).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("y"))


def _train(batches):
    rows = sorted((r["doc_id"], r["text"], r["y"]) for b in batches for r in b.to_pylist())
    weights, bias = fit_calibrated([r[1].encode() for r in rows], np.array([r[2] for r in rows], np.float64))
    at = np.flatnonzero(weights).astype("<i4")
    del rows
    trim()
    yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([weights[at].astype("<f4").tobytes()]), pa.array([bias])], names=["at", "weight", "bias"])


def model(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn=None):
    """A broadcast of (weights, bias): 12 MB at most, whatever the data. One task fits it on the bounded sample."""
    got = sample(docs, labels, may_learn=may_learn).repartition(1).mapInArrow(_train, "at binary, weight binary, bias double").first()
    if got is None:  # nothing to learn from
        return spark.sparkContext.broadcast(fit([], np.zeros(0)))
    weights = np.zeros(TIERS << BITS, np.float32)
    weights[np.frombuffer(got.at, "<i4")] = np.frombuffer(got.weight, "<f4")
    return spark.sparkContext.broadcast((weights, got.bias))


def _blocks(column: pa.Array, size: int = 256):
    for i in range(0, len(column), size):
        yield [(x.as_py() or "").encode() for x in column[i : i + size]]


def score_column(column: pa.Array, held) -> np.ndarray:
    return np.concatenate([scores(t, *held.value) for t in _blocks(column)]) if len(column) else np.zeros(0)


def toxicity(docs: DataFrame, held) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text), repeated or not. A null text is scored as an
    empty one, a very long one whole; null ids stay; other columns are not read; an empty table gives no rows."""

    def run(batches):
        for b in batches:
            trim()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_column(b.column(1), held))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def clean_documents(docs: DataFrame, held, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns. A null text is scored as an empty one
    and a very long one whole; repeated rows and null ids are judged each for itself; an empty table gives no rows."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            kept = b.filter(pa.array(score_column(b.column(at), held) < threshold))
            trim()
            yield kept

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = load(spark, sf_dir, "documents"), id_crc() % 4
    held = model(spark, docs, load(spark, sf_dir, "labels"), fold != 2)
    return toxicity(docs, held).select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
