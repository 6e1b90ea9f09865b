"""Language ID in two steps: the family first, then one-versus-one linear support vector machines in it.

Families are learned: languages whose mean character n-gram vectors are closest are merged until
about the square root of their number is left. A document's vector holds the square roots of its
hashed n-gram counts, at length one.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_crc, load, small_batches, text_key, trim

ORDERS, BITS = (1, 2, 3), 12
#: Documents of a language and of all of them, and characters of a document, that the classifiers are fitted on at most.
#: (For a prediction, texts are read whole.)
SAMPLE, MOST, LONGEST = 300, 12_000, 60_000
#: Parts that a language's documents are ranked in first, so that no task ranks all of a language.
PARTS = 16
UNKNOWN = "und"


def vectors(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(" ".join(t.lower().split()).join("  ").encode(), np.uint8).astype(np.uint32)
        h = raw + np.uint32(1)
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
            x = h * np.uint32(0x9E3779B1) + np.uint32(n)
            x ^= x >> np.uint32(15)
            out[i] += np.bincount((x * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-3) -> np.ndarray:
    """A linear support vector machine (squared hinge, classes weighed alike) for y of +1 and -1; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = np.zeros(x.shape[1])
    v, pace = w.copy(), 0.25
    for k in range(rounds):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - pace * (penalty * v - 2 * (weight * slack * y) @ x)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def families(means: np.ndarray) -> list[list[int]]:
    """Merges the closest two groups (by their means) until about sqrt(n) are left."""
    groups = [[i] for i in range(len(means))]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: float(means[groups[p[0]]].mean(0) @ means[groups[p[1]]].mean(0)))
        groups[a] += groups.pop(b)
    return groups


class Hierarchy:
    """names; families; for each pair of families, and of languages in a family, a machine."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.names = sorted(set(langs))
        of = np.array([self.names.index(g) for g in langs], int)
        x = vectors(texts)
        self.groups = families(np.stack([x[of == k].mean(0) for k in range(len(self.names))])) if self.names else []
        group_of = np.array([next(g for g, own in enumerate(self.groups) if k in own) for k in range(len(self.names))], int)
        self.top = self.pairs(x, group_of[of], range(len(self.groups)))
        self.inner = [self.pairs(x, of, own) for own in self.groups]

    @staticmethod
    def pairs(x: np.ndarray, y: np.ndarray, classes) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for a, b in combinations(classes, 2):
            rows = (y == a) | (y == b)
            out.append((a, b, machine(x[rows], np.where(y[rows] == a, 1.0, -1.0)).astype(np.float32)))
        return out

    @staticmethod
    def vote(x: np.ndarray, classes: list[int], machines) -> tuple[np.ndarray, np.ndarray]:
        """The class with most wins (ties: the larger sum of margins), and its share: the mean of its logistic margins."""
        if len(classes) == 1:
            return np.full(len(x), classes[0]), np.ones(len(x))
        wins, share = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
        for a, b, w in machines:
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1].astype(np.float32) + w[-1]), -30, 30)))
            i, j = classes.index(a), classes.index(b)
            wins[:, i] += p >= 0.5
            wins[:, j] += p < 0.5
            share[:, i] += p
            share[:, j] += 1 - p
        best = np.argmax(wins + share / (2 * len(classes)), axis=1)
        return np.array(classes)[best], share[np.arange(len(x)), best] / (len(classes) - 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = vectors(texts)
        family, sure = self.vote(x, list(range(len(self.groups))), self.top)
        lang, score = np.zeros(len(x), int), np.zeros(len(x))
        for g, own in enumerate(self.groups):
            rows = np.flatnonzero(family == g)
            if len(rows):
                lang[rows], inner = self.vote(x[rows], own, self.inner[g])
                score[rows] = inner * sure[rows]
        return [self.names[k] for k in lang], score


def sample(docs: DataFrame, may_learn=None, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, text) of at most ``limit`` documents of each language and MOST of all, the same in every run: those
    with the least hash of their id. An id counts once for a language, with the text of the least hash.

    The ids are ranked in parts of a language, then the parts' first ones together; only the chosen ones' keys come to
    the driver, and their texts are read in a second scan.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(F.length("text") <= LONGEST).where("text rlike '\\\\p{L}'")
    if may_learn is not None:
        known = known.where(may_learn)
    once = known.groupBy("lang", "doc_id").agg(F.min(text_key()).alias("key")).withColumn("h", F.xxhash64("doc_id"))
    for by in (["lang", F.pmod(F.col("h"), F.lit(PARTS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        once = once.withColumn("k", rank).where(F.col("k") <= limit)
    chosen = once.orderBy("k", "lang").limit(MOST).select("doc_id", "lang", "key")
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "_id long, _lang string, _key long")  # at most MOST rows
    same = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")) & (text_key() == F.col("_key"))
    return docs.join(F.broadcast(chosen), same).groupBy("_id", "_lang").agg(F.min(F.col("text").cast("string")).alias("text")).select(F.col("_id").alias("doc_id"), F.col("_lang").alias("lang"), "text")


def _train(batches):
    rows = sorted((r["lang"], r["doc_id"], r["text"]) for b in batches for r in b.to_pylist())
    made = pickle.dumps(Hierarchy([r[2] for r in rows], [r[0] for r in rows]))
    trim()
    yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])


def model(spark: SparkSession, docs: DataFrame, may_learn=None):
    """A broadcast of the Hierarchy that one task fits on the bounded sample (16 kB a pair of languages in a family)."""
    small_batches(spark)
    got = sample(docs, may_learn).repartition(1).mapInArrow(_train, "model binary").first()
    return spark.sparkContext.broadcast(pickle.loads(got.model) if got else Hierarchy([], []))


def identify(docs: DataFrame, held) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text): ``und`` with score 0 for a null
    text, an empty one or one without a letter, and for all where nothing was learned. Very long texts are read whole;
    repeated rows and null ids stay; an empty table gives no rows; other columns are not read."""

    def run(batches):
        for b in batches:
            names, score, texts = [], [], b.column(1)
            for i in range(0, len(b), 128):
                n, p = held.value.predict([x.as_py() or "" for x in texts[i : i + 128]])
                names += n
                score.append(p)
            trim()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0)), b.column(2)], names=["doc_id", "lang_pred", "score", "letters"])

    small_batches(docs.sparkSession)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), letters.alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double, letters boolean")
    return got.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = load(spark, sf_dir, "documents"), id_crc() % 3
    return identify(docs, model(spark, docs, fold != 1)).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
