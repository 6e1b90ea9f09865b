"""Training in batches one after another within shards of the rows, whose parameters are averaged after each epoch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from .autoencoder import Network

#: Rows of a shard, about; a task holds its shards' vectors, mostly one shard's.
SHARD = 100_000
#: Rows whose bytes are packed together.
PACKED = 4096


@dataclass
class State:
    """Where training stands after ``epoch`` epochs: parameters, Adam's moments and steps, the best parameters and the history."""

    flat: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: int = 0
    epoch: int = 0
    best: np.ndarray | None = None
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @classmethod
    def of(cls, net: Network) -> State:
        flat = flatten(net)
        return cls(flat, np.zeros_like(flat), np.zeros_like(flat))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Under a name of its own epoch. A folder counts once Spark has committed it, so a stop in between leaves the one before."""
        best = self.flat if self.best is None else self.best
        rows = [("param", i, *map(float, x)) for i, x in enumerate(zip(self.flat, self.m, self.v, best, strict=True))]
        rows += [("past", e, float(a), float(b), None, None) for e, a, b in self.history] + [("steps", self.steps, None, None, None, None)]
        spark.createDataFrame(rows, "kind string, i long, a double, b double, c double, d double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{self.epoch:06d}")

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> State | None:
        """The last committed state of the folder, or None."""
        done = sorted(p for p in tables.children(spark, folder) if p.startswith("epoch-") and tables.exists(spark, f"{folder}/{p}/_SUCCESS"))
        if not done:
            return None
        rows = spark.read.parquet(f"{folder}/{done[-1]}").orderBy("kind", "i").collect()
        x = np.array([(r.a, r.b, r.c, r.d) for r in rows if r.kind == "param"])
        past = [(r.i, r.a, r.b) for r in rows if r.kind == "past"]
        return cls(x[:, 0], x[:, 1], x[:, 2], next(r.i for r in rows if r.kind == "steps"), int(done[-1][6:]), x[:, 3] if past else None, past)


def flatten(net: Network) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in net.layers for a in pair])


def shaped(net: Network, flat: np.ndarray) -> Network:
    cut, at = [], 0
    for a, b in net.sizes():
        cut.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return Network(net.width, net.hidden, net.activation, cut)


def batch_order(ids: np.ndarray, epoch: int, seed: int = 42) -> np.ndarray:
    """An order of the ids that each epoch draws anew, whatever order the rows come in."""
    return np.argsort(ids, kind="stable")[np.random.default_rng([seed, epoch]).permutation(len(ids))]


def run_epoch(net: Network, x: np.ndarray, ids: np.ndarray, state: State, rate: float, decay: float, batch: int, seed: int = 42) -> tuple[State, float, int]:
    """An epoch over one shard: Adam after each batch; the state, the batches' summed mean losses and their number."""
    flat, m, v, t, total, drawn = state.flat.copy(), state.m.copy(), state.v.copy(), state.steps, 0.0, x[batch_order(ids, state.epoch, seed)]
    g, a, b = (np.empty_like(flat) for _ in range(3))
    now, into = shaped(net, flat), shaped(net, g)  # views, so that a step's arrays are there once
    for at in range(0, len(x), batch):
        rows = drawn[at : at + batch]
        _, loss = now.gradients(rows, into)
        t, total = t + 1, total + loss / len(rows)
        g /= len(rows)
        g += np.multiply(flat, decay, out=a)
        m *= 0.9
        m += np.multiply(g, 0.1, out=a)
        v *= 0.999
        v += np.multiply(np.multiply(g, 0.001, out=a), g, out=a)
        np.sqrt(np.divide(v, 1 - 0.999**t, out=b), out=b)
        b += 1e-8
        np.multiply(np.divide(m, 1 - 0.9**t, out=a), rate, out=a)
        a /= b
        flat -= a
    return State(flat, m, v, t, state.epoch), total, -(-len(x) // batch)


def shards(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, is_test, id, v) dealt by a hash of the id into shards of about so many rows, each in one partition."""
    n = max(1, -(-rows.count() // shard))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard"), "is_test", F.col("id").cast("long").alias("id"), "v")
    return dealt.repartitionById(n, F.col("shard"))


def packed(dealt: DataFrame) -> DataFrame:
    """(shard, is_test, ids, v) of ``shards``: the bytes of ids and vectors, PACKED rows at most together, in the same partitions.
    Every epoch reads the rows, and reads bytes as they are."""

    def run(batches):
        for pdf in batches:
            for (shard, test), own in pdf.groupby(["shard", "is_test"]):
                for at in range(0, len(own), PACKED):
                    some = own.iloc[at : at + PACKED]
                    yield pd.DataFrame({"shard": [shard], "is_test": [test], "ids": [some["id"].to_numpy(np.int64).tobytes()], "v": [np.stack(some["v"].to_numpy()).astype(float).tobytes()]})

    return dealt.mapInPandas(run, "shard int, is_test boolean, ids binary, v binary")


def train(
    rows: DataFrame, net: Network, epochs: int = 20, rate: float = 1e-3, decay: float = 1e-4, step: int = 10, gamma: float = 0.5, batch: int = 32, shard: int = SHARD, seed: int = 42,
    on_epoch: Callable[[int, float, float, Network, bool], None] | None = None, folder: str | None = None,
) -> tuple[Network, Network, list[tuple[int, float, float]]]:
    """(last, best on validation, history of (epoch, train loss, validation loss)) of (id, v, is_test).

    Each shard takes its epoch from the same parameters and moments, which are then averaged by the shards' rows; with
    one shard that is plain training in batches. Losses are means over batches of their means; validation runs in
    batches by id. One pass an epoch: a network is validated in the pass that trains it further. The rows are dealt out
    once, a shard to a task, and held in memory as bytes; give a written table, from which a lost executor's shards are read again. folder: keeps the
    state there after each epoch and goes on from the last one that it holds.
    """
    spark, held = rows.sparkSession, packed(shards(rows, shard)).persist()
    size = len(flatten(net))

    def one_pass(now: State, lr: float, fit: bool):
        def run(batches):
            parts = [b for b in batches if len(b)]
            for _, own in pd.concat(parts).groupby("shard") if parts else ():
                for test, part in own.groupby("is_test"):
                    ids, x = np.frombuffer(b"".join(part["ids"]), np.int64), np.frombuffer(b"".join(part["v"]))
                    x = x.reshape(len(ids), -1)
                    out = np.zeros(3 * size + 6)  # parameters, moments and steps times rows, rows, losses and batches of both parts
                    if test:
                        x, whole = x[np.argsort(ids, kind="stable")], shaped(net, now.flat)
                        each = [float(((whole.forward(x[i : i + batch]) - x[i : i + batch]) ** 2).mean()) for i in range(0, len(x), batch)]
                        out[-2:] = sum(each), len(each)
                    elif fit:
                        new, loss, n = run_epoch(net, x, ids, now, lr, decay, batch, seed)
                        out[: 3 * size + 1] = np.concatenate([new.flat, new.m, new.v, [new.steps]]) * len(x)
                        out[-5:-2] = len(x), loss, n
                    yield pd.DataFrame({"i": np.arange(len(out), dtype="int32"), "x": out})

        total = np.zeros(3 * size + 6)
        got = held.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # three numbers a weight
        total[got.column("i").to_numpy()] = got.column("x").to_numpy()
        return total

    state = (State.latest(spark, folder) if folder else None) or State.of(net)
    least, loss = min((b for _, _, b in state.history), default=np.inf), None
    try:
        while state.epoch < epochs or loss is not None:
            got = one_pass(state, rate * gamma ** (state.epoch // step), state.epoch < epochs)
            if loss is not None:  # of the epoch that the pass before trained
                val = float(got[-2] / max(got[-1], 1))
                better = val < least
                least, state.best = (val, state.flat) if better else (least, state.best)
                state.history.append((state.epoch - 1, loss, val))
                if folder:
                    state.save(spark, folder)
                if on_epoch:
                    on_epoch(*state.history[-1], shaped(net, state.flat), better)
                loss = None
            if state.epoch < epochs:
                n = max(got[-5], 1.0)
                flat, m, v = np.split(got[: 3 * size] / n, 3) if got[-5] else (state.flat, state.m, state.v)
                loss = float(got[-4] / max(got[-3], 1))
                state = State(flat, m, v, round(got[3 * size] / n), state.epoch + 1, state.best, state.history)
    finally:
        held.unpersist()
    return shaped(net, state.flat), shaped(net, state.flat if state.best is None else state.best), state.history
