"""A small autoencoder: forward passes as plans or in Arrow batches, training by summed gradients."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Network:
    """Layer sizes mirror; activation ``tanh`` (the output too) or ``relu`` (a linear output)."""

    width: int
    hidden: tuple[int, ...]
    activation: str = "tanh"
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def sizes(self) -> list[tuple[int, int]]:
        row = [self.width, *self.hidden]
        return [*zip(row, row[1:], strict=False), *((b, a) for a, b in reversed(list(zip(row, row[1:], strict=False))))]

    def start(self, seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        self.layers = [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in self.sizes()]
        return self

    def act(self, k: int, z: np.ndarray) -> np.ndarray:
        if self.activation == "tanh":
            return np.tanh(z)
        return z if k == len(self.layers) - 1 else np.maximum(z, 0)

    def forward(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        for k in range(first, len(self.layers) if last is None else last):
            w, b = self.layers[k]
            x = self.act(k, x @ w + b)
        return x

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x, 0, len(self.hidden))

    def decode(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x, len(self.hidden))

    def gradients(self, x: np.ndarray, into: Network | None = None) -> tuple[list[np.ndarray], float]:
        """Summed over rows, of the squared error's mean over the features; and the summed loss. into: layers that take the sums."""
        outs = [x]
        for k, (w, b) in enumerate(self.layers):
            outs.append(self.act(k, outs[-1] @ w + b))
        diff = outs[-1] - x
        g, out = 2 * diff / x.shape[1], []
        for k in range(len(self.layers) - 1, -1, -1):
            y = outs[k + 1]
            if self.activation == "tanh":
                g = g * (1 - y * y)
            elif k < len(self.layers) - 1:
                g = g * (y > 0)
            w, b = into.layers[k] if into else (None, None)
            out += [np.add.reduce(g, 0, out=b), np.matmul(outs[k].T, g, out=w)]
            if k:
                g = g @ self.layers[k][0].T
        return out[::-1], float((np.add.reduce(diff * diff, 1) / x.shape[1]).sum())

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, "w", i, j, float(w[i, j])) for k, (w, _) in enumerate(self.layers) for i in range(w.shape[0]) for j in range(w.shape[1])]
        rows += [(k, "b", 0, j, float(b[j])) for k, (_, b) in enumerate(self.layers) for j in range(len(b))]
        return spark.createDataFrame(rows, "layer int, part string, i int, j int, w double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> Network:
        self.layers = [(np.zeros(s), np.zeros(s[1])) for s in self.sizes()]
        for r in spark.read.parquet(path).collect():
            w, b = self.layers[r.layer]
            if r.part == "w":
                w[r.i, r.j] = r.w
            else:
                b[r.j] = r.w
        return self


def summary(spark: SparkSession, net: Network) -> DataFrame:
    """(layer, inputs, outputs, params)."""
    return spark.createDataFrame([(k, a, b, a * b + b) for k, (a, b) in enumerate(net.sizes())], "layer int, inputs int, outputs int, params int")


def apply_network(df: DataFrame, net: Network, part: str, *keep: str) -> DataFrame:
    """(id, v, the columns to keep) through the encoder, the decoder or both, in Arrow batches, without a shuffle."""
    f = {"encode": net.encode, "decode": net.decode, "both": net.forward}[part]

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, net.width))
            yield pd.DataFrame({"id": pdf["id"], "v": pd.Series(list(f(x)), dtype=object, index=pdf.index), **{c: pdf[c] for c in keep}})

    types = dict(df.dtypes)
    return df.select("id", "v", *keep).mapInPandas(run, ", ".join(["id long, v array<double>", *(f"`{c}` {types[c]}" for c in keep)]))


def mse(df: DataFrame, net: Network) -> DataFrame:
    """(mse): of all components of all rows, from each task's sum and number."""

    def run(batches):
        total, n = 0.0, 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                total, n = total + float(((net.forward(x) - x) ** 2).sum()), n + x.size
        yield pd.DataFrame({"s": [total], "n": [n]})

    sums = df.select("v").mapInPandas(run, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select(F.try_divide(F.col("s"), F.col("n").cast("double")).alias("mse"))


def train(
    train_df: DataFrame, val_df: DataFrame, net: Network, epochs: int = 20, rate: float = 1e-2, decay: float = 1e-4, step: int = 10, gamma: float = 0.5, steps: int = 1, on_epoch: Callable[[int, float, float, Network, bool], None] | None = None
) -> tuple[Network, Network, list[tuple[int, float, float]]]:
    """(last, best on validation, history) of (id, v).

    An epoch takes ``steps`` synchronous steps, each on a share of the rows that the epoch deals by a hash of their
    id: large batches in place of batches of 32, which one after another can't be distributed. Tasks send their
    gradient sums by place, which are added up before the driver applies Adam, so it gets one row a weight.
    on_epoch(epoch, train loss, validation loss, network, improved) runs after each epoch.
    """
    sizes = [a.size for pair in net.layers for a in pair]

    def sums(df: DataFrame, own: Network) -> tuple[np.ndarray, float, int]:
        def run(batches):
            g, loss, n = np.zeros(sum(sizes)), 0.0, 0
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    x = np.stack(pdf["v"].iloc[at : at + 4096].to_numpy())
                    parts, more = own.gradients(x)
                    g += np.concatenate([p.ravel() for p in parts])
                    loss, n = loss + more, n + len(x)
            if n:
                yield pd.DataFrame({"at": np.arange(len(g) + 2), "x": np.concatenate([g, [loss, n]])})

        out = np.zeros(sum(sizes) + 2)
        for r in df.select("v").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r.at] = r.x
        return out[:-2], out[-2], int(out[-1])

    train_df, val_df = train_df.persist(), val_df.persist()
    try:
        flat = np.concatenate([a.ravel() for pair in net.layers for a in pair])
        m, v, best, best_loss, history, t = np.zeros_like(flat), np.zeros_like(flat), net, np.inf, [], 0
        for e in range(epochs):
            total = 0.0
            for k in range(steps):
                g, loss, n = sums(train_df if steps == 1 else train_df.where(F.pmod(F.xxhash64("id", F.lit(e)), F.lit(steps)) == k), net)
                t, total = t + 1, total + loss / max(n, 1) / steps
                g = g / max(n, 1) + decay * flat
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                flat = flat - rate * gamma ** (e // step) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                cut = np.split(flat, np.cumsum(sizes)[:-1])
                net = Network(net.width, net.hidden, net.activation, [(cut[2 * k].reshape(s), cut[2 * k + 1]) for k, s in enumerate(net.sizes())])
            _, val, nv = sums(val_df, net)
            history.append((e, total, val / max(nv, 1)))
            if better := history[-1][2] < best_loss:
                best, best_loss = net, history[-1][2]
            if on_epoch:
                on_epoch(*history[-1], net, better)
    finally:
        train_df.unpersist()
        val_df.unpersist()
    return net, best, history
