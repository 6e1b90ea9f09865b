"""Batches one after another, averaged over shards; states that training goes on from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import autoencoder, localsgd
from molspark.sources import tables


def rows_of(spark, x, test):
    return spark.createDataFrame([(int(i), [float(c) for c in v], bool(t)) for i, (v, t) in enumerate(zip(x, test, strict=True))], "id long, v array<double>, is_test boolean")


@pytest.fixture
def sample():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((203, 3)) @ rng.standard_normal((3, 6))
    return x, np.arange(203) % 4 == 0


def by_hand(net, x, test, epochs, rate, decay, step, gamma, batch):
    """Training in batches, written out."""
    w = [a.copy() for pair in net.layers for a in pair]
    m, v, t, past = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, []
    at = lambda: autoencoder.Network(net.width, net.hidden, net.activation, list(zip(w[::2], w[1::2], strict=True)))
    ids, xs, held = np.flatnonzero(~test), x[~test], x[test]
    for e in range(epochs):
        order, losses = localsgd.batch_order(ids, e), []
        for i in range(0, len(xs), batch):
            rows, t = xs[order[i : i + batch]], t + 1
            g, loss = at().gradients(rows)
            losses.append(loss / len(rows))
            for a, b, c, d in zip(w, g, m, v, strict=True):
                b = b / len(rows) + decay * a
                c += 0.1 * (b - c)
                d += 0.001 * (b * b - d)
                a -= rate * gamma ** (e // step) * (c / (1 - 0.9**t)) / (np.sqrt(d / (1 - 0.999**t)) + 1e-8)
        val = [((at().forward(held[i : i + batch]) - held[i : i + batch]) ** 2).mean() for i in range(0, len(held), batch)]
        past.append((e, np.mean(losses), np.mean(val)))
    return w, past


def test_one_shard_is_plain_training(spark, sample):
    x, test = sample
    net = autoencoder.Network(6, (4, 2)).start(1)
    seen = []
    last, best, past = localsgd.train(rows_of(spark, x, test).repartition(5), net, 4, 0.01, 0.1, step=2, batch=32, on_epoch=lambda *a: seen.append((a[0], a[4])))
    w, want = by_hand(net, x, test, 4, 0.01, 0.1, 2, 0.5, 32)
    assert np.allclose(localsgd.flatten(last), np.concatenate([a.ravel() for a in w])) and np.allclose(past, want)
    assert [e for e, _ in seen] == [0, 1, 2, 3] and seen[0][1]
    assert best is not None and past[-1][2] < past[0][2]


def test_shards_are_averaged_by_their_rows(spark, sample):
    x, test = sample
    net = autoencoder.Network(6, (3,)).start(2)
    rows = rows_of(spark, x, test)
    last, _, past = localsgd.train(rows, net, 1, 0.02, 0.0, batch=16, shard=50)
    own = {r.id: r.shard for r in localsgd.shards(rows, 50).collect()}
    total, losses, n = 0, 0.0, 0
    for s in set(own.values()):
        ids = np.array([i for i in range(203) if own[i] == s and not test[i]])
        state, loss, batches = localsgd.run_epoch(net, x[ids], ids, localsgd.State.of(net), 0.02, 0.0, 16)
        total, losses, n = total + state.flat * len(ids), losses + loss, n + batches
    assert len(set(own.values())) > 2 and np.allclose(localsgd.flatten(last), total / (~test).sum()) and np.isclose(past[0][1], losses / n)


def test_batches_reach_less_than_large_steps(spark, sample):
    x, test = sample
    net, rows = autoencoder.Network(6, (4, 3)).start(3), rows_of(spark, x, test)
    _, _, small = localsgd.train(rows, net, 5, 0.01)
    _, _, large = autoencoder.train(rows.where("not is_test"), rows.where("is_test"), net, 5, 0.01)
    assert small[-1][2] < large[-1][2]


def test_resumed_training_equals_an_unbroken_run(spark, sample):
    x, test = sample
    net, rows, folder = autoencoder.Network(6, (4,)).start(4), rows_of(spark, x, test), tables.shared_folder(spark)
    whole = localsgd.train(rows, net, 5, 0.01)
    localsgd.train(rows, net, 2, 0.01, folder=folder)
    spark.range(3).write.parquet(f"{folder}/epoch-000003")  # a state that was never committed
    tables.remove(spark, f"{folder}/epoch-000003/_SUCCESS")
    assert localsgd.State.latest(spark, folder).epoch == 2
    again = localsgd.train(rows, net, 5, 0.01, folder=folder)
    assert again[2] == whole[2] and all((localsgd.flatten(a) == localsgd.flatten(b)).all() for a, b in zip(again[:2], whole[:2], strict=True))
    assert localsgd.train(rows, net, 5, 0.01, folder=folder)[2] == whole[2]  # nothing left to do


def test_empty_parts(spark, sample):
    x, test = sample
    net = autoencoder.Network(6, (4,)).start(5)
    _, _, past = localsgd.train(rows_of(spark, x, test & False), net, 2)
    assert len(past) == 2 and past[0][2] == 0
    last, _, past = localsgd.train(rows_of(spark, x, test).where(F.lit(False)), net, 1)
    assert (localsgd.flatten(last) == localsgd.flatten(net)).all()


def test_each_shard_has_a_task_of_its_own(spark, sample, monkeypatch):
    """No two shards meet in one partition, whatever their number, and packing keeps every row in its shard's."""
    monkeypatch.setattr(localsgd, "PACKED", 7)
    rows = rows_of(spark, *sample)
    for size in (50, 30, 10):
        dealt = localsgd.shards(rows, size)
        held = dealt.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
        assert len({r.p for r in held}) == len(held) == len({r.shard for r in held})
        got = [(r.shard, r.is_test, i, tuple(v)) for r in localsgd.packed(dealt).collect() for i, v in zip(np.frombuffer(r.ids, np.int64), np.frombuffer(r.v).reshape(-1, 6), strict=True)]
        assert sorted(got) == sorted((r.shard, r.is_test, r.id, tuple(r.v)) for r in dealt.collect())
