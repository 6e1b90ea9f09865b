import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molspark.operators import autoencoder, density, entities, knnindex, metric, neighbors, ordering, som, stats
from molspark.plans.catalogue import ORACLES, QUERIES
from molspark.sources import tables
from molspark.sources.smiles import parse


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees(spark, data, agree, name):
    agree(QUERIES[name](spark, data), ORACLES[name])


@pytest.mark.parametrize("name", ["umap_layout", "som_train"])
def test_query_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_row_gets_a_neighbour_label(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    label = {r.vec_id: r.label for r in rows}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {int(i): int(ids[np.lexsort((ids, d))[0]]) for i, d in zip(ids, d2, strict=True)}
    got = QUERIES["nearest_neighbor_label"](spark, data).collect()
    assert len(got) == len(rows) and {r["query"]: r.id for r in got} == want and all(r.label == label[r.id] for r in got)
    assert any(r.id < 50 for r in got)


def test_entry_and_registry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    for kind in ("tanh", "relu"):
        net, x = autoencoder.Network(5, (4, 3), kind).start(1), rng.standard_normal((7, 5))
        got, _ = net.gradients(x)
        w = net.layers[1][0]
        w[0, 0] += 1e-6
        up = net.gradients(x)[1]
        w[0, 0] -= 2e-6
        down = net.gradients(x)[1]
        assert abs((up - down) / 2e-6 - got[2][0, 0]) < 1e-4


def test_training_lowers_loss(spark, data):
    rows = [r.val_loss for r in QUERIES["ae_train"](spark, data).collect()]
    assert rows[-1] < rows[0]


def test_map_training_lowers_error(spark, data):
    from molspark.operators import som
    from molspark.plans.catalogue import emb

    _, errors = som.train(emb(spark, data), 3, 3, 6)
    assert errors[-1] < max(errors[1:])


def test_too_few_valleys(spark):
    hist = spark.createDataFrame([(0, 0.0, 3), (1, 1.0, 1), (2, 2.0, 3)], "bin int, lo double, n long")
    assert [r.bin for r in density.valleys(hist).collect()] == [1]
    with pytest.raises(ValueError):
        density.valley_edges(hist, [7])


def test_split_is_exact(spark):
    got = ordering.exact_split(spark.range(101), "id").where("is_test").count()
    assert got == 31


def test_smiles_errors_and_order():
    assert parse(None)[2] and parse("not_a_smiles")[2] and parse("C1CC")[2] and parse("C(C")[2]
    assert [a["symbol"] for a in parse("ClCC")[0]] == ["Cl", "C", "C"]
    atoms, bonds, error = parse("C1=CC=CN1")
    assert error is None and all(a["aromatic"] for a in atoms) and {b["kind"] for b in bonds} == {"AROMATIC"}


def test_missing_file_is_logged(spark, caplog):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, "/no/such/table.csv", "a int")
    assert "/no/such/table.csv" in caplog.text and "PATH_NOT_FOUND" in caplog.text


def test_log_file_and_settings(tmp_path, monkeypatch):
    handler = tables.log_to(str(tmp_path / "run.log"))
    tables.LOG.info("one line")
    tables.LOG.removeHandler(handler)
    assert "INFO - one line" in (tmp_path / "run.log").read_text()
    for k, v in (("AUTOENCODER_HIDDEN_SIZE", "[12, 4]"), ("COLUMN_ENCODER", "{'a': 0}"), ("TRAIN_DATASET_PATH", "/x.csv"), ("AUTOENCODER_MODEL_PATH", "/m")):
        monkeypatch.setenv(k, v)
    got = tables.Config.from_env()
    assert (got.hidden_sizes, got.column_encoder, got.dataset, got.model_path) == ((12, 4), {"a": 0}, "/x.csv", "/m")
    monkeypatch.setenv("COLUMN_ENCODER", "__import__('os')")
    with pytest.raises(ValueError):
        tables.Config.from_env()


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, v array<double>")


def nearest_by_hand(x, k):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    return {(i, n + 1): (int(j), d2[i, j]) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), d2[i]))[:k])}


@pytest.mark.parametrize("block", [10_000, 0])
def test_nearest_brute(spark, monkeypatch, block):
    """Queries held by every task, and through the index in many blocks; ties to the smaller id."""
    for name, n in (("ROWS", 40), ("LEAST_ROWS", 10), ("QUERIES", 30)):
        monkeypatch.setattr(knnindex, name, n)
    monkeypatch.setattr(neighbors, "BLOCK", block)
    x = np.random.default_rng(0).integers(0, 4, (150, 4)).astype(float)
    rows = vectors(spark, x)
    got = {(r["query"], r["rank"]): (r.id, r.d2) for r in neighbors.nearest(rows, rows, 3, other_only=True).collect()}
    assert got == nearest_by_hand(x, 3)


def test_index_compares_few_pairs_of_grouped_rows(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((40, 6)) * 20, 50, axis=0) + rng.standard_normal((2000, 6))
    rows = vectors(spark, x)
    near, pairs = knnindex.nearest(rows, rows, 4, other_only=True)
    want = nearest_by_hand(x, 4)
    got = {(r["query"], r["rank"]): (r.id, r.d2) for r in near.collect()}
    assert got == want and pairs.first().pairs < 2000 * 2000 / 10


def test_index_with_a_large_group_of_copies(spark):
    """A third of all rows are one vector: they cost what a few rows do, and every one has its neighbours."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((500, 3)), rng.standard_normal((1000, 3)) * 5])
    rows = vectors(spark, x)
    near, pairs = knnindex.nearest(rows, rows, 3, other_only=True)
    assert {(r["query"], r["rank"]): (r.id, r.d2) for r in near.collect()} == nearest_by_hand(x, 3) and pairs.first().pairs < 1000 * 1010


def test_rows_about_equally_far_apart_are_ruled_out_in_single_precision(monkeypatch):
    """Bounds rule out nothing here: blocks are compared in whole products, and few pairs are measured in double precision."""
    rng, measured, plain = np.random.default_rng(10), [], metric.nearest_k

    def counted(ids, q, own, x, *more):
        measured.append(len(q) * len(x))
        return plain(ids, q, own, x, *more)

    for module in (metric, knnindex):
        monkeypatch.setattr(module, "nearest_k", counted)
    x, pivots = rng.standard_normal((6000, 32)), rng.standard_normal((20, 32))
    cell, d2 = metric.closest(x, pivots)
    low, high = (np.array([f(np.sqrt(d2[cell == c]), initial=0) for c in range(20)]) for f in (lambda v, initial: v.min(), np.max))
    index = knnindex.Index(pivots, low, high, np.zeros(20, int), np.ones(20, int))
    d, i, pairs = knnindex.search_block(index, np.arange(300), x[:300], np.full(300, np.inf), np.arange(6000), x, cell, np.sqrt(d2), 5)
    want = plain(np.arange(300), x[:300], np.arange(6000), x, 5)
    assert (d == want[0]).all() and (i == want[1]).all() and pairs.min() >= 6000 and sum(measured) < 300 * 6000 / 2


@pytest.mark.parametrize("scale, shift", [(1, 0), (1e-30, 0), (1e-3, 1e6), (1e20, 0), (1, 1e3)])
def test_single_precision_loses_no_row(scale, shift):
    """Whatever the scale, and with rows exactly as far as the limit: the same as in double precision."""
    x = np.random.default_rng(11).integers(0, 5, (3000, 6)).astype(float) * scale + shift
    ids = np.arange(3000)
    want = metric.nearest_k(ids[:50], x[:50], ids, x, 4)
    whole = metric.Reached(ids, x, x.mean(axis=0))
    limit = want[0][:, -1]
    got = [whole.nearest_k(ids[:50], x[:50], whole.asked(x[:50]), limit, a, a + 1000, 4) for a in (0, 1000, 2000)]
    d, i = got[0]
    for more in got[1:]:
        d, i = metric.merged(d, i, *more, 4)
    assert (d == want[0]).all() and (i == want[1]).all()


def test_index_on_odd_tables(spark):
    one, none = vectors(spark, np.ones((1, 2))), vectors(spark, np.ones((0, 2)))
    for base, asked, n in ((one, one, 0), (none, one, 0), (one, none, 0)):
        near, pairs = knnindex.nearest(base, asked, 3, other_only=True)
        assert near.count() == n and pairs.first().pairs <= 1
    rng = np.random.default_rng(9)
    base, asked = rng.standard_normal((300, 3)) + 1e5, rng.standard_normal((40, 3)) * 3 + 1e5
    near = knnindex.nearest(vectors(spark, base), vectors(spark, asked), 2)[0].collect()
    d2 = ((asked[:, None] - base[None]) ** 2).sum(2)
    assert {(r["query"], r["rank"]): (r.id, r.d2) for r in near} == {(i, k + 1): (int(j), d2[i, j]) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(300), d2[i]))[:2])}


def test_smooth_weights(spark):
    graph = spark.createDataFrame([(q, 100 + i, float((q + 1) * (i + 1)) ** 2) for q in range(3) for i in range(10)] + [(9, 100 + i, 0.0) for i in range(10)], "query long, id long, d2 double")
    got = neighbors.smooth_weights(graph).collect()
    for q in range(3):
        w = sorted((r.w for r in got if r["query"] == q), reverse=True)
        assert w[0] == 1 and abs(sum(w) - np.log2(10)) < 1e-4
    assert {r.w for r in got if r["query"] == 9} == {1.0}


def test_layout_distributed_or_not(spark):
    """Either way takes the same steps; groups that only link within themselves end up nearer than others."""
    x = np.random.default_rng(4).standard_normal((60, 3)) + 50 * (np.arange(60) % 3)[:, None]
    rows = vectors(spark, x, ids=range(100, 160))
    graph = spark.createDataFrame(neighbors.nearest(rows, rows, 5, other_only=True).collect())
    near = {r.id: (r.x, r.y) for r in neighbors.umap_layout(graph, epochs=2, power=3).collect()}
    far = {r.id: (r.x, r.y) for r in neighbors.umap_layout(graph, epochs=2, power=3, limit=0).collect()}
    assert set(near) == set(far) == set(range(100, 160)) and all(np.allclose(near[i], far[i]) for i in near)
    got = {r.id: (r.x, r.y) for r in neighbors.umap_layout(graph, epochs=400).collect()}
    p = np.array([got[i] for i in range(100, 160)])
    d, same = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), (np.arange(60) % 3)[:, None] == (np.arange(60) % 3)[None]
    assert d[same].mean() < d[~same].mean()
    assert neighbors.umap_layout(graph.limit(0)).count() == 0


def test_layout_steps_send_no_points_through_the_driver(spark, tmp_path):
    """However few the points, no join of a step broadcasts them."""
    points = spark.createDataFrame([(i, i, 1.0, float(i), float(-i)) for i in range(20)], "id long, slot long, t double, x double, y double")
    edges = spark.createDataFrame([(i, (i + d) % 20, 1.0, 0.5) for i in range(20) for d in (1, 19)], "own long, other long, w double, a double")
    points, edges = tables.written(points, str(tmp_path / "points")), tables.written(edges, str(tmp_path / "edges"))  # of known size
    for step in (neighbors.spectral_step(edges, points), neighbors.layout_step(edges.drop("a"), points.drop("t"), 0, 20, 0.3, 3)):
        assert step.count() == 20 and "Broadcast" not in step._jdf.queryExecution().executedPlan().toString()


def test_hash_of_longs_is_sparks(spark):
    rows = [(0, 1), (-5, 2**62), (7, -(2**63))]
    got = [r.h for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b", F.lit(3).cast("long")).alias("h")).collect()]
    assert neighbors.hashed(*np.array(rows).T, 3).tolist() == got


def test_spectral_start_equals_the_eigenvectors(spark):
    """On a graph of two loosely joined rings the start spans the leading non-trivial vectors; the layout keeps neighbours that a random one loses."""
    x = np.concatenate([np.stack([np.cos(t), np.sin(t), np.full(40, z)], 1) * 10 for t in [np.arange(40) * 2 * np.pi / 40] for z in (0.0, 0.3)])
    rows = vectors(spark, x)
    near = spark.createDataFrame(neighbors.nearest(rows, rows, 6, other_only=True).collect())
    placed = neighbors.umap_layout(near, epochs=0, power=400).collect()
    w = np.zeros((80, 80))
    for r in neighbors.fuzzy_union(neighbors.smooth_weights(near)).collect():
        w[r.a, r.b] = w[r.b, r.a] = r.w
    t = np.sqrt(w.sum(1))
    _, vectors_of = np.linalg.eigh(w / np.outer(t, t))
    lead = vectors_of[:, [-2, -3]]
    p = np.array([(r.x, r.y) for r in sorted(placed, key=lambda r: r.id)])
    rest = p - lead @ (lead.T @ p)
    assert np.linalg.norm(rest) < 0.05 * np.linalg.norm(p) and abs(p.T @ t).max() < 1e-6 * np.linalg.norm(p)
    score = lambda places: neighbors.preserved(near, places, 6).first().kept
    random_ = neighbors.numbered_points(rows, 1)
    assert score(neighbors.umap_layout(near, epochs=150)) > max(0.5, 3 * score(random_))


def test_positions_of_keys_far_apart(spark):
    keys = [10**12 + i**3 for i in range(400)] + [5, 7, -3]
    got = ordering.by_position(spark.createDataFrame([(k,) for k in keys], "k long").repartition(7), "k", rows=40).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.row)] == sorted(keys) and sorted(r.row for r in got) == list(range(1, len(keys) + 1))
    assert ordering.by_position(spark.createDataFrame([], "k long"), "k").count() == 0


def test_correlation_with_nulls_and_constants(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5))
    x[:, 1] += x[:, 0]
    x[:, 2] = 0.1 + 0.2  # constant
    x[:, 3] *= 1e-12  # small, but not constant
    rows = [(i, [None if rng.random() < 0.2 and k != 2 else float(c) for k, c in enumerate(v)]) for i, v in enumerate(x)]
    frame = pd.DataFrame([v for _, v in rows], dtype=float).corr()
    for r in stats.correlation(spark.createDataFrame(rows, "id long, v array<double>"), 5).collect():
        if 2 in (r.i, r.j):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - frame.iloc[r.i, r.j]) < 1e-9


@pytest.mark.parametrize("giant", [100_000, 100])
def test_entity_sums_brute(spark, monkeypatch, giant):
    monkeypatch.setattr(entities, "GIANT", giant)
    rows = [(1, i, 1.0) for i in range(500)] + [(2, 1, 5.0), (2, 2, 6.0), (2, 2, 7.0), (3, 4, 1.0), (4, None, 2.0), (5, 1, None), (5, 2, 3.0)]
    df = spark.createDataFrame(rows, "e long, i int, x double")
    assert entities.giants(df, "e") == ([1] if giant == 100 else [])
    both = entities.entity_sums(df, "e", "i", {"n": F.lit(1), "x": F.col("x")}, drop_last=True, whole={"all": F.lit(1)}).collect()
    got = {r.e: (r.n, r.x) for r in both}
    assert {r.e: r["all"] for r in both} == {1: 500, 2: 3, 3: 1, 4: 1, 5: 2}
    assert got == {1: (499, 499.0), 2: (1, 5.0), 3: (0, 0.0), 4: (0, 0.0), 5: (1, 0.0)}


def test_adam_and_steps(spark):
    """Two epochs of two steps against the update written out."""
    x = np.random.default_rng(1).standard_normal((40, 5))
    rows, net = vectors(spark, x), autoencoder.Network(5, (3,)).start(2)
    share = {r.id: tuple(r)[1:] for r in rows.select("id", *(F.pmod(F.xxhash64("id", F.lit(e)), F.lit(2)) for e in range(2))).collect()}
    last, best, past = autoencoder.train(rows, rows, net, epochs=2, rate=0.01, decay=0.1, step=1, steps=2)
    w = [a.copy() for pair in net.layers for a in pair]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for e in range(2):
        for k in range(2):
            own, t = [i for i in range(40) if share[i][e] == k], t + 1
            g, _ = autoencoder.Network(5, (3,), "tanh", [(w[0], w[1]), (w[2], w[3])]).gradients(x[own])
            for a, b, c, d in zip(w, g, m, v, strict=True):
                b = b / len(own) + 0.1 * a
                c += 0.1 * (b - c)
                d += 0.001 * (b * b - d)
                a -= 0.01 * 0.5**e * (c / (1 - 0.9**t)) / (np.sqrt(d / (1 - 0.999**t)) + 1e-8)
    assert all(np.allclose(a, b) for a, b in zip(w, (a for pair in last.layers for a in pair), strict=True))
    assert len(past) == 2 and abs(past[1][2] - float(((last.forward(x) - x) ** 2).mean())) < 1e-12
    assert abs(autoencoder.mse(rows, last).first().mse - past[1][2]) < 1e-12


def test_map_starts_near_the_rows(spark):
    x = np.random.default_rng(5).standard_normal((80, 3)) * [1, 10, 0]
    got = som.starting(vectors(spark, x), 30, "kde")
    assert got.shape == (30, 3) and not got[:, 2].any() and 3 < got[:, 1].std() < 30
    w, _ = som.train(vectors(spark, x), 2, 2, 1, start=got[:4], rate=0.5)
    assert np.allclose(w, got[:4] + 0.5 * (som.epoch(vectors(spark, x), got[:4], 2, 2) - got[:4]))


def test_cluster_pipeline_brute(spark, data):
    """The centers of scaled rows whose features have unlike scales: each has the score of the raw row that is nearest to it in raw units."""
    from molspark.plans import pipelines

    rows = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id as id", "transform(cast(embedding as array<double>), (x, i) -> x * pow(3.0, i % 7) + i) as v", "label / 10 as score")
    z, scale = pipelines.scaled(rows, 64)
    net = autoencoder.Network(64, (16, 8)).start()
    labels, centers = pipelines.cluster_ranges(spark, z, "score", net, 3, 3, 2)
    means, scored = pipelines.explain(centers, scale, rows, "score")
    own = rows.collect()
    x, ids = np.array([r.v for r in own]), np.array([r.id for r in own])
    score = {(r.bucket, r.neuron): r.score for r in scored.collect()}
    back = {(r.bucket, r.neuron): np.array(r.v) * x.std(axis=0) + x.mean(axis=0) for r in centers.collect()}
    for key, v in back.items():
        assert score[key] == own[np.lexsort((ids, ((x - v) ** 2).sum(1)))[0]].score
    assert labels.count() == sum(r.score < 1 for r in own) and len(score) == 9 * labels.select("bucket").distinct().count()
    for r in means.collect():
        assert np.isclose(r["mean"], np.mean([v[r.dim] for (b, _), v in back.items() if b == r.bucket]))


def test_marks_and_unlisted_elements():
    assert [parse(f"F/C=C{m}F")[1][1]["stereo"] for m in "/\\"] == ["STEREOE", "STEREOZ"]
    assert [parse(f"N[C{m}H](C)O")[0][1]["chirality"] for m in ("", "@", "@@", "@TH1", "@TH2", "@SP1")] == ["CHI_UNSPECIFIED", "CHI_TETRAHEDRAL_CCW", "CHI_TETRAHEDRAL_CW", "CHI_TETRAHEDRAL_CCW", "CHI_TETRAHEDRAL_CW", "CHI_SQUAREPLANAR"]
    assert parse("[Ru]")[0][0]["mass"] == 101.07 and parse("[Xx]")[2] and parse("C*")[0][1]["mass"] == 0
    assert parse("N<-C")[1][0]["kind"] == "DATIVE" and parse("[Fe+2]")[0][0]["charge"] == 2
