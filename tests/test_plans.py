"""Maps of all ranges together, cluster files, rows by their place in files, ranges as a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.operators import autoencoder, buckets, som
from molspark.plans import pipelines
from molspark.sources import tables


def plain_map(x, w, m, n, epochs, radius, rate):
    """A batch map, written out; its error before each epoch."""
    grid, errors = np.array([(i, j) for i in range(m) for j in range(n)]), []
    for e in range(epochs):
        d = ((x[:, None] - w[None]) ** 2).sum(2)
        near, r = d.argmin(1), max(0.5, radius * (1 - e / epochs))
        errors.append(np.sqrt(d.min(1)).mean())
        h = np.exp(-((grid[near][:, None] - grid[None]) ** 2).sum(2) / (2 * r * r))
        w = w + (1.0 if rate >= 1 else rate * (1 - e / epochs)) * (h.T @ x / h.sum(0)[:, None] - w)
    return w, errors


@pytest.mark.parametrize("rate", [1.0, 0.5])
def test_maps_of_groups_equal_plain_ones(spark, rate):
    rng = np.random.default_rng(0)
    x, g = rng.standard_normal((240, 5)), rng.integers(0, 4, 240)
    rows = spark.createDataFrame([(i, int(k), [float(c) for c in v]) for i, (k, v) in enumerate(zip(g, x, strict=True))], "id long, g int, v array<double>").repartition(5)
    start = som.starting_groups(rows, "g", 6)
    assert all((start[k] == x[g == k][:6]).all() for k in range(4))
    maps, errors = som.train_groups(rows, "g", start, 2, 3, 3, rate=rate)
    near = {r.id: (r.g, r.neuron) for r in som.bmu(rows, maps, group="g").collect()}
    for k in range(4):
        w, error = plain_map(x[g == k], start[k], 2, 3, 3, som.RADIUS, rate)
        assert np.allclose(maps[k], w) and np.allclose(errors[k], error)
        assert all(near[i] == (k, ((x[i] - w) ** 2).sum(1).argmin()) for i in np.flatnonzero(g == k))


def test_one_pass_an_epoch_over_all_groups(spark):
    """Jobs don't grow with the groups."""
    rows = spark.createDataFrame([(i, i % 7, [float(i), float(i * i % 11)]) for i in range(70)], "id long, g int, v array<double>").persist()
    start, jobs = som.starting_groups(rows, "g", 4), {}
    for few in (1, 7):
        spark.sparkContext.setJobGroup(f"maps-{few}", "")
        som.train_groups(rows, "g", {k: start[k] for k in range(few)}, 2, 2, 3)
        jobs[few] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"maps-{few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[7]


def test_rows_are_read_and_packed_once(spark, monkeypatch):
    """Epochs read bytes that are held: the table itself is read once, whatever the number of epochs."""
    monkeypatch.setattr(som, "SLICE", 8)
    rng, seen = np.random.default_rng(5), spark.sparkContext.accumulator(0)
    x, g = rng.standard_normal((90, 3)), np.arange(90) % 2

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(i, int(k), [float(c) for c in v]) for i, (k, v) in enumerate(zip(g, x, strict=True))], "id long, g int, v array<double>")
    start = {k: x[g == k][:4] for k in (0, 1)}
    maps, _ = som.train_groups(rows.mapInPandas(counted, rows.schema), "g", start, 2, 2, 3)
    assert seen.value == 90 and all(np.allclose(maps[k], plain_map(x[g == k], start[k], 2, 2, 3, som.RADIUS, 1.0)[0]) for k in (0, 1))
    held = [(r.g, len(r.v) // 24) for r in som.packed(rows, "g").collect()]
    assert max(n for _, n in held) <= 8 and sum(n for k, n in held if k == 0) == 45


def test_starts_of_groups_by_density(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, i % 2, [float(c) for c in rng.standard_normal(3) * (1 + 9 * (i % 2))]) for i in range(200)], "id long, g int, v array<double>")
    got = som.starting_groups(rows, "g", 40, "kde")
    assert np.allclose(got[1], som.starting(rows.where("g = 1"), 40, "kde")) and got[0].std() < 2 < got[1].std()


def test_closest_with_ties_and_far_rows():
    from molspark.operators.metric import closest

    rng = np.random.default_rng(2)
    for shift in (0.0, 1e6):
        x, w = rng.integers(0, 3, (300, 4)).astype(float) + shift, rng.integers(0, 3, (40, 4)).astype(float) + shift
        d = ((x[:, None] - w[None]) ** 2).sum(2)
        near, d2 = closest(x, w)
        assert (near == d.argmin(1)).all() and (d2 == d.min(1)).all()


@pytest.fixture
def scored(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, [float(c) for c in rng.standard_normal(4)], float(rng.random() * 1.2 - 0.1)) for i in range(300)], "id long, v array<double>, qed double")


def test_warm_start_goes_on_from_the_range_before(spark, scored):
    net = autoencoder.Network(4, (3,)).start(1)
    labels, centers = pipelines.cluster_ranges(spark, scored, "qed", net, 2, 2, 3, warm_start=True)
    rows, last = scored.collect(), None
    for k, lo, hi in buckets.limits():
        x = net.encode(np.array([r.v for r in rows if lo <= r.qed < hi]))
        last, _ = plain_map(x, x[:4] if last is None else last, 2, 2, 3, som.RADIUS, 1.0)
        got = np.array([r.v for r in centers.where(F.col("bucket") == k).orderBy("neuron").collect()])
        assert np.allclose(got, net.decode(last))
    assert labels.count() == sum(0 <= r.qed < 1 for r in rows)


def test_cluster_files_by_name(spark, scored):
    names, net, folder = ["a", "b", "c d", "e"], autoencoder.Network(4, (3,)).start(1), tables.shared_folder(spark)
    labels, centers = pipelines.cluster_ranges(spark, scored, "qed", net, 2, 2, 3, folder=folder, features=names)
    own, label = {r.id: r for r in scored.collect()}, {r.id: (r.bucket, r.neuron) for r in labels.collect()}
    seen = 0
    for k, _, _ in buckets.limits():
        at = f"{folder}/group_{k}"
        rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{at}/labeled_data")
        assert rows.columns == ["id", *names, "qed", "label"]
        for r in rows.collect():
            assert [r[c] for c in names] == own[r.id].v and r.qed == own[r.id].qed and (k, r.label) == label[r.id]
            seen += 1
        assert spark.read.option("header", True).csv(f"{at}/decoded_data").columns == names
        assert spark.read.option("header", True).csv(f"{at}/matrix_data").columns == ["0", "1", "2", "3"]
        assert spark.read.option("header", True).csv(f"{at}/tokenized_data").columns == ["0", "1", "2"]
    assert seen == len(label)
    back = {(r.bucket, r.neuron): r.v for r in pipelines.decoded_centers(spark, folder, names).collect()}
    assert back == {(r.bucket, r.neuron): r.v for r in centers.collect()}
    assert pipelines.decoded_centers(spark, f"{folder}/none", names).count() == 0


def test_no_row_in_any_range(spark, scored):
    labels, centers = pipelines.cluster_ranges(spark, scored.withColumn("qed", F.col("qed") + 5), "qed", autoencoder.Network(4, (3,)).start(1))
    assert labels.count() == centers.count() == 0


@pytest.mark.parametrize("limit,cost", [("300", "1"), ("100000", "100000000")])
def test_rows_by_their_place_in_files(spark, limit, cost):
    """Files in many pieces to a partition and many partitions, an empty one among them."""
    path = tables.shared_folder(spark)
    rows = spark.range(2000).repartitionByRange(7, "id").sortWithinPartitions("id").where("id < 500 or id >= 900").selectExpr("cast(id * 7 as double) as x")
    tables.write_csv(rows, path)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(held, (limit, cost), strict=True):
            spark.conf.set(k, v)
        got = tables.read_csv_in_order(spark, path, "x double").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = [7.0 * i for i in range(2000) if i < 500 or i >= 900]
    assert [r.x for r in sorted(got, key=lambda r: r.row)] == want and sorted(r.row for r in got) == list(range(1600))


def test_places_start_anew_in_each_group(spark):
    """Groups of several files in one scan: places count from 0 in each, and only the paths given are read."""
    folder = tables.shared_folder(spark)
    for k, n in ((0, 50), (3, 1), (12, 400)):
        tables.write_csv(spark.range(n).repartitionByRange(5, "id").sortWithinPartitions("id").selectExpr(f"cast(id + {k} * 1000 as double) as x"), f"{folder}/group_{k}/decoded_data")
    tables.write_csv(spark.range(9).selectExpr("cast(id as double) as x"), f"{folder}/group_0/labeled_data")
    got = pipelines.decoded_centers(spark, folder, ["x"])
    assert got.columns == ["bucket", "neuron", "v"]
    assert sorted((r.bucket, r.neuron, r.v[0]) for r in got.collect()) == [(k, i, float(i + k * 1000)) for k, n in ((0, 50), (3, 1), (12, 400)) for i in range(n)]


def test_ranges_as_a_table(spark):
    rng = np.random.default_rng(4)
    limits = [(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.normal(size=60) * 10, 10.0 ** rng.integers(-4, 3, 60), strict=True))]
    limits += [(100, None, 0.0), (101, 1.0, None), (102, None, None), (103, 2.0, 2.0), (104, 3.0, 1.0), (105, -1e300, 1e300), (106, 0.5, 0.75)]
    xs = [*(rng.normal(size=200) * 10).tolist(), *(x for _, a, b in limits for x in (a, b)), float("nan"), 1e18, -1e18, 0.5, 0.75]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    got = buckets.by_limits(rows, "x", spark.createDataFrame(limits, "bucket int, lo double, hi double"))
    want = [(i, k) for i, x in enumerate(xs) if x is not None and x == x for k, a, b in limits if (a is None or x >= a) and (b is None or x < b)]
    assert got.columns == ["i", "x", "bucket"] and sorted((r.i, r.bucket) for r in got.collect()) == want
    assert buckets.by_limits(rows, "x", spark.createDataFrame([], "bucket int, lo double, hi double")).count() == 0


def test_training_from_files_goes_on(spark):
    """Stopped after two epochs and called again, the files are those of an unbroken run; codes are those of the best network."""
    from molspark.sources.tables import Config
    from molspark.streaming import history

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(c) for c in rng.standard_normal(5)]) for i in range(120)], "id long, v array<double>")
    runs = {}
    for name, stops in (("whole", (4,)), ("parts", (2, 4))):
        folder = tables.shared_folder(spark)
        for epochs in stops:
            net, past, codes = pipelines.run_train(rows, Config(hidden_sizes=(3,), epochs=epochs, learning_rate=0.01), folder)
        model = autoencoder.Network(5, (3,)).load(spark, f"{folder}/model")
        x = {r.id: r.v for r in rows.collect()}
        assert all(np.allclose(r.v, model.encode(np.array([x[r.id]]))[0]) for r in codes.collect())
        runs[name] = (past, sorted(map(tuple, history.read_history(spark, f"{folder}/training_losses").collect())), [a.tolist() for pair in net.layers for a in pair])
    assert runs["whole"] == runs["parts"] and len(runs["whole"][1]) == 4


def test_density_without_pairs(spark):
    """The binned estimate against all kernels, with outliers and repeated values."""
    from molspark.operators import density

    rng = np.random.default_rng(5)
    for x in (rng.normal(size=3000), np.concatenate([rng.normal(size=500), [1e4, -3e3], np.zeros(300)]), np.array([1.0, 2.0])):
        got = density.kde(spark, spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", 50).orderBy("point").collect()
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 50)
        want = np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert len(got) == 50 and np.allclose([r.x for r in got], grid) and abs(np.array([r.density for r in got]) - want).max() < 1e-10 * want.max()
    assert density.kde(spark, spark.createDataFrame([], "x double"), "x").count() == 0


def test_scan_reads_only_the_groups_asked_for(spark, data):
    from molspark.plans.catalogue import QUERIES

    plan = QUERIES["group_scan_pruned"](spark, data)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    path = tables.shared_folder(spark)
    rows = spark.range(40).selectExpr("id", "cast(id % 4 as int) as g")
    tables.write_groups(rows, path, "g")
    got = tables.read_groups(spark, path, "g", rows.schema).where("g >= 2")
    assert "PartitionFilters: [isnotnull(g" in got._jdf.queryExecution().toString() and got.count() == 20
    tables.remove(spark, f"{path}/g=0")  # the others are never opened
    assert {r.g for r in got.select("g").distinct().collect()} == {2, 3}


def test_csv_with_names_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_text('S,a b,"x,y",S,,s\n1,p,2.5,9,7,z\n,"q,r",,8,,\n')
    got = tables.read_csv_first_named(spark, str(tmp_path / "a.csv"), {"S": "int", "x,y": "double"})
    assert got.columns == ["S", "a b", "x,y", "", "s"] and [tuple(r) for r in got.collect()] == [(1, "p", 2.5, "7", "z"), (None, "q,r", None, None, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv_first_named(spark, str(tmp_path / "none.csv"), {})
