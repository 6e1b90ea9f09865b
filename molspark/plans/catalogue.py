"""The engine's queries over the driver's tables, and their DuckDB equivalents, by name.

The tables hold no molecules, so operators run on analogues: an order is a molecule and its lines are atoms
or bonds; embeddings are the feature matrix; ten times the discount is the score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import autoencoder, buckets, density, entities, knnindex, localsgd, neighbors, ordering, som, stats
from ..schema import EDGES, FEATURES, RADII
from ..sources import tables
from ..sources.smiles import parse_smiles
from ..sources.tables import Config, table
from ..streaming import history
from . import molecules as hand
from . import pipelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def emb(spark: SparkSession, d: str) -> DataFrame:
    return stats.vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def r6(c, digits: int = 6):
    return F.round(c, digits)


LONG = "SELECT vec_id AS id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"
SCALE = f"SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM ({LONG}) GROUP BY dim"
SCORE = "l_discount * 10::DOUBLE"
LIMITS = "(VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, a, b in buckets.limits()) + ") AS t(bucket, lo, hi)"


# ---- scalar encodings
@query("SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT AS h0, (c_mktsegment = 'BUILDING')::INT AS h1, (c_mktsegment = 'FURNITURE')::INT AS h2, (coalesce(c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'), true))::INT AS h3 FROM customer")
def onehot_permitted(spark, d):
    hot = scalar.one_hot(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "Unknown"])
    return table(spark, d, "customer").select("c_custkey", *(hot[i].alias(f"h{i}") for i in range(4)))


@query("SELECT p_partkey, round((p_retailprice - 10.812::DOUBLE) / 116.092::DOUBLE, 6) AS scaled FROM part")
def affine_scale(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(scalar.affine(F.col("p_retailprice"), 10.812, 116.092)).alias("scaled"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INT AS code FROM orders")
def map_lookup_encode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.lookup(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("code"))


@query("SELECT o_orderkey, round_even(o_totalprice / 7::DOUBLE * 100::DOUBLE, 0) / 100::DOUBLE AS rounded FROM orders")
def round_half_even(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.round_half_even(F.col("o_totalprice") / F.lit(7.0)).alias("rounded"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(spark, d):
    return emb(spark, d).select(F.col("id").alias("vec_id"), r6(scalar.norm(F.col("v"))).alias("norm"))


# ---- sums by entity
def _lines() -> dict:
    flag = F.col("l_returnflag")
    return {"n": F.lit(1), "qty": F.col("l_quantity"), "flag_a": (flag == "A").cast("int"), "flag_n": (flag == "N").cast("int")}


SUMS = "count(*) AS n, sum(l_quantity) AS qty, sum((l_returnflag = 'A')::INT)::BIGINT AS flag_a, sum((l_returnflag = 'N')::INT)::BIGINT AS flag_n"
EXCEPT = """SELECT l_orderkey, coalesce(sum(k), 0)::BIGINT AS n, coalesce(sum(CASE WHEN k = 1 THEN l_quantity END), 0::DOUBLE) AS qty, coalesce(sum(CASE WHEN k = 1 THEN (l_returnflag = 'A')::INT END), 0)::BIGINT AS flag_a,
 coalesce(sum(CASE WHEN k = 1 THEN (l_returnflag = 'N')::INT END), 0)::BIGINT AS flag_n FROM (SELECT *, (l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey))::INT AS k FROM lineitem) GROUP BY l_orderkey"""


@query(f"SELECT l_orderkey, {SUMS} FROM lineitem GROUP BY l_orderkey")
def entity_sum_all(spark, d):
    return entities.entity_sums(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", _lines())


@query(EXCEPT)
def entity_sum_except_last(spark, d):
    return entities.entity_sums(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", _lines(), drop_last=True)


@query(f"SELECT l_orderkey, a.n AS atoms, a.qty AS atom_qty, b.n AS bonds, b.qty AS bond_qty FROM ({EXCEPT}) a FULL JOIN (SELECT l_orderkey, {SUMS} FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)")
def entity_feature_join(spark, d):
    """Both kinds of sums of one table side by side, from one scan and one shuffle."""
    n, qty = F.lit(1), F.col("l_quantity")
    return entities.entity_sums(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", {"atoms": n, "atom_qty": qty}, True, {"bonds": n, "bond_qty": qty})


@query(f"SELECT l_orderkey, a.n AS atoms, a.qty AS atom_qty, b.n AS bonds, b.qty AS bond_qty FROM (SELECT * FROM ({EXCEPT}) WHERE n > 3) a FULL JOIN (SELECT l_orderkey, {SUMS} FROM lineitem GROUP BY l_orderkey HAVING count(*) < 6) b USING (l_orderkey)".replace("a.n AS atoms, a.qty AS atom_qty, b.n AS bonds, b.qty AS bond_qty", "coalesce(a.n, 0) AS atoms, coalesce(a.qty, 0::DOUBLE) AS atom_qty, coalesce(b.n, 0) AS bonds, coalesce(b.qty, 0::DOUBLE) AS bond_qty"))
def entity_tables_join(spark, d):
    """Sums of two tables side by side, each of which lacks some entities of the other."""
    a = entity_sum_except_last(spark, d).where("n > 3").select("l_orderkey", F.col("n").alias("atoms"), F.col("qty").alias("atom_qty"))
    b = entity_sum_all(spark, d).where("n < 6").select("l_orderkey", F.col("n").alias("bonds"), F.col("qty").alias("bond_qty"))
    return entities.joined_features(a, b, "l_orderkey")


# ---- statistics
@query(f"SELECT dim, round(mu, 6) AS mu, round(sd, 6) AS sd FROM ({SCALE})")
def scaler_stats(spark, d):
    return stats.scaler_stats(emb(spark, d), DIM).select("dim", r6("mu").alias("mu"), r6("sd").alias("sd"))


@query(f"SELECT id, dim, round((x - mu) / sd, 6) AS z FROM ({LONG}) JOIN ({SCALE}) USING (dim)")
def standardize_pop(spark, d):
    e = emb(spark, d)
    return stats.standardized(e, stats.scaler_stats(e, DIM)).select("id", "dim", r6("z").alias("z"))


@query(f"SELECT id, dim, round((x - mu) / sd * sd + mu, 6) AS x FROM ({LONG}) JOIN ({SCALE}) USING (dim)")
def inverse_standardize(spark, d):
    e = emb(spark, d)
    scale = stats.scaler_stats(e, DIM)
    return stats.restored(stats.standardized(e, scale), scale).select("id", "dim", r6("x").alias("x"))


@query(f"WITH l AS ({LONG}) SELECT a.dim AS i, b.dim AS j, round(corr(a.x, b.x), 6) AS corr FROM l a JOIN l b ON a.id = b.id AND a.dim <= b.dim GROUP BY a.dim, b.dim")
def corr_matrix_long(spark, d):
    return stats.correlation(emb(spark, d), DIM).select("i", "j", r6("corr").alias("corr"))


@query(f"SELECT dim, round(corr(x, label::DOUBLE), 6) AS corr FROM ({LONG}) GROUP BY dim")
def corr_with_target(spark, d):
    return stats.correlation_with(emb(spark, d), DIM, "label").select("dim", r6("corr").alias("corr"))


@query(f"SELECT dim FROM (SELECT id, dim, CASE WHEN dim IN (5, 9) THEN 1::DOUBLE ELSE x END AS x FROM ({LONG})) GROUP BY dim HAVING stddev_pop(x) > 0")
def nonconstant_columns(spark, d):
    e = emb(spark, d).withColumn("v", F.transform("v", lambda x, i: F.when(i.isin(5, 9), 1.0).otherwise(x)))
    return stats.nonconstant(e, DIM)


@query(f"SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM ({LONG}) GROUP BY label, dim")
def group_mean_std(spark, d):
    return stats.group_mean_std(emb(spark, d), DIM, "label").select("label", "dim", r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT dim, " + ", ".join(f"round(avg(CASE WHEN label = {k} THEN x END), 6) AS g{k}" for k in range(10)) + f" FROM ({LONG}) GROUP BY dim")
def transpose_stats(spark, d):
    means = stats.group_mean_std(emb(spark, d), DIM, "label")
    turned = means.groupBy("dim").pivot("label", list(range(10))).agg(F.first("mean"))
    return turned.select("dim", *(r6(F.col(f"`{k}`")).alias(f"g{k}") for k in range(10)))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, round_even(avg({c}) * 100::DOUBLE, 0) / 100::DOUBLE AS mean FROM lineitem GROUP BY l_returnflag" for c in MEASURES)
    + ") SELECT l_returnflag, feature, mean FROM m WHERE feature IN (SELECT feature FROM m GROUP BY feature HAVING min(mean) > 0.05::DOUBLE)"
)
def mean_mask_drop_any(spark, d):
    means = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*(F.avg(c).alias(c) for c in MEASURES))
    return stats.surviving_means(means.unpivot("l_returnflag", MEASURES, "feature", "mean"), "l_returnflag", "feature")


# ---- ranges
@query(f"SELECT bucket::INT AS bucket, lo, hi FROM {LIMITS}")
def limits_from_edges(spark, d):
    return buckets.limits_table(spark, EDGES)


@query(f"SELECT bucket::INT AS bucket, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem JOIN {LIMITS} ON {SCORE} >= lo AND {SCORE} < hi GROUP BY bucket")
def range_bucket_profile(spark, d):
    got = buckets.profile(table(spark, d, "lineitem"), F.col("l_discount") * F.lit(10.0), "l_quantity")
    return got.select("bucket", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"SELECT sum(({SCORE} >= 1)::INT)::BIGINT AS above, sum(({SCORE} < 0)::INT)::BIGINT AS below, sum((l_discount IS NULL)::INT)::BIGINT AS missing FROM lineitem")
def rows_in_no_range(spark, d):
    s = F.col("l_discount") * F.lit(10.0)
    one = lambda c, k: F.sum(c.cast("int")).alias(k)
    return table(spark, d, "lineitem").agg(one(s >= 1, "above"), one(s < 0, "below"), one(s.isNull(), "missing"))


# ---- density
HIST = """b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem),
 c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 125::DOUBLE))::INT, 124) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1),
 h AS (SELECT r.range::INT AS bin, lo + r.range * ((hi - lo) / 125::DOUBLE) AS lo, coalesce(n, 0) AS n, coalesce(n, 0) / (total * ((hi - lo) / 125::DOUBLE)) AS density FROM range(125) r CROSS JOIN b LEFT JOIN c ON c.bin = r.range)"""
VALLEYS = f"""{HIST}, f AS (SELECT *, (n <> coalesce(lag(n) OVER (ORDER BY bin), n + 1))::INT AS new FROM h),
 g AS (SELECT *, sum(new) OVER (ORDER BY bin) AS run FROM f), k AS (SELECT run, min(bin) AS l, max(bin) AS u, any_value(n) AS n FROM g GROUP BY run),
 e AS (SELECT *, lag(n) OVER (ORDER BY run) AS before, lead(n) OVER (ORDER BY run) AS after FROM k),
 v AS (SELECT floor((l + u) / 2)::INT AS bin FROM e WHERE before > n AND after > n)"""


def _hist(spark, d):
    return density.histogram(table(spark, d, "lineitem"), "l_extendedprice")


@query(f"WITH {HIST} SELECT bin, round(lo, 4) AS lo, n, round(density, 10) AS density FROM h")
def histogram_density_125(spark, d):
    return _hist(spark, d).select("bin", r6("lo", 4).alias("lo"), "n", r6("density", 10).alias("density"))


@query(f"WITH {VALLEYS} SELECT bin FROM v")
def histogram_valleys(spark, d):
    return density.valleys(_hist(spark, d))


@query(f"WITH {VALLEYS}, p AS (SELECT bin, row_number() OVER (ORDER BY bin) - 1 AS pick FROM v) SELECT pick::INT AS pick, round(h.lo, 4) AS edge FROM p JOIN h ON h.bin = p.bin + 1 WHERE pick IN (7, 10, 14, 17)")
def valley_edges_pick(spark, d):
    return density.valley_edges(_hist(spark, d), [7, 10, 14, 17]).select("pick", r6("edge", 4).alias("edge"))


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, stddev_samp(value) * power(count(*)::DOUBLE, -0.2::DOUBLE) AS h, count(*) AS n FROM events),
 g AS (SELECT r.range::INT AS point, lo + r.range * ((hi - lo) / 199::DOUBLE) AS x, h, n FROM range(200) r, s)
 SELECT point, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * ((x - value) / h) * ((x - value) / h))) / (n * h * sqrt(2::DOUBLE * pi())), 8) AS density FROM g, events GROUP BY point, x, h, n""")
def kde_grid(spark, d):
    return density.kde(spark, table(spark, d, "events"), "value").select("point", r6("x").alias("x"), r6("density", 8).alias("density"))


# ---- neighbours
D2 = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
VEC = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
KNN = f"{VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, {D2} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS rank FROM p) WHERE rank <= 10)"


@query(f"WITH {VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label, {D2} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS k FROM p) SELECT query, id, label, round(d2, 6) AS d2 FROM r WHERE k = 1")
def nearest_neighbor_label(spark, d):
    """Every row's nearest other row."""
    e = emb(spark, d)
    near = neighbors.nearest(e, e, 1, other_only=True)
    return near.join(e.select("id", "label"), "id").select("query", "id", "label", r6("d2").alias("d2"))


@query(f"WITH {KNN} SELECT query, rank::INT AS rank, id, round(d2, 6) AS d2 FROM knn")
def knn10(spark, d):
    e = emb(spark, d)
    return neighbors.nearest(e, e, 10, other_only=True).select("query", "rank", "id", r6("d2").alias("d2"))


@query(f"WITH {KNN} SELECT query, rank::INT AS rank, id, round(d2, 6) AS d2 FROM knn")
def knn10_indexed(spark, d):
    """The same through the index of pivots and bounds."""
    e = emb(spark, d)
    return knnindex.nearest(e, e, 10, other_only=True)[0].select("query", "rank", "id", r6("d2").alias("d2"))


@query(f"WITH {KNN}, w AS (SELECT least(query, id) AS a, greatest(query, id) AS b, exp(-d2) AS w FROM knn) SELECT a, b, round(CASE WHEN count(*) > 1 THEN sum(w) - max(w) * min(w) ELSE sum(w) END, 6) AS w FROM w GROUP BY a, b")
def fuzzy_union(spark, d):
    e = emb(spark, d)
    return neighbors.fuzzy_union(neighbors.nearest(e, e, 10, other_only=True)).select("a", "b", r6("w").alias("w"))


@query(f"""WITH RECURSIVE {KNN}, g AS (SELECT query, list(id ORDER BY id) AS ids, list(sqrt(d2) ORDER BY id) AS d FROM knn GROUP BY query),
 r AS (SELECT query, d, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0::DOUBLE) AS rho FROM g),
 b AS (SELECT query, d, rho, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS sigma, 0 AS step FROM r UNION ALL
  SELECT query, d, rho, CASE WHEN high THEN lo ELSE sigma END, CASE WHEN high THEN sigma ELSE hi END, CASE WHEN high THEN (lo + sigma) / 2::DOUBLE WHEN isinf(hi) THEN 2::DOUBLE * sigma ELSE (sigma + hi) / 2::DOUBLE END, step + 1
  FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0::DOUBLE) / sigma))) > log2(greatest(len(d), 2)) AS high FROM b) WHERE step < 64)
 SELECT query, unnest(ids) AS id, round(unnest(list_transform(b.d, lambda x: exp(-greatest(x - rho, 0::DOUBLE) / greatest(sigma, 0.001::DOUBLE * list_sum(b.d) / len(b.d), 1e-12::DOUBLE)))), 6) AS w FROM b JOIN g USING (query) WHERE step = 64""")
def smooth_weights(spark, d):
    """Weights of every row's neighbours, whose widths make them sum to the logarithm of their number."""
    e = emb(spark, d)
    return neighbors.smooth_weights(neighbors.nearest(e, e, 10, other_only=True)).select("query", "id", r6("w").alias("w"))


@query()
def umap_layout(spark, d):
    """Every row's place, and its label."""
    e = emb(spark, d)
    placed = neighbors.umap_layout(neighbors.nearest(e, e, 10, other_only=True))
    return placed.join(e.select("id", "label"), "id")


# ---- self-organizing map
BMU = f"{VEC}, nn AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS neuron, v FROM (SELECT * FROM e ORDER BY vec_id LIMIT 100)), p AS (SELECT a.vec_id, a.v, b.neuron, {D2} AS d2 FROM e a CROSS JOIN nn b), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neuron) AS k FROM p) WHERE k = 1)"


@query(f"WITH {BMU} SELECT vec_id AS id, neuron, round(d2, 6) AS d2 FROM m")
def som_bmu_assign(spark, d):
    e = emb(spark, d)
    return som.bmu(e, som.first_rows(e, 100)).select("id", "neuron", r6("d2").alias("d2"))


@query(f"""WITH {BMU}, s AS (SELECT neuron, dim, sum(x) AS s, count(*) AS c FROM (SELECT neuron, unnest(range(64)) AS dim, unnest(v) AS x FROM m) GROUP BY neuron, dim),
 h AS (SELECT a.range AS neuron, b.range AS other, exp(-((a.range // 10 - b.range // 10) * (a.range // 10 - b.range // 10) + (a.range % 10 - b.range % 10) * (a.range % 10 - b.range % 10))::DOUBLE / 122::DOUBLE) AS h FROM range(100) a, range(100) b)
 SELECT h.neuron::INT AS neuron, dim::INT AS dim, round(sum(h * s) / sum(h * c), 6) AS w FROM h JOIN s ON s.neuron = h.other GROUP BY h.neuron, dim""")
def som_batch_epoch(spark, d):
    e = emb(spark, d)
    return som.neuron_table(spark, som.epoch(e, som.first_rows(e, 100))).select("neuron", "dim", r6("w").alias("w"))


@query(f"WITH {BMU} SELECT l.bucket::INT AS bucket, count(*) AS n, count(DISTINCT m.neuron) AS neurons, round(avg(sqrt(d2)), 6) AS mean_distance FROM m JOIN e USING (vec_id) JOIN {LIMITS.replace(' AS t(', ' AS l(')} ON e.label / 10::DOUBLE >= lo AND e.label / 10::DOUBLE < hi GROUP BY l.bucket")
def som_group_profile(spark, d):
    e = emb(spark, d)
    near = som.bmu(e, som.first_rows(e, 100), "label")
    own = near.withColumn("bucket", buckets.bucket(F.col("label") / F.lit(10.0))).where("bucket is not null")
    return own.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("neuron").alias("neurons"), r6(F.avg(F.sqrt("d2"))).alias("mean_distance"))


@query()
def som_train(spark, d):
    """A map of 10 x 10 over 128 epochs: its error before each."""
    _, errors = som.train(emb(spark, d), epochs=128)
    return spark.createDataFrame([(e, float(x)) for e, x in enumerate(errors)], "epoch int, quantization_error double")


# ---- autoencoder
def _weights(name: str, inputs: int, outputs: int, step: str) -> str:
    return f"{name} AS (SELECT i.range AS dim, j.range AS unit, sin((i.range * {outputs} + j.range + 1)::DOUBLE) * {step}::DOUBLE AS w FROM range({inputs}) i, range({outputs}) j)"


def _net(activation: str = "tanh") -> autoencoder.Network:
    """64 to 8 and back, with weights and biases from a rule."""

    def layer(inputs: int, outputs: int):
        at = np.arange(inputs * outputs, dtype=float).reshape(inputs, outputs)
        return np.sin(at + 1) * 0.3, np.arange(outputs) / 100.0

    return autoencoder.Network(DIM, (8,), activation, [layer(DIM, 8), layer(8, DIM)])


_ENC = f"l AS ({LONG}), {_weights('w1', 64, 8, '0.3')}, {_weights('w2', 8, 64, '0.3')}, enc AS (SELECT id, unit AS dim, {{act}} AS x FROM (SELECT id, unit, sum(x * w) + unit::DOUBLE / 100::DOUBLE AS s FROM l JOIN w1 USING (dim) GROUP BY id, unit)), dec AS (SELECT id, unit AS dim, tanh(s) AS x FROM (SELECT id, unit, sum(x * w) + unit::DOUBLE / 100::DOUBLE AS s FROM enc JOIN w2 USING (dim) GROUP BY id, unit))"
TANH = _ENC.replace("{act}", "tanh(s)")


def _through(spark, d, part: str, activation: str = "tanh"):
    out = autoencoder.apply_network(emb(spark, d), _net(activation), part)
    return stats.long_form(out).select("id", "dim", r6("x").alias("x"))


@query(f"WITH {TANH} SELECT id, dim::INT AS dim, round(x, 6) AS x FROM enc")
def linear_tanh_forward(spark, d):
    return _through(spark, d, "encode")


@query(f"WITH {_ENC.replace('{act}', 'greatest(0::DOUBLE, s)')} SELECT id, dim::INT AS dim, round(x, 6) AS x FROM enc")
def relu_forward(spark, d):
    return _through(spark, d, "encode", "relu")


@query(f"WITH {_ENC.replace('{act}', 'greatest(0::DOUBLE, s)').replace('tanh(s) AS x', 's AS x')} SELECT id, dim::INT AS dim, round(x, 6) AS x FROM dec")
def relu_decoder_forward(spark, d):
    return _through(spark, d, "both", "relu")


@query(f"WITH {TANH} SELECT id, dim::INT AS dim, round(x, 6) AS x FROM dec")
def decoder_forward(spark, d):
    return _through(spark, d, "both")


@query(f"WITH {TANH} SELECT round(avg((l.x - dec.x) * (l.x - dec.x)), 8) AS mse FROM l JOIN dec ON l.id = dec.id AND l.dim = dec.dim")
def mse_loss(spark, d):
    return autoencoder.mse(emb(spark, d), _net()).select(r6("mse", 8).alias("mse"))


@query("SELECT * FROM (VALUES (0, 28, 16, 464), (1, 16, 8, 136), (2, 8, 16, 144), (3, 16, 28, 476)) AS t(layer, inputs, outputs, params)")
def param_count_summary(spark, d):
    return autoencoder.summary(spark, autoencoder.Network(28, (16, 8)))


@query()
def ae_train(spark, d):
    """256 epochs in batches of 32: the losses of both parts after each."""
    split = tables.written(ordering.exact_split(emb(spark, d).select("id", "v"), "id"), tables.shared_folder(spark))
    _, _, rows = localsgd.train(split, autoencoder.Network(DIM, (16, 8)).start(), 256)
    return spark.createDataFrame([(e, float(a), float(b)) for e, a, b in rows], history.SCHEMA)


@query("SELECT range::INT AS epoch, round(0.001::DOUBLE * power(0.5::DOUBLE, floor(range / 10)::DOUBLE), 12) AS lr FROM range(256)")
def steplr_schedule(spark, d):
    return ordering.steplr(spark).select("epoch", r6("lr", 12).alias("lr"))


# ---- order
MD5 = "row_number() OVER (ORDER BY md5(concat(vec_id::VARCHAR, '{salt}')), vec_id)"


@query(f"SELECT vec_id AS id, {MD5.replace('{salt}', '|42')} <= ceil(0.3::DOUBLE * (SELECT count(*) FROM embeddings)) AS is_test FROM embeddings")
def split_exact_70_30(spark, d):
    return ordering.exact_split(emb(spark, d).select("id"), "id")


@query(f"SELECT vec_id AS id, (({MD5.replace('{salt}', '|42|3')} - 1) // 32)::INT AS batch FROM embeddings")
def minibatch_assign(spark, d):
    return ordering.minibatches(emb(spark, d).select("id"), "id", 3)


@query("SELECT round(avg(m), 8) AS loss FROM (SELECT batch, avg(x) AS m FROM (SELECT (row_number() OVER (ORDER BY md5(concat(o_orderkey::VARCHAR, '|42|0')), o_orderkey) - 1) // 32 AS batch, o_totalprice / 1000::DOUBLE AS x FROM orders) GROUP BY batch)")
def epoch_loss_mean_of_means(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / F.lit(1000.0)).alias("x"))
    means = ordering.minibatches(rows, "o_orderkey", 0).groupBy("batch").agg(F.avg("x").alias("m"))
    return means.agg(r6(F.avg("m"), 8).alias("loss"))


@query("WITH v AS (SELECT o_orderdate::DATE AS day, round(avg(o_totalprice), 6) AS loss FROM orders GROUP BY 1), b AS (SELECT *, min(loss) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM v) SELECT day, loss, best_before, best_before IS NULL OR loss < best_before AS improved FROM b")
def running_best(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(r6(F.avg("o_totalprice")).alias("loss"))
    return ordering.running_best(daily, "day", "loss")


@query("SELECT c.r AS row, c_custkey, p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) c LEFT JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) p ON c.r = p.r")
def positional_align_join(spark, d):
    c = ordering.by_position(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return c.join(ordering.by_position(table(spark, d, "part").select("p_partkey"), "p_partkey"), "row", "left")


@query("SELECT r AS row, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) WHERE r IN (7, 10, 14, 17)")
def positional_take(spark, d):
    rows = ordering.by_position(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    return rows.withColumn("row", F.col("row") - 1).where(F.col("row").isin(7, 10, 14, 17)).select("row", "p_partkey", "p_retailprice")


# ---- files
@query("SELECT * FROM part")
def csv_roundtrip(spark, d):
    rows, path = table(spark, d, "part"), tables.shared_folder(spark)
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query(f"SELECT bucket::INT AS bucket, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN {LIMITS} ON {SCORE} >= lo AND {SCORE} < hi GROUP BY bucket")
def group_glob_scan(spark, d):
    rows = table(spark, d, "lineitem").withColumn("bucket", buckets.bucket(F.col("l_discount") * F.lit(10.0))).where("bucket is not null").select("l_orderkey", "l_quantity", "bucket")
    path = tables.shared_folder(spark)
    tables.write_groups(rows, path, "bucket")
    found = tables.read_groups(spark, path, "bucket", rows.drop("bucket").schema)
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query(f"SELECT bucket::INT AS bucket, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN {LIMITS} ON {SCORE} >= lo AND {SCORE} < hi WHERE hi > 0.6 GROUP BY bucket")
def group_scan_pruned(spark, d):
    """Only the groups that a table of ranges asks for are read: their folders are chosen when the plan runs."""
    path = tables.shared_folder(spark)
    rows = table(spark, d, "lineitem").withColumn("bucket", buckets.bucket(F.col("l_discount") * F.lit(10.0))).where("bucket is not null").select("l_orderkey", "l_quantity", "bucket")
    tables.write_groups(rows, path, "bucket")
    asked = tables.written(buckets.limits_table(spark), f"{path}-limits").where("hi > 0.6").select("bucket")
    found = tables.read_groups(spark, path, "bucket", rows.schema).join(F.broadcast(asked), "bucket")
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT p_partkey AS key, p_name AS A, p_size AS size FROM part")
def csv_first_named(spark, d):
    """A table whose header has one name twice, for the name and the brand: the first stays."""
    path = tables.shared_folder(spark)
    lines = table(spark, d, "part").select(F.to_csv(F.struct("p_partkey", "p_name", "p_size", "p_brand")).alias("value"))

    def headed(batches):
        yield pd.DataFrame({"value": ["key,A,size,A"]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(path)  # each file has the header
    return tables.read_csv_first_named(spark, path, {"key": "long", "size": "int"})


@query("SELECT range::INT AS epoch, 1::DOUBLE / (range + 1)::DOUBLE AS train_loss, 2::DOUBLE / (range + 1)::DOUBLE AS val_loss FROM range(4)")
def append_history(spark, d):
    path = tables.shared_folder(spark)
    for e in range(4):
        history.append_history(spark, path, [(e, 1 / (e + 1), 2 / (e + 1))])
    return history.read_history(spark, path)


# ---- molecules
def molecules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, (i * 0.07 + 0.05) % 1) for i, s in enumerate(hand.SMILES)], "mol_id long, smiles string, qed double")


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x).lower()
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({columns})"


@query(f"SELECT mol_id::BIGINT AS mol_id, atoms, bonds, readable FROM {_values([(m, len([r for r in hand.atom_rows() if r[0] == m]), sum(r[1] for r in hand.bond_rows() if r[0] == m), m in hand.ATOMS) for m in range(len(hand.SMILES))], 'mol_id, atoms, bonds, readable')}")
def smiles_counts(spark, d):
    return parse_smiles(molecules(spark)).select("mol_id", F.size("atoms").alias("atoms"), F.size("bonds").alias("bonds"), F.col("error").isNull().alias("readable"))


@query(f"SELECT mol_id::BIGINT AS mol_id, * EXCLUDE (mol_id) FROM {_values(hand.atom_rows(), 'mol_id, idx, symbol, hybridization, charge, degree, hydrogens, chirality')}")
def smiles_atoms(spark, d):
    return parse_smiles(molecules(spark)).select("mol_id", F.inline("atoms")).select("mol_id", "idx", "symbol", "hybridization", "charge", "degree", "hydrogens", "chirality")


@query(f"SELECT mol_id::BIGINT AS mol_id, kind, conjugated, in_ring, stereo, n::BIGINT AS n FROM {_values(hand.bond_rows(), 'mol_id, n, kind, conjugated, in_ring, stereo')}")
def smiles_bonds(spark, d):
    rows = parse_smiles(molecules(spark)).select("mol_id", F.inline("bonds"))
    return rows.groupBy("mol_id", "kind", "conjugated", "in_ring", "stereo").agg(F.count("*").alias("n"))


_GOLD = hand.features()
_GOLD_SQL = "SELECT m::BIGINT AS mol_id, " + ", ".join(f"coalesce({f}, 0::DOUBLE) AS {f}" for f in FEATURES) + " FROM " + _values([(m, *(float(g.get(f, 0)) for f in FEATURES)) for m, g in _GOLD.items()], ", ".join(["m", *FEATURES]))
_KEPT = [f for f in FEATURES if len({g.get(f, 0) for m, g in _GOLD.items() if m in hand.ATOMS}) > 1]


@query(f"SELECT mol_id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM ({_GOLD_SQL})")
def smiles_features(spark, d):
    got = entities.featurize(parse_smiles(molecules(spark)))
    return got.select("mol_id", *(r6(f).alias(f) for f in FEATURES))


@query(f"SELECT symbol, round((vdw - 1.5::DOUBLE) / 0.6::DOUBLE, 6) AS vdw_scaled, round((covalent - 0.64::DOUBLE) / 0.76::DOUBLE, 6) AS covalent_scaled FROM (SELECT DISTINCT symbol FROM {_values(hand.atom_rows(), 'mol_id, idx, symbol, hybridization, charge, degree, hydrogens, chirality')}) LEFT JOIN (SELECT * FROM {_values([(s, float(a), float(b)) for s, (a, b) in RADII.items()], 'name, vdw, covalent')}) ON symbol = name")
def smiles_radii(spark, d):
    rows = parse_smiles(molecules(spark)).select(F.inline("atoms")).select("symbol").distinct()
    vdw, covalent = entities.radii(F.col("symbol"))
    return rows.select("symbol", r6(vdw).alias("vdw_scaled"), r6(covalent).alias("covalent_scaled"))


_CLEAN = ", ".join(f"round((t.{f} - avg(t.{f}) OVER ()) / stddev_pop(t.{f}) OVER (), 6) AS {f}" for f in _KEPT)


@query(f"SELECT mol_id AS id, (mol_id * 0.07::DOUBLE + 0.05::DOUBLE) % 1::DOUBLE AS label, {_CLEAN} FROM ({_GOLD_SQL}) t WHERE mol_id IN ({', '.join(map(str, hand.ATOMS))})")
def clean_pipeline(spark, d):
    rows, _, kept = pipelines.clean(molecules(spark))
    return rows.select("id", "label", *(r6(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(kept)))


# ---- plans from files to files
CODES = {"F": 0, "O": 1}
PRICED = ["o_totalprice", "o_custkey"]


@query("SELECT o_orderkey AS id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in PRICED) + ", CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INT AS label FROM orders")
def load_and_preprocess(spark, d):
    """A CSV file of features and a label to scaled features and a code."""
    path = tables.shared_folder(spark)
    tables.write_csv(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *(F.col(c).cast("double") for c in PRICED), F.col("o_orderstatus").alias("label")), path)
    rows, _ = pipelines.load_and_preprocess(spark, path, PRICED, CODES, key="id")
    return rows.select("id", *(r6(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(PRICED)), "label")


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """Several partitions that follow one another by the key, as files of a table without a key do."""
    return rows.repartitionByRange(4, key).sortWithinPartitions(key)


@query("""SELECT o.r - 1 AS row, o_totalprice, c_acctbal FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) o LEFT JOIN (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) c ON o.r = c.r""")
def csv_position_align(spark, d):
    """Two CSV tables without a key meet by the rows' places in their files."""
    path = tables.shared_folder(spark)
    tables.write_csv(in_order(table(spark, d, "orders"), "o_orderkey").select("o_totalprice"), f"{path}/orders")
    tables.write_csv(in_order(table(spark, d, "customer"), "c_custkey").select("c_acctbal"), f"{path}/customers")
    right = tables.read_csv_in_order(spark, f"{path}/customers", "c_acctbal double")
    return tables.read_csv_in_order(spark, f"{path}/orders", "o_totalprice double").join(right, "row", "left")


NAMES = [f"f{i}" for i in range(DIM)]


def _files(spark, d) -> str:
    """The embeddings as the two CSV tables that the plans start from, both without ids: features and label, and scores."""
    path, rows = tables.shared_folder(spark), emb(spark, d)
    tables.write_csv(in_order(rows, "id").select(*(F.get("v", F.lit(i)).alias(c) for i, c in enumerate(NAMES)), F.col("label").cast("string").alias("label")), f"{path}/features")
    tables.write_csv(in_order(rows, "id").select((F.col("label") / F.lit(10.0)).alias("qed")), f"{path}/scores")
    return path


#: Rows of the embeddings by their place in the files.
PLACED = "(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, label, embedding FROM embeddings)"


@query(f"SELECT id, row_number() OVER (ORDER BY md5(concat(id::VARCHAR, '|42')), id) <= ceil(0.3::DOUBLE * (SELECT count(*) FROM embeddings)) AS is_test, true AS saved FROM {PLACED}")
def train_from_files(spark, d):
    """Load, split, train with a checkpoint on improvement, encode both parts: a row for each row of the file, with its part and
    whether the saved network gives the same code."""
    path = _files(spark, d)
    rows, _ = pipelines.load_and_preprocess(spark, f"{path}/features", NAMES, {str(k): k for k in range(10)})
    _, past, codes = pipelines.run_train(rows, Config(hidden_sizes=(16, 8), epochs=3, learning_rate=1e-2), f"{path}/out")
    saved = autoencoder.Network(DIM, (16, 8)).load(spark, f"{path}/out/model")
    again = autoencoder.apply_network(rows, saved, "encode").withColumnsRenamed({"id": "own", "v": "w"})
    same = F.aggregate(F.zip_with("v", "w", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) < 1e-9
    kept = history.read_history(spark, f"{path}/out/training_losses").where("epoch between 1 and 3").count() == len(past)
    return codes.join(again, F.col("id") == F.col("own")).select("id", "is_test", (same & F.lit(kept)).alias("saved"))


@query(f"SELECT bucket::INT AS bucket, id, dim, round(x, 6) AS x, true AS labelled FROM (SELECT id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM {PLACED}) JOIN {LIMITS} ON label / 10::DOUBLE >= lo AND label / 10::DOUBLE < hi")
def cluster_from_files(spark, d):
    """Two CSV tables and a saved network to the outputs of each range, 10 x 10 over 128 epochs: the labelled rows, read back by
    the features' names; labelled: whether the label is the neuron nearest to the row's code of the same place."""
    path = _files(spark, d)
    net = autoencoder.Network(DIM, (16, 8)).start()
    net.save(spark, f"{path}/model")
    pipelines.train_som(spark, f"{path}/scores", f"{path}/features", f"{path}/model", NAMES, Config(hidden_sizes=(16, 8)), f"{path}/out")
    out = None
    for k, _, _ in buckets.limits():
        rows = tables.read_csv(spark, f"{path}/out/group_{k}/labeled_data", ", ".join(["id long", *(f"{c} double" for c in NAMES), "qed double", "label int"]))
        rows = rows.select("id", F.array(*NAMES).alias("v"), F.array(*NAMES).alias("x"), "label")
        center = spark.read.parquet(f"{path}/out/group_{k}/cluster_center").orderBy("neuron", "dim").collect()
        near = som.bmu(autoencoder.apply_network(rows, net, "encode", "x", "label"), np.array([r.w for r in center]).reshape(100, -1), "x", "label")
        near = near.select(F.lit(k).alias("bucket"), "id", F.posexplode("x").alias("dim", "x"), (F.col("neuron") == F.col("label")).alias("labelled"))
        out = near if out is None else out.unionByName(near)
    return out.select("bucket", "id", "dim", r6("x").alias("x"), "labelled")


@query("SELECT row_number() OVER (ORDER BY bucket, n) - 1 AS index, bucket, n FROM (SELECT bucket::INT AS bucket, count(*) AS n FROM lineitem JOIN " + LIMITS + f" ON {SCORE} >= lo AND {SCORE} < hi GROUP BY bucket)")
def index_sheet(spark, d):
    """A small result as a CSV file with row numbers, read back."""
    path = tables.shared_folder(spark)
    tables.write_csv(range_bucket_profile(spark, d).select("bucket", "n"), path, index=True)
    return tables.read_csv(spark, path, "index long, bucket int, n long")


@query("SELECT concat_ws(chr(9), layer, inputs, outputs, params) AS line FROM (VALUES (0, 28, 16, 464), (1, 16, 8, 136), (2, 8, 16, 144), (3, 16, 28, 476)) AS t(layer, inputs, outputs, params)")
def summary_report(spark, d):
    """The network's layers as a text file, read back."""
    path = tables.shared_folder(spark)
    tables.write_report(param_count_summary(spark, d), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"SELECT id, dim, x::FLOAT AS x FROM ({LONG})")
def float_cast(spark, d):
    return stats.long_form(emb(spark, d)).select("id", "dim", F.col("x").cast("float").alias("x"))


#: Centers stated by a rule, in scaled units: the mean of the rows of a range whose ids leave the same remainder of 4, times 1.5.
CENTERS = f"""s AS ({SCALE}), r AS (SELECT bucket::INT AS bucket, id, dim, x, label / 10::DOUBLE AS score FROM ({LONG}) JOIN {LIMITS} ON label / 10::DOUBLE >= lo AND label / 10::DOUBLE < hi),
 c AS (SELECT bucket, (id % 4)::INT AS neuron, dim, avg((x - mu) / sd) * 1.5::DOUBLE * sd + mu AS x FROM r JOIN s USING (dim) GROUP BY bucket, id % 4, dim, sd, mu)"""
NEAREST = f"""{CENTERS}, v AS (SELECT bucket, neuron, list(x ORDER BY dim) AS v FROM c GROUP BY bucket, neuron), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 n AS (SELECT bucket, neuron, label / 10::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY bucket, neuron ORDER BY d2, vec_id) AS k FROM (SELECT b.bucket, b.neuron, a.vec_id, a.label, {D2} AS d2 FROM e a CROSS JOIN v b)) WHERE k = 1)"""


def _explained(spark, d) -> tuple[DataFrame, DataFrame]:
    """The stated centers as the files of groups, read by the features' names and explained in raw units."""
    rows = emb(spark, d).withColumn("score", F.col("label") / F.lit(10.0))
    z, scale = pipelines.scaled(rows, DIM)
    own = z.withColumn("bucket", buckets.bucket(F.col("score"))).where("bucket is not null").withColumn("neuron", (F.col("id") % 4).cast("int"))
    means = own.groupBy("bucket", "neuron").agg(*((F.avg(F.get("v", F.lit(i))) * F.lit(1.5)).alias(c) for i, c in enumerate(NAMES)))
    means, path = tables.written(means, tables.shared_folder(spark)), tables.shared_folder(spark)
    for k, _, _ in buckets.limits():
        tables.write_csv(means.where(F.col("bucket") == k).coalesce(1).sortWithinPartitions("neuron").select(*NAMES), f"{path}/group_{k}/decoded_data")
    return pipelines.explain(pipelines.decoded_centers(spark, path, NAMES), scale, rows, "score")


@query(f"WITH {NEAREST} SELECT bucket, neuron, score FROM n")
def center_scores(spark, d):
    """Each center, from the groups' files, with the score of the row nearest to it in raw units."""
    return _explained(spark, d)[1].select("bucket", "neuron", "score")


@query(f"WITH {NEAREST} SELECT dim, round(corr(x, score), 6) AS corr FROM c JOIN n USING (bucket, neuron) GROUP BY dim")
def center_correlation(spark, d):
    """Correlation of each feature with the score over the centers of all groups together."""
    return pipelines.center_correlation(_explained(spark, d)[1], DIM).select("dim", r6("corr").alias("corr"))


@query(f"""WITH {CENTERS}, m AS (SELECT bucket, dim, round_even(avg(x) * 100::DOUBLE, 0) / 100::DOUBLE AS mean, stddev_samp(x) AS std FROM c GROUP BY bucket, dim),
 k AS (SELECT bucket, 'f' || dim AS feature, mean FROM m WHERE dim IN (SELECT dim FROM m GROUP BY dim HAVING min(mean) > -0.05::DOUBLE)) SELECT row_number() OVER (ORDER BY bucket, feature) - 1 AS index, bucket, feature, mean FROM k""")
def center_means_sheet(spark, d):
    """Means of the groups' centers in raw units, rounded, without features that are small in any group, as a sheet read back."""
    means, path = _explained(spark, d)[0], tables.shared_folder(spark)
    named = means.select("bucket", F.concat(F.lit("f"), F.col("dim").cast("string")).alias("feature"), "mean")
    tables.write_csv(stats.surviving_means(named, "bucket", "feature", -0.05), path, index=True)
    return tables.read_csv(spark, path, "index long, bucket int, feature string, mean double")


@query(f"""WITH {VALLEYS}, p AS (SELECT h.lo AS edge, row_number() OVER (ORDER BY v.bin) - 1 AS pick FROM v JOIN h ON h.bin = v.bin + 1),
 q AS (SELECT edge, row_number() OVER (ORDER BY edge) AS k FROM p WHERE pick IN (7, 10, 14, 17)), w AS (SELECT k AS bucket, edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi FROM q UNION ALL SELECT 0, 0, min(edge) FROM q)
 SELECT bucket::INT AS bucket, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem JOIN w ON l_extendedprice >= w.lo AND (l_extendedprice < w.hi OR w.hi IS NULL) GROUP BY bucket""")
def valley_range_profile(spark, d):
    """Ranges whose edges are the density's valleys, joined to the rows as a table of limits."""
    lines = table(spark, d, "lineitem")
    edges = [r.edge for r in density.valley_edges(_hist(spark, d), [7, 10, 14, 17]).orderBy("edge").collect()]
    limits = buckets.limits_table(spark, edges, 0.0, None)
    own = buckets.by_limits(lines.select(F.col("l_extendedprice").alias("x"), "l_quantity"), "x", limits)
    return own.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("mean"), r6(F.stddev_samp("l_quantity")).alias("std"))


@query()
def cluster_pipeline(spark, d):
    """Train on the scaled rows for 256 epochs, cluster their codes by range on maps of 10 x 10 over 128 epochs, decode, and look
    up each center's nearest row in raw units."""
    rows = emb(spark, d).select("id", "v", (F.col("label") / F.lit(10.0)).alias("score"))
    z, scale = pipelines.scaled(rows, DIM)
    net, _, _ = pipelines.run_train(z.select("id", "v"), Config(hidden_sizes=(16, 8)))
    _, centers = pipelines.cluster_ranges(spark, z, "score", net, epochs=128, start="kde", rate=0.5)
    _, scored = pipelines.explain(centers, scale, rows, "score")
    return scored.select("bucket", "neuron", "score")
