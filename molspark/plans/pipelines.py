"""Whole plans: clean, load, train, cluster by range, explain; with the files that they read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lookup
from ..operators import autoencoder, buckets, entities, localsgd, neighbors, ordering, som, stats
from ..schema import EDGES, FEATURES
from ..sources import tables
from ..sources.smiles import parse_smiles
from ..sources.tables import LOG, Config
from ..streaming import history


def scaled(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows with v standardized in place, and the scaler's (dim, mu, sd)."""
    scale = stats.scaler_stats(rows, n)
    found = scale.orderBy("dim").collect()  # a row a feature
    mu, sd = (F.array(*(F.lit(r[c]) for r in found)) for c in ("mu", "sd"))
    z = F.zip_with(F.zip_with("v", mu, lambda x, m: x - m), sd, lambda x, s: x / s)
    return rows.withColumn("v", z), scale


def clean(molecules: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(id, v, label) standardized, the scaler's (dim, mu, sd), and the features kept: those that vary.

    molecules: (mol_id, smiles, qed); the score travels with its row, so no join by position or id is needed.
    """
    parsed = parse_smiles(molecules, keep=("qed",))
    raw = entities.featurize(parsed, keep=("qed",)).where("error is null")
    spread = raw.agg(*(F.stddev_pop(c).alias(c) for c in FEATURES)).first()
    kept = [c for c in FEATURES if (spread[c] or 0) > 0]
    rows = raw.select(F.col("mol_id").alias("id"), F.array(*kept).alias("v"), F.col("qed").alias("label"))
    return *scaled(rows, len(kept)), kept


def load_and_preprocess(spark: SparkSession, path: str, features: list[str], encoder: dict[str, int] | None = None, label: str = "label", key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, v, label) of a CSV file and the scaler's (dim, mu, sd): the label by ``encoder`` (null for one that it lacks; as a
    number without an encoder), the features standardized. id is the file's column ``key``, or without one the row's place, from 0."""
    kind = "string" if encoder else "double"
    own = ", ".join([*(f"`{f}` double" for f in features), f"`{label}` {kind}"])
    rows = tables.read_csv(spark, path, f"`{key}` long, {own}").withColumnRenamed(key, "id") if key else tables.read_csv_in_order(spark, path, own, "id")
    code = lookup(F.col(label), encoder) if encoder else F.col(label)
    out = scaled(rows.select("id", F.array(*(f"`{f}`" for f in features)).alias("v"), code.alias("label")), len(features))
    LOG.info("data loaded and scaled from %s", path)
    return out


def run_train(rows: DataFrame, config: Config, folder: str | None = None) -> tuple[autoencoder.Network, list[tuple[int, float, float]], DataFrame]:
    """The best network on the held-out share of (id, v), its history, and (id, v, is_test): all rows' codes.

    With a folder it keeps there: ``summary`` (the layers), ``training_losses`` (a row an epoch, as epochs end),
    ``model`` (overwritten whenever the validation loss improves), ``encoded``, and ``state``, from which another call
    goes on after the last whole epoch.
    """
    spark, at = rows.sparkSession, tables.shared_folder(rows.sparkSession)
    split = tables.written(ordering.exact_split(rows.select("id", "v"), "id", config.test_share, config.seed), at)
    net = autoencoder.Network(stats.width(rows), config.hidden_sizes).start(config.seed)
    if folder:
        tables.write_report(autoencoder.summary(spark, net), f"{folder}/summary")

    def keep(epoch: int, loss: float, val: float, now: autoencoder.Network, better: bool) -> None:
        LOG.info("epoch %d of %d: %.4f, validation %.4f", epoch + 1, config.epochs, loss, val)
        if folder:
            history.append_history(spark, f"{folder}/training_losses", [(epoch + 1, float(loss), float(val))])
            if better:
                now.save(spark, f"{folder}/model")

    common = (config.epochs, config.learning_rate, config.weight_decay, config.step_size, config.gamma)
    if config.steps:
        _, best, past = autoencoder.train(split.where("not is_test"), split.where("is_test"), net, *common, config.steps, keep)
    else:
        _, best, past = localsgd.train(split, net, *common, config.batch_size, on_epoch=keep, folder=f"{folder}/state" if folder else None)
    codes = autoencoder.apply_network(split, best, "encode", "is_test")
    if folder:
        codes = tables.written(codes, f"{folder}/encoded")
        tables.remove(spark, at)
    return best, past, codes


def cluster_ranges(
    spark: SparkSession, rows: DataFrame, score: str, net: autoencoder.Network, m: int = 10, n: int = 10, epochs: int = 10, warm_start: bool = False, edges=EDGES, folder: str | None = None,
    start: str = "first", rate: float = 1.0, features: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """For each range of the score: encode, fit a map, label. Returns (bucket, id, score, neuron) and the decoded
    centers (bucket, neuron, v). Rows outside of the ranges are left out, ranges without rows too.

    The rows are encoded and written once; the maps of all ranges are trained together, a pass an epoch. warm_start: one
    map is fitted to one range after the other instead, each from where the one before left it.

    With a folder it writes, by range (``group_k``), as CSV: ``labeled_data`` (id, the features by name, the score, label),
    ``decoded_data`` (the centers by the features' names, in their order), ``matrix_data`` (features by number) and
    ``tokenized_data`` (codes as floats by number); and ``cluster_center``. Without names features go by number.
    """
    at = tables.shared_folder(spark)
    own = rows.select("id", "v", F.col("v").alias("_x"), score).withColumn("bucket", buckets.bucket(F.col(score), edges)).where("bucket is not null")
    codes = tables.written(autoencoder.apply_network(own, net, "encode", "_x", score, "bucket"), f"{at}/codes")
    maps = som.starting_groups(codes, "bucket", m * n, start)
    if warm_start:
        last = None
        for k in sorted(maps):
            last, _ = som.train(codes.where(F.col("bucket") == k), m, n, epochs, start=maps[k] if last is None else last, rate=rate)
            maps[k] = last
    else:
        maps, _ = som.train_groups(codes, "bucket", maps, m, n, epochs, rate=rate)
    decoded = {k: net.decode(w) for k, w in sorted(maps.items())}
    centers = [(k, i, [float(x) for x in v]) for k, d in decoded.items() for i, v in enumerate(d)]
    if not maps:
        return spark.createDataFrame([], f"bucket int, id long, `{score}` double, neuron int"), spark.createDataFrame([], "bucket int, neuron int, v array<double>")
    found = som.bmu(codes.withColumn("_code", F.col("v")), maps, score, "_x", "_code", group="bucket").drop("d2")
    found.write.partitionBy("bucket").parquet(f"{at}/labels")
    found = spark.read.schema(found.schema).parquet(f"{at}/labels")
    for k, w in maps.items() if folder else ():
        LOG.info("range %d", k)
        part, to = found.where(F.col("bucket") == k), f"{folder}/group_{k}"
        names = features or [str(i) for i in range(net.width)]
        wide = lambda c, names, kind="double": [F.get(c, F.lit(i)).cast(kind).alias(x) for i, x in enumerate(names)]
        tables.write_csv(part.select("id", *wide("_x", names), score, F.col("neuron").alias("label")), f"{to}/labeled_data")
        tables.write_csv(spark.createDataFrame(decoded[k].tolist(), ", ".join(f"`{c}` double" for c in names)).coalesce(1), f"{to}/decoded_data")
        tables.write_csv(part.select(*wide("_x", [str(i) for i in range(net.width)])), f"{to}/matrix_data")
        tables.write_csv(part.select(*wide("_code", [str(i) for i in range(w.shape[1])], "float")), f"{to}/tokenized_data")
        som.neuron_table(spark, w).coalesce(1).write.mode("overwrite").parquet(f"{to}/cluster_center")
    return found.select("bucket", "id", score, "neuron"), spark.createDataFrame(centers, "bucket int, neuron int, v array<double>")


def train_som(spark: SparkSession, scores_path: str, clean_path: str, model_path: str, features: list[str], config: Config, folder: str, m: int = 10, n: int = 10, start: str = "kde", rate: float = 0.5, edges=EDGES, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """From files to files: the clean features with the scores (qed) of another CSV file, a saved network, and cluster_ranges()
    over them. Rows of both files meet by their column ``key``, or without one by their place; one without a score is in no range."""
    net = autoencoder.Network(len(features), config.hidden_sizes).load(spark, model_path)
    LOG.info("network loaded from %s", model_path)

    def read(path: str, columns: str) -> DataFrame:
        return tables.read_csv(spark, path, f"`{key}` long, {columns}").withColumnRenamed(key, "id") if key else tables.read_csv_in_order(spark, path, columns, "id")

    rows, scores = read(clean_path, ", ".join(f"`{f}` double" for f in features)), read(scores_path, "qed double")
    rows = rows.select("id", F.array(*(f"`{f}`" for f in features)).alias("v")).join(scores, "id", "left")
    return cluster_ranges(spark, rows, "qed", net, m, n, config.som_epochs, False, edges, folder, start, rate, features)


def decoded_centers(spark: SparkSession, folder: str, features: list[str]) -> DataFrame:
    """(bucket, neuron, v) of the ``decoded_data`` of all groups in a folder, by the features' names; a center's number is its place."""
    paths = [f"{folder}/{c}/decoded_data" for c in tables.children(spark, folder) if c.startswith("group_") and c[6:].isdigit()]
    if not paths:
        return spark.createDataFrame([], "bucket int, neuron int, v array<double>")
    rows = tables.read_csv_in_order(spark, paths, ", ".join(f"`{f}` double" for f in features), "neuron", ("bucket", r"group_(\d+)/decoded_data/[^/]+$"))
    return rows.select("bucket", F.col("neuron").cast("int").alias("neuron"), F.array(*(f"`{f}`" for f in features)).alias("v"))


def explain(centers: DataFrame, scale: DataFrame, rows: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """What centers (bucket, neuron, v), in the scaled units of training, mean in raw ones: (bucket, dim, mean, std) by range, and
    each center's unscaled v with the score of the row nearest to it. ``rows``: (id, v, score), v as it was before scaling."""
    spark = rows.sparkSession
    back = tables.written(stats.unscaled(centers, scale), tables.shared_folder(spark))  # a row a center, read several times
    n = stats.width(back)
    most = (back.agg(F.max("neuron")).first()[0] or 0) + 1
    code = F.col("bucket").cast("long") * F.lit(most) + F.col("neuron")
    near = neighbors.nearest(rows.select("id", "v"), back.select(code.alias("id"), "v"))
    scored = near.join(rows.select("id", F.col(score).alias("score")), "id")
    scored = scored.select(F.floor(F.col("query") / F.lit(most)).cast("int").alias("bucket"), (F.col("query") % F.lit(most)).cast("int").alias("neuron"), "score")
    return stats.group_mean_std(back, n, "bucket"), back.join(scored, ["bucket", "neuron"])


def center_correlation(centers: DataFrame, n: int, score: str = "score") -> DataFrame:
    """(dim, corr): of each feature with the score, over the centers of all ranges together."""
    return stats.correlation_with(centers, n, score)
