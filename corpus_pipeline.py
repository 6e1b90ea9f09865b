"""A corpus pipeline of five operators: each stage's rows are written and are the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from molspark.llm import mixing, packing, secrets, simhash, toxicity
from molspark.llm.common import Scratch, load


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the classifier, fitted on the labelled documents among ``docs``, calls toxic. Null and empty texts are
    scored as empty ones, very long ones whole, repeated rows and rows without an id each for itself; an empty table stays empty."""
    return toxicity.clean_documents(docs, toxicity.model(spark, docs, load(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id stays: of all null, empty and wordless texts, one. A row
    without an id stays only where its group has none with one; an empty table stays empty."""
    return simhash.one_of_each_group(spark, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, its secrets replaced; null texts stay null; an empty table stays empty."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the curriculum takes them, in its order, some of them twice; those without words are never taken."""
    return mixing.mixed_documents(spark, docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in the windows; a null or empty text is an end id alone."""
    return packing.pack(spark, docs)


STAGES = [("toxicity", reject_toxic), ("simhash", one_of_each_group), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_windows)]
#: The classifier, the automaton and the packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
