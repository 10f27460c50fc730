"""A corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremorframe.llm import store
from tremorframe.llm.decontaminate import without_leaks
from tremorframe.llm.mix import mixed_texts
from tremorframe.llm.near_dup import one_of_each
from tremorframe.llm.token_store import token_ids as write_and_read
from tremorframe.llm.toxicity import score, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored below 0.5 stay."""
    column = "toxicity_score"
    return score(docs, train(docs, _table(spark, sf_dir, "labels")), column).where(f"{column} < 0.5").drop(column)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item stay."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text holds the stretches that the mix takes of it, as often as it does."""
    return mixed_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's rows, read back from its files."""
    return write_and_read(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The trained toxicity machine and the sketches cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    with store.small_batches(spark):
        for name, stage in STAGES:
            docs = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
