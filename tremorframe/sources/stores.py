"""What a run keeps: cleaned tables, fitted models, the table of runs and a report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at ``path``; ``make`` is called and its result written if there is none, or if ``again``."""
    if again or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model, path: str, **facts) -> None:
    """A fitted Spark ML model, with facts (such as classes, features, scaling) beside it as JSON."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    row = json.dumps({"class": f"{type(model).__module__}.{type(model).__name__}", **facts}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_model(spark: SparkSession, path: str):
    """(model, facts) as ``save_model`` left them."""
    import importlib

    facts = json.loads(spark.read.text(f"{path}/facts").head().value)
    module, name = facts.pop("class").rsplit(".", 1)
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"{module} is not a module of Spark ML")
    return getattr(importlib.import_module(module), name).load(f"{path}/model"), facts


def append_runs(runs: DataFrame, path: str, experiment: str) -> None:
    """Adds rows of ``learning.cross_validate`` to the store of experiments, a folder each."""
    runs.withColumn("experiment", F.lit(experiment)).write.mode("append").partitionBy("experiment").parquet(path)


def best_of(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """The run of the highest mean F1 of each model: one row a model."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("experiment") == experiment) if experiment else rows
    key = F.struct("mean_f1", "strategy", "params")
    return rows.groupBy("model").agg(F.max_by(F.struct("experiment", "strategy", "params", "mean_f1", "std_f1"), key).alias("r")).select("model", "r.*")


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A run's report (times, scores, parameters) as one JSON text."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).head().value)
