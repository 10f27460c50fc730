"""Indices on a stream of footprints: stateless measures run unchanged, incremental tables use watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shape


def buildings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New parquet files of footprints as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def measured(stream: DataFrame) -> DataFrame:
    """Area, perimeter and slenderness of each footprint; works on streams and tables alike."""
    rows = shape.prepared(stream)
    return rows.select("id", F.col("m")["area"].alias("area"), F.col("m")["perimeter"].alias("perimeter"), F.sqrt(F.col("p")["i1"] / F.col("p")["i2"]).alias("slenderness"))


def exposure(stream: DataFrame, time: str, key: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than ``late`` are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), key, "n", "total")
