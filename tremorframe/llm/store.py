"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: No table that a query reads has a column of this name.
FOLDER = "tremorframe_folder"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only on a local master that sets none."""
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tremorframe-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Row groups of about 4 MB, looked at after each row: for tables of few large rows, which else are written and read a file at a time.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder; later reads don't compute it again. ``options`` of the writer. A column FOLDER is kept as folders, which can be dropped one by one."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).option("compression", codec).partitionBy(*(c for c in df.columns if c == FOLDER)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def no_shuffle_stays(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run meanwhile go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of whole texts that pass between the JVM and a Python worker at a time.
TEXT_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that are run meanwhile hand Python TEXT_ROWS rows at a time: the JVM holds a batch outside its heap, the worker once more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(df: DataFrame, part: str = "") -> None:
    """Removes the folders that ``written`` made for ``df`` once nothing reads it any more; ``part``: only those of this name in them."""
    spark = df.sparkSession
    jvm, base = spark.sparkContext._jvm, shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.endswith(part):
            continue
        if folder.split("://")[-1].lstrip("/").startswith(base.split("://")[-1].lstrip("/")) or folder.startswith(base):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
