"""Data preparation for segmentation training: annotations, masks, and sampling of images and frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_annotations(annotations: DataFrame, min_iou: float | None = None, max_area_share: float | None = None) -> DataFrame:
    """Positive area; certainty at least ``min_iou`` where known; area under the share of the image (if at most 1)."""
    rows = annotations.where("area > 0")
    if min_iou is not None:
        rows = rows.where(F.col("uncertain_iou").isNull() | (F.col("uncertain_iou") >= min_iou))
    if max_area_share is not None and max_area_share <= 1:
        rows = rows.where(F.col("area") / (F.col("width") * F.col("height")) < max_area_share)
    return rows


def rle_area(counts: Column) -> Column:
    """Foreground pixels of uncompressed run lengths (runs alternate, background first)."""
    return F.aggregate(F.transform(counts, lambda c, i: F.when(i % 2 == 1, c).otherwise(0)), F.lit(0).cast("long"), lambda a, c: a + c)


def rle_pixels(counts: Column) -> Column:
    """Positions (column-major) of the foreground pixels."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("on"), F.lit(False).alias("fg"))

    def step(s: Column, c: Column) -> Column:
        here = F.when(s["fg"] & (c > 0), F.concat(s["on"], F.sequence(s["at"], s["at"] + c - 1))).otherwise(s["on"])
        return F.struct((s["at"] + c).alias("at"), here.alias("on"), (~s["fg"]).alias("fg"))

    return F.aggregate(counts, zero, step)["on"]


def rle_of(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key, counts): run lengths of foreground positions (``pixel``), without the last background run."""
    w = Window.partitionBy(*key).orderBy("pixel")
    gap = F.col("pixel") - F.coalesce(F.lag("pixel").over(w), F.lit(-1)) - 1
    rows = pixels.withColumn("gap", gap).withColumn("run", F.sum(F.when((F.col("gap") > 0) | (F.lag("pixel").over(w).isNull()), 1).otherwise(0)).over(w))
    runs = rows.groupBy(*key, "run").agg(F.max("gap").alias("gap"), F.count("*").alias("n"))
    return runs.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "gap", "n"))), lambda r: F.array(r["gap"], r["n"]))).alias("counts"))


def boxes(pixels: DataFrame, key: list[str], height: int) -> DataFrame:
    """Bounding boxes (x0, y0, x1, y1) of column-major masks."""
    x, y = F.floor(F.col("pixel") / height), F.col("pixel") % height
    return pixels.groupBy(*key).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def repeat_factors(annotations: DataFrame, threshold: float) -> DataFrame:
    """(image_id, repeat_factor): max over an image's categories of max(1, sqrt(threshold / share of images with it))."""
    images = annotations.select("image_id", "category_id").distinct()
    total = images.select(F.count_distinct("image_id").alias("total"))
    share = images.groupBy("category_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row of totals
    factor = share.select("category_id", F.greatest(F.lit(1.0), F.sqrt(threshold * F.col("total") / F.col("n"))).alias("f"))
    return images.join(factor, "category_id").groupBy("image_id").agg(F.max("f").alias("repeat_factor"))


def repeated(images: DataFrame, key: str = "image_id", seed: int = 0) -> DataFrame:
    """Images as often as their repeat factor, its fraction drawn by hash."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    n = F.floor("repeat_factor") + (u < F.col("repeat_factor") - F.floor("repeat_factor")).cast("int")
    return images.withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))


def every_nth(frames: DataFrame, n: int, key: str = "video_id", order: str = "frame") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return frames.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") % n == 0).drop("_k")


def clip_of(frames: DataFrame, length: int, key: str = "video_id", order: str = "frame", seed: int = 0, reverse: float = 0.0) -> DataFrame:
    """``length`` consecutive frames of each video from a start drawn by hash (videos shorter are left out), reversed with a probability."""
    u = lambda s: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(s)), F.lit(1 << 40)) / float(1 << 40)
    w = Window.partitionBy(key)
    rows = frames.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)}).where(F.col("_n") >= length)
    start = F.floor(u("start") * (F.col("_n") - length + 1))
    rows = rows.withColumn("position", (F.col("_k") - start).cast("int")).where(F.col("position").between(0, length - 1))
    return rows.withColumn("position", F.when(u("reverse") < reverse, length - 1 - F.col("position")).otherwise(F.col("position"))).drop("_k", "_n")


def some_objects(objects: DataFrame, most: int, key: str = "video_id", seed: int = 0) -> DataFrame:
    """Up to ``most`` objects of each video, by hash."""
    w = Window.partitionBy(key).orderBy(F.xxhash64("object_id", F.lit(seed)), "object_id")
    return objects.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def listed(videos: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    rows = videos.join(include.select(key).distinct(), key, "left_semi") if include is not None else videos
    return rows.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else rows


def running(values: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds the running count, mean and last value of measures along ``order`` (as meters of training show them)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumns({f"{c}_{n}": f(c).over(w) for c in columns for n, f in (("avg", F.avg), ("count", F.count))})


def chained(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], *, only_if: dict[int, Column] | None = None) -> DataFrame:
    """Transforms one after another; step ``k`` with a condition in ``only_if`` changes just the rows that meet it, and keeps their columns."""
    for k, step in enumerate(steps):
        if only_if and k in only_if:
            meets = F.coalesce(only_if[k], F.lit(False))
            df = step(df.where(meets)).unionByName(df.where(~meets), allowMissingColumns=True)
        else:
            df = step(df)
    return df


def mixed(datasets: list[DataFrame], shares: list[float], key: str, seed: int = 0) -> DataFrame:
    """Rows of several datasets, each with its probability, with ``dataset``."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out = None
    for i, (d, p) in enumerate(zip(datasets, shares, strict=True)):
        part = d.where(u < p).withColumn("dataset", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
