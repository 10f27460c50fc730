"""Instance-segmentation quality: pixels in long form ``(image_id, gt_label, pd_label)``, 0 for background.

One aggregate makes the intersection matrix (combined before the shuffle, so a shuffle carries one row per pair of
instances and task); areas and unions are window sums over it. Everything after works on pairs, not pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersections(pixels: DataFrame) -> DataFrame:
    """(image_id, gt, pd, inter, gt_area, pd_area, jaccard, dice) of overlapping instances; background as label 0 is kept for areas only."""
    pairs = pixels.groupBy("image_id", F.col("gt_label").alias("gt"), F.col("pd_label").alias("pd")).agg(F.count("*").alias("inter"))
    area = lambda c: F.sum("inter").over(Window.partitionBy("image_id", c))
    rows = pairs.withColumns({"gt_area": area("gt"), "pd_area": area("pd")}).where("gt <> 0 and pd <> 0")
    i, a, b = (F.col(c).cast("double") for c in ("inter", "gt_area", "pd_area"))
    return rows.withColumns({"jaccard": i / (a + b - i), "dice": 2 * i / (a + b)})


def instances(pixels: DataFrame) -> DataFrame:
    """(image_id, n_gt, n_pd, gt_area, pd_area) of every image."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    return pixels.groupBy("image_id").agg(F.count_distinct(some("gt_label")).alias("n_gt"), F.count_distinct(some("pd_label")).alias("n_pd"), F.count(some("gt_label")).alias("gt_area"), F.count(some("pd_label")).alias("pd_area"))


def matched(pairs: DataFrame, threshold: float, method: str = "auto") -> DataFrame:
    """(image_id, gt, pd, jaccard) of matches. From 0.5 on, a pair above the threshold is the only one of both its instances.

    Below, ``hungarian`` finds the assignment of largest total Jaccard and ``maximum`` the one of most pairs, per image (an image's instances meet in one task).
    """
    if method == "auto" and threshold >= 0.5:
        return pairs.where(F.col("jaccard") > threshold).select("image_id", "gt", "pd", "jaccard")
    weigh = (lambda j: j) if method != "maximum" else (lambda j: np.where(j > 0, 1.0, 0.0))

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        gt, pd_ = np.unique(frame["gt"]), np.unique(frame["pd"])
        j = np.zeros((len(gt), len(pd_)))
        j[np.searchsorted(gt, frame["gt"]), np.searchsorted(pd_, frame["pd"])] = np.where(frame.jaccard >= threshold, frame.jaccard, 0)
        rows, cols = hungarian(weigh(j))
        keep = j[rows, cols] > 0
        rows, cols = rows[keep], cols[keep]
        return pd.DataFrame({"image_id": frame.image_id.iloc[0], "gt": gt[rows], "pd": pd_[cols], "jaccard": j[rows, cols]})

    schema = f"image_id {pairs.schema['image_id'].dataType.simpleString()}, gt {pairs.schema['gt'].dataType.simpleString()}, pd {pairs.schema['pd'].dataType.simpleString()}, jaccard double"
    return pairs.select("image_id", "gt", "pd", "jaccard").where(F.col("jaccard") >= threshold).groupBy("image_id").applyInPandas(assign, schema)


def hungarian(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of largest total weight (shortest augmenting paths with potentials)."""
    n, m = weight.shape
    if n > m:
        cols, rows = hungarian(weight.T)
        return rows, cols
    cost = weight.max(initial=0) - weight
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            seen[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~seen[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < low[free]
            low[free[better]], back[free[better]] = now[better], j0
            j1 = free[low[free].argmin()]
            step = low[j1]
            u[owner[seen]] += step
            v[seen] -= step
            low[~seen] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    at = np.flatnonzero(owner[1:])
    order = np.argsort(owner[1:][at])
    return owner[1:][at][order] - 1, at[order]


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    """a / b, and ``empty`` where there is nothing to divide by."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def scores(pixels: DataFrame, threshold: float = 0.5, image_average: bool = False) -> DataFrame:
    """One row: recall, precision, f1 (recognition quality), segmentation quality and panoptic quality at a threshold.

    Over all images, or averaged over images; without objects on one side the ratio is 1.
    """
    hits = matched(intersections(pixels), threshold).groupBy("image_id").agg(F.count("*").alias("tp"), F.sum("jaccard").alias("j"))
    each = instances(pixels).join(hits, "image_id", "left").fillna({"tp": 0, "j": 0.0})
    if not image_average:
        each = each.agg(*(F.sum(c).alias(c) for c in ("n_gt", "n_pd", "tp", "j")))
    tp, both = F.col("tp"), F.col("n_gt") + F.col("n_pd")
    values = {"recall": ratio(tp, F.col("n_gt")), "precision": ratio(tp, F.col("n_pd")), "rq": ratio(2 * tp, both), "sq": ratio(F.col("j"), tp, 0.0), "pq": ratio(2 * F.col("j"), both)}
    return each.select(*(v.alias(k) for k, v in values.items())).agg(*(F.avg(k).alias(k) for k in values))


def average_precision(pixels: DataFrame, thresholds: tuple[float, ...] = tuple(np.arange(0.5, 1.0, 0.05).round(2).tolist())) -> DataFrame:
    """(threshold, ap): tp / (tp + fp + fn) over all images; their mean is the mAP."""
    pairs = intersections(pixels)
    total = instances(pixels).agg(F.sum("n_gt").alias("n_gt"), F.sum("n_pd").alias("n_pd"))
    at = pairs.select("jaccard", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("jaccard") > F.col("threshold")).alias("tp"))
    return at.crossJoin(F.broadcast(total)).select("threshold", ratio(F.col("tp"), F.col("n_gt") + F.col("n_pd") - F.col("tp")).alias("ap"))  # one row of totals


def mean_average_precision(pixels: DataFrame, **kw) -> DataFrame:
    return average_precision(pixels, **kw).agg(F.avg("ap").alias("map"))


def pixel_scores(pixels: DataFrame) -> DataFrame:
    """One row: Jaccard and Dice of foreground against foreground."""
    a, b = F.count_if(F.col("gt_label") != 0), F.count_if(F.col("pd_label") != 0)
    i = F.count_if((F.col("gt_label") != 0) & (F.col("pd_label") != 0))
    return pixels.agg(ratio(i, a + b - i).alias("jaccard"), ratio(2 * i, a + b).alias("dice"))


def best_scores(pixels: DataFrame) -> DataFrame:
    """(image_id, best_jaccard, best_dice): mean over ground-truth instances of the best overlap with a prediction."""
    best = intersections(pixels).groupBy("image_id", "gt").agg(F.max("jaccard").alias("j"), F.max("dice").alias("d")).groupBy("image_id").agg(F.sum("j").alias("j"), F.sum("d").alias("d"))
    rows = instances(pixels).join(best, "image_id", "left").fillna(0.0, ["j", "d"])
    return rows.select("image_id", ratio(F.col("j"), F.col("n_gt")).alias("best_jaccard"), ratio(F.col("d"), F.col("n_gt")).alias("best_dice"))


def symmetric_best_dice(pixels: DataFrame) -> DataFrame:
    """(image_id, sbd): the smaller of the mean best Dice both ways."""
    pairs = intersections(pixels)
    side = lambda c, n: pairs.groupBy("image_id", c).agg(F.max("dice").alias("d")).groupBy("image_id").agg(F.sum("d").alias(n))
    rows = instances(pixels).join(side("gt", "a"), "image_id", "left").join(side("pd", "b"), "image_id", "left").fillna(0.0, ["a", "b"])
    return rows.select("image_id", F.least(ratio(F.col("a"), F.col("n_gt")), ratio(F.col("b"), F.col("n_pd"))).alias("sbd"))


def aggregated_jaccard(pixels: DataFrame) -> DataFrame:
    """(image_id, aji): overlaps with each instance's best prediction (largest overlap, then smallest label) by their unions and the predictions left over."""
    best = intersections(pixels).groupBy("image_id", "gt").agg(F.max_by(F.struct("pd", "inter", "pd_area"), F.struct("inter", -F.col("pd"))).alias("x")).select("image_id", "gt", "x.*")
    used = best.select("image_id", "pd", "pd_area").distinct().groupBy("image_id").agg(F.sum("pd_area").alias("used"))
    sums = best.groupBy("image_id").agg(F.sum("inter").alias("c"), F.sum("pd_area").alias("chosen"))
    rows = instances(pixels).join(sums, "image_id", "left").join(used, "image_id", "left").fillna(0, ["c", "chosen", "used"])
    union = F.col("gt_area") + F.col("chosen") - F.col("c") + F.col("pd_area") - F.col("used")
    return rows.select("image_id", ratio(F.col("c"), union).alias("aji"))


def _sorted_area(steps: DataFrame, key: list[str], totals: DataFrame, truncation: float = 1.0) -> DataFrame:
    """Area under (tp - k) / (n_pd + fn + k) over the matches' sorted Jaccards, k of them lost, from the first value at 0 to 0 at 1.

    ``steps``: (key, jaccard, n: matches of that Jaccard, before: matches under it, last: the Jaccard before it or null); ``totals``: (key, n_gt, n_pd, tp).
    Beyond ``truncation`` the first curve value counts at the truncation, the rest is left out.
    """
    rows = steps.join(totals, key) if key else steps.crossJoin(F.broadcast(totals))  # without a key one row
    fn = F.col("n_gt") - F.col("tp")
    value = lambda k: (F.col("tp") - k) / (F.col("n_pd") + fn + k)
    first = F.col("before")
    x, y0, y1 = F.least("jaccard", F.lit(truncation)), F.when(first > 0, value(first - 1)).otherwise(value(first)), value(first)
    inside = F.coalesce(F.col("last"), F.lit(0.0)) <= truncation
    area = F.when(inside, (x - F.coalesce(F.col("last"), F.lit(0.0))) * (y0 + y1) / 2)
    # After the last step the curve falls to 0 at 1: from the value of its last match, or of the first beyond the truncation.
    end = F.when(F.col("jaccard") > truncation, value(first)).otherwise(value(first + F.col("n") - 1))
    tail = F.max_by(F.struct(x.alias("x"), end.alias("y")), F.when(inside, F.col("jaccard")))
    out = rows.groupBy(*key).agg(F.sum(area).alias("a"), tail.alias("t")).select(*key, (F.col("a") + (1 - F.col("t.x")) * F.col("t.y") / 2).alias("sorted_ap"))
    known = totals.join(out, key, "left") if key else totals.crossJoin(F.broadcast(out))
    nothing = F.when((F.col("tp") == 0) & (F.col("n_gt") > 0), 0.0).when(F.col("n_pd") == 0, 1.0)
    return known.select(*key, F.coalesce(nothing, F.col("sorted_ap"), F.lit(0.0)).alias("sorted_ap"))


def sorted_average_precision(pixels: DataFrame, threshold: float = 0.001, truncation: float = 1.0, by_image: bool = False, buckets: int = 4096) -> DataFrame:
    """(image_id, sorted_ap) of every image, or one row over all: see ``_sorted_area``. Matches are those of largest total Jaccard at ``threshold``.

    Over all images the Jaccards are put in order by buckets of their range, then within each, so no task sorts them all.
    """
    hits = matched(intersections(pixels), threshold, "hungarian")
    count = hits.groupBy("image_id").agg(F.count("*").alias("tp"))
    each = instances(pixels).join(count, "image_id", "left").select("image_id", "n_gt", "n_pd", F.coalesce("tp", F.lit(0)).alias("tp"))
    if by_image:
        w = Window.partitionBy("image_id").orderBy("jaccard")
        steps = hits.groupBy("image_id", "jaccard").agg(F.count("*").alias("n")).select("*", (F.sum("n").over(w) - F.col("n")).alias("before"), F.lag("jaccard").over(w).alias("last"))
        return _sorted_area(steps, ["image_id"], each)
    steps = hits.groupBy("jaccard").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("jaccard") * buckets))
    w = Window.orderBy("b")  # one row a bucket
    ends = steps.groupBy("b").agg(F.sum("n").alias("m"), F.max("jaccard").alias("top")).select("b", (F.sum("m").over(w) - F.col("m")).alias("under"), F.lag("top").over(w).alias("below"))
    w = Window.partitionBy("b").orderBy("jaccard")
    rows = steps.select("*", (F.sum("n").over(w) - F.col("n")).alias("own"), F.lag("jaccard").over(w).alias("near")).join(F.broadcast(ends), "b")  # ``buckets`` + 1 rows at most
    rows = rows.select("jaccard", "n", (F.col("own") + F.col("under")).alias("before"), F.coalesce("near", "below").alias("last"))
    return _sorted_area(rows, [], each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_gt", "n_pd", "tp"))), truncation)
