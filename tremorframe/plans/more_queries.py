"""Queries of rasters, terrain, segmentation, learning, annotations and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import learning, position, raster, segmentation, shape, terrain, vision
from . import fixtures as fx
from .queries import FORCES_SQL, MEASURES_SQL, query, r6

PIXELS_SQL = """px AS (SELECT user_id AS id, CASE WHEN event_type <> 'error' THEN CAST(value AS DOUBLE) END AS value FROM events), ok AS (SELECT * FROM px WHERE value IS NOT NULL)"""
_HIST = """rng AS (
  SELECT id, min(value) AS a, max(value) AS b, count(*) AS total FROM ok GROUP BY id
), ends AS (SELECT id, total, b - a AS spread, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM rng
), hist AS (
  SELECT e.id, k.bin, count(o.value) AS n, count(o.value) / any_value(total)::DOUBLE AS share, any_value(lo + k.bin * ((hi - lo) / 5)) AS lo, any_value(lo + (k.bin + 1) * ((hi - lo) / 5)) AS hi, any_value(spread) AS spread
  FROM ends e CROSS JOIN (SELECT unnest(range(5)) AS bin) k LEFT JOIN ok o ON o.id = e.id AND least(floor((o.value - lo) / (hi - lo) * 5), 4) = k.bin GROUP BY e.id, k.bin
)"""
HIST_SQL = f"WITH {PIXELS_SQL}, {_HIST}"


@query(f"{HIST_SQL} SELECT id, CAST(bin AS INT) AS bin, n, {r6('share', 'share')} FROM hist")
def pixel_histogram(spark, sf):
    return raster.histogram(fx.pixels(spark, sf), 5).select("id", "bin", "n", "share")


def _peak(before: str, after: str) -> str:
    """The altitude of each id of ``ok`` from its histogram: equal neighbours make a run, whose middle counts."""
    return f"""lim AS (SELECT *, avg(share) OVER w + stddev_pop(share) OVER w AS floor_ FROM hist WINDOW w AS (PARTITION BY id)
), mark AS (SELECT *, CASE WHEN share = lag(share) OVER w THEN 0 ELSE 1 END AS fresh FROM lim WINDOW w AS (PARTITION BY id ORDER BY bin)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY bin) AS run FROM mark
), runs AS (SELECT id, run, any_value(share) AS share, any_value(floor_) AS floor_, (min(bin) + max(bin)) // 2 AS bin FROM numbered GROUP BY id, run
), peak AS (
  SELECT id, max(bin) AS bin FROM (SELECT *, coalesce(lag(share) OVER w, {before}) AS l, coalesce(lead(share) OVER w, {after}) AS r FROM runs WINDOW w AS (PARTITION BY id ORDER BY run))
  WHERE share > l AND share > r AND share >= floor_ GROUP BY id
), chosen AS (SELECT h.id, h.lo, h.hi FROM hist h JOIN peak USING (id, bin)), wide AS (SELECT id, any_value(spread) AS spread FROM hist GROUP BY id)
SELECT o.id, median(CASE WHEN c.id IS NULL THEN CASE WHEN spread < 10 THEN value END WHEN value > c.lo AND value < c.hi THEN value END) AS altitude
FROM ok o JOIN wide USING (id) LEFT JOIN chosen c ON c.id = o.id GROUP BY o.id"""


ROOF, GROUND = ("1e300", "-1"), ("-1", "1e300")


@query(f"WITH found AS ({HIST_SQL}, {_peak(*ROOF)}) SELECT id, {r6('altitude', 'altitude')} FROM found")
def roof_altitude(spark, sf):
    return raster.peak_height(fx.pixels(spark, sf), "roof")


@query(f"WITH found AS ({HIST_SQL}, {_peak(*GROUND)}) SELECT id, {r6('altitude', 'altitude')} FROM found")
def ground_altitude(spark, sf):
    return raster.peak_height(fx.pixels(spark, sf), "ground")


GRADIENT_SQL = f"""WITH {fx.GRID_SQL}, near AS (
  SELECT a.*, l.value AS lv, r.value AS rv, u.value AS uv, d.value AS dv FROM grid a
  LEFT JOIN grid l ON l.raster_id = a.raster_id AND l.row = a.row AND l.col = a.col - 1 LEFT JOIN grid r ON r.raster_id = a.raster_id AND r.row = a.row AND r.col = a.col + 1
  LEFT JOIN grid u ON u.raster_id = a.raster_id AND u.col = a.col AND u.row = a.row - 1 LEFT JOIN grid d ON d.raster_id = a.raster_id AND d.col = a.col AND d.row = a.row + 1
), grad AS (
  SELECT raster_id, row, col, value, coalesce((rv - lv) / 2, rv - value, value - lv, 0) AS gx, coalesce((dv - uv) / 2, dv - value, value - uv, 0) AS gy FROM near
), mag AS (SELECT raster_id, row, col, sqrt(gx * gx + gy * gy) AS gradient FROM grad)"""


@query(f"{GRADIENT_SQL} SELECT raster_id, row, col, {r6('gradient', 'gradient')} FROM mag")
def raster_gradient(spark, sf):
    return raster.gradient(fx.grid(spark, sf)).select("raster_id", "row", "col", "gradient")


_STEEP = "SELECT raster_id, avg(CASE WHEN gradient < lim THEN gradient END) AS steepness FROM (SELECT *, avg(gradient) OVER w + stddev_pop(gradient) OVER w AS lim FROM mag WINDOW w AS (PARTITION BY raster_id)) GROUP BY 1"


@query(f"WITH found AS ({GRADIENT_SQL} {_STEEP}) SELECT raster_id, {r6('steepness', 'steepness')} FROM found")
def steepness(spark, sf):
    return raster.trimmed_steepness(raster.gradient(fx.grid(spark, sf)), "raster_id")


@query(f"WITH {fx.GRID_SQL} SELECT a.raster_id, a.row, a.col, {r6('max(b.value)', 'local_max')} FROM grid a JOIN grid b ON a.raster_id = b.raster_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL")
def local_maximum(spark, sf):
    return terrain.local_maximum(fx.grid(spark, sf), "value").select("raster_id", "row", "col", "local_max")


@query(f"""WITH {fx.GRID_SQL} SELECT a.raster_id, a.row, a.col, {r6('sum(exp(-((a.row - b.row) ** 2 + (a.col - b.col) ** 2) / 2.0) * b.value) / sum(exp(-((a.row - b.row) ** 2 + (a.col - b.col) ** 2) / 2.0))', 'smooth')}
FROM grid a JOIN grid b ON a.raster_id = b.raster_id AND b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL""")
def gaussian_smooth(spark, sf):
    return terrain.smoothed(fx.grid(spark, sf), 1.0, 2.0).select("raster_id", "row", "col", "smooth")


def _surface(spark, sf):
    """The rasters as pixels of footprints, and a terrain of half their heights."""
    dsm = fx.grid(spark, sf).withColumnRenamed("raster_id", "id")
    return dsm, dsm.withColumn("value", F.col("value") / 2)


@query(f"""WITH {fx.GRID_SQL}, roof AS (WITH ok AS (SELECT raster_id AS id, value FROM grid), {_HIST}, {_peak(*ROOF)}), ground AS (WITH ok AS (SELECT raster_id AS id, value / 2 AS value FROM grid), {_HIST}, {_peak(*GROUND)}
), steep AS ({GRADIENT_SQL} {_STEEP})
SELECT roof.id, {r6('roof.altitude', 'roof_altitude')}, {r6('ground.altitude', 'ground_altitude')}, {r6('roof.altitude - ground.altitude', 'height')}, {r6('steepness', 'roof_steepness')}, {r6('steepness / 2', 'ground_steepness')}
FROM roof JOIN ground ON roof.id = ground.id JOIN steep ON raster_id = roof.id""")
def height_data(spark, sf):
    return raster.height_data(*_surface(spark, sf))


@query()
def roof_parts(spark, sf):
    """Corner lists are long, so parts come with their numbers of corners and holes."""
    parts = raster.roof_parts(_surface(spark, sf)[0], bins=4)
    e = F.col("geometry")
    return parts.select("id", "part", "height", "area", (F.size(e["exterior"]) - 1).alias("corners"), F.size(e["interiors"]).alias("holes"))


@query()
def elevation_setback(spark, sf):
    dsm, _ = _surface(spark, sf)
    box = g.polygon(g.ring((F.lit(0.0), F.lit(-8.0)), (F.lit(16.0), F.lit(-8.0)), (F.lit(16.0), F.lit(-1.0)), (F.lit(0.0), F.lit(-1.0))))
    buildings = dsm.groupBy("id").agg(F.max("value").alias("building_height")).select("id", box.alias("geometry"), "building_height", F.lit(0.0).alias("ground_altitude"))
    return raster.setback_elevation(buildings, raster.roof_parts(dsm, bins=4))


def _steep(k: int, source: str = "pt") -> str:
    """Slopes of ``source`` to the k nearest of it, by comparing all pairs: CTEs once, pair, steep."""
    return f"""once AS (SELECT min(id) AS id, x, y, height FROM {source} GROUP BY x, y, height
), pair AS (
  SELECT a.id, (a.height - b.height) / sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS slope, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS k
  FROM once a JOIN once b ON a.id <> b.id AND (a.x <> b.x OR a.y <> b.y)
), steep AS (SELECT id, arg_max(slope, (abs(slope), -k)) AS gradient FROM pair WHERE k <= {k} GROUP BY id)"""


@query(f"WITH {fx.POINTS_SQL}, {_steep(10)} SELECT pt.id, {r6('gradient', 'gradient')} FROM pt LEFT JOIN steep USING (id)")
def knn_gradient(spark, sf):
    return terrain.edge_gradient(fx.points(spark, sf), 10, cell=4.0).select("id", "gradient")


@query(f"""WITH {fx.POINTS_SQL}, first AS (WITH {_steep(10)} SELECT pt.* FROM pt LEFT JOIN steep USING (id) WHERE coalesce(abs(gradient), 0) < 60
), second AS (WITH {_steep(5, 'first')} SELECT first.* FROM first LEFT JOIN steep USING (id) WHERE coalesce(abs(gradient), 0) < 60) SELECT id, {r6('height', 'height')} FROM second""")
def terrain_clean(spark, sf):
    return terrain.cleaned(fx.points(spark, sf), 60.0, (10, 5), cell=4.0).select("id", "height")


@query(f"""WITH {fx.POINTS_SQL}, met AS (
  SELECT c.id, c.x + 0.5 AS x, c.y + 0.5 AS y, p.height, greatest(sqrt((p.x - c.x - 0.5) ** 2 + (p.y - c.y - 0.5) ** 2), 1e-6) AS d, row_number() OVER (PARTITION BY c.id ORDER BY sqrt((p.x - c.x - 0.5) ** 2 + (p.y - c.y - 0.5) ** 2), p.x, p.y, p.height) AS k
  FROM pt c JOIN pt p ON sqrt((p.x - c.x - 0.5) ** 2 + (p.y - c.y - 0.5) ** 2) <= 4
) SELECT pt.id, {r6('sum(met.height / d ** 2) / sum(1 / d ** 2)', 'value')} FROM pt LEFT JOIN met ON pt.id = met.id AND k <= 8 GROUP BY pt.id""")
def terrain_interpolate(spark, sf):
    cells = fx.points(spark, sf).select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return terrain.interpolated(fx.points(spark, sf), cells, 8, 4.0).select("id", "value")


# Segmentation ----------------------------------------------------------------------------------

MASK_SQL = f"""WITH {fx.MASKS_SQL}, cnt AS (SELECT image_id, gt_label AS gt, pd_label AS pd, count(*) AS n FROM px GROUP BY ALL
), area AS (SELECT *, sum(n) OVER (PARTITION BY image_id, gt) AS ga, sum(n) OVER (PARTITION BY image_id, pd) AS pa FROM cnt
), pr AS (SELECT image_id, gt, pd, n, ga, pa, n / (ga + pa - n)::DOUBLE AS j, 2 * n / (ga + pa)::DOUBLE AS d FROM area WHERE gt <> 0 AND pd <> 0
), im AS (SELECT image_id, count(DISTINCT nullif(gt_label, 0)) AS ng, count(DISTINCT nullif(pd_label, 0)) AS np, count(*) FILTER (gt_label <> 0) AS ga, count(*) FILTER (pd_label <> 0) AS pa FROM px GROUP BY 1)"""


@query(f"{MASK_SQL} SELECT image_id, gt, pd, n AS inter, {r6('j', 'jaccard')}, {r6('d', 'dice')} FROM pr")
def mask_intersections(spark, sf):
    return segmentation.intersections(fx.masks(spark, sf)).select("image_id", "gt", "pd", "inter", "jaccard", "dice")


@query(f"WITH {fx.MASKS_SQL}, t AS (SELECT count(*) FILTER (gt_label <> 0) AS a, count(*) FILTER (pd_label <> 0) AS b, count(*) FILTER (gt_label <> 0 AND pd_label <> 0) AS i FROM px) SELECT {r6('i / (a + b - i)::DOUBLE', 'jaccard')}, {r6('2 * i / (a + b)::DOUBLE', 'dice')} FROM t")
def mask_jaccard(spark, sf):
    return segmentation.pixel_scores(fx.masks(spark, sf))


@query(f"{MASK_SQL}, best AS (SELECT image_id, gt, max(j) AS j, max(d) AS d FROM pr GROUP BY ALL), s AS (SELECT image_id, sum(j) AS j, sum(d) AS d FROM best GROUP BY 1) SELECT image_id, {r6('coalesce(j, 0) / ng', 'best_jaccard')}, {r6('coalesce(d, 0) / ng', 'best_dice')} FROM im LEFT JOIN s USING (image_id)")
def mask_best(spark, sf):
    return segmentation.best_scores(fx.masks(spark, sf))


@query(f"{MASK_SQL}, a AS (SELECT image_id, sum(d) AS v FROM (SELECT image_id, gt, max(d) AS d FROM pr GROUP BY ALL) GROUP BY 1), b AS (SELECT image_id, sum(d) AS v FROM (SELECT image_id, pd, max(d) AS d FROM pr GROUP BY ALL) GROUP BY 1) SELECT image_id, {r6('least(coalesce(a.v, 0) / ng, coalesce(b.v, 0) / np)', 'sbd')} FROM im LEFT JOIN a USING (image_id) LEFT JOIN b USING (image_id)")
def mask_sbd(spark, sf):
    return segmentation.symmetric_best_dice(fx.masks(spark, sf))


@query(f"{MASK_SQL}, best AS (SELECT image_id, gt, pd, n, pa FROM pr QUALIFY row_number() OVER (PARTITION BY image_id, gt ORDER BY n DESC, pd) = 1), s AS (SELECT image_id, sum(n) AS c, sum(pa) AS chosen FROM best GROUP BY 1), u AS (SELECT image_id, sum(pa) AS used FROM (SELECT DISTINCT image_id, pd, pa FROM best) GROUP BY 1) SELECT image_id, {r6('c / (im.ga + chosen - c + im.pa - used)::DOUBLE', 'aji')} FROM im JOIN s USING (image_id) JOIN u USING (image_id)")
def mask_aji(spark, sf):
    return segmentation.aggregated_jaccard(fx.masks(spark, sf))


def _shifted(spark, sf):
    """Predictions that agree with the truth but for every tenth pixel, so that some match."""
    return fx.masks(spark, sf).withColumn("pd_label", F.when(F.col("pd_label") == 0, F.lit(0)).otherwise(F.col("gt_label")))


SHIFT_SQL = MASK_SQL.replace("CAST(l_partkey % 5 AS INT) AS pd_label", "CAST(CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_suppkey % 5 END AS INT) AS pd_label")
_TP = "tp AS (SELECT image_id, count(*) AS tp, sum(j) AS j FROM pr WHERE j > 0.5 GROUP BY 1), total AS (SELECT sum(ng) AS ng, sum(np) AS np, coalesce(sum(tp), 0) AS tp, coalesce(sum(j), 0) AS j FROM im LEFT JOIN tp USING (image_id))"


@query(f"{SHIFT_SQL}, {_TP} SELECT {r6('tp / ng', 'recall')}, {r6('tp / np', 'precision')}, {r6('2 * tp / (ng + np)', 'rq')}, {r6('j / tp', 'sq')}, {r6('2 * j / (ng + np)', 'pq')} FROM total")
def mask_panoptic(spark, sf):
    return segmentation.scores(_shifted(spark, sf))


@query(f"{SHIFT_SQL}, {_TP.split(', total')[0]} SELECT {r6('avg(tp / ng)', 'recall')}, {r6('avg(tp / np)', 'precision')}, {r6('avg(2 * tp / (ng + np))', 'rq')}, {r6('avg(j / tp)', 'sq')}, {r6('avg(2 * j / (ng + np))', 'pq')} FROM im JOIN tp USING (image_id)")
def mask_panoptic_by_image(spark, sf):
    return segmentation.scores(_shifted(spark, sf), image_average=True)


@query(f"{SHIFT_SQL}, t AS (SELECT CAST(unnest(range(50, 100, 5)) AS DOUBLE) / 100 AS threshold), n AS (SELECT sum(ng) AS ng, sum(np) AS np FROM im) SELECT threshold, {r6('tp / (ng + np - tp)', 'ap')} FROM (SELECT threshold, count(*) FILTER (j > threshold) AS tp FROM pr CROSS JOIN t GROUP BY 1) CROSS JOIN n")
def mask_average_precision(spark, sf):
    return segmentation.average_precision(_shifted(spark, sf))


@query(f"""{MASK_SQL}, lab AS (SELECT unnest([1, 2, 3, 4]) AS x), way AS (
  SELECT row_number() OVER () AS w, [a.x, b.x, c.x, d.x] AS pd FROM lab a, lab b, lab c, lab d WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND b.x <> c.x AND b.x <> d.x AND c.x <> d.x
), one AS (SELECT w, g.x AS gt, pd[g.x] AS pd FROM way, lab g
), total AS (SELECT image_id, w, sum(j) AS s FROM one JOIN pr USING (gt, pd) WHERE j >= 0.05 GROUP BY ALL
), best AS (SELECT image_id, w FROM total QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC) = 1
) SELECT image_id, gt, pd, {r6('j', 'jaccard')} FROM best JOIN one USING (w) JOIN pr USING (image_id, gt, pd) WHERE j >= 0.05""")
def mask_matching(spark, sf):
    return segmentation.matched(segmentation.intersections(fx.masks(spark, sf)), 0.05, "hungarian")


_CURVE = """, hit AS (SELECT {key}j, row_number() OVER ({by}ORDER BY j) - 1 AS k, lag(j, 1, 0) OVER ({by}ORDER BY j) AS x, lead(j) OVER ({by}ORDER BY j) IS NULL AS final FROM pr WHERE j >= 0.001
), n AS (SELECT {key}sum(ng) AS ng, sum(np) AS np, sum(tp) AS tp FROM im LEFT JOIN (SELECT image_id, count(*) AS tp FROM pr WHERE j >= 0.001 GROUP BY 1) USING (image_id) {group}
), slab AS (SELECT {key}(j - x) * ((tp - k) / (np + ng - tp + k) + (tp - greatest(k - 1, 0)) / (np + ng - tp + greatest(k - 1, 0))) / 2 + CASE WHEN final THEN (1 - j) * (tp - k) / (np + ng - tp + k) / 2 ELSE 0 END AS a FROM hit {join} n{using})"""


@query(f"{SHIFT_SQL}{_CURVE.format(key='', by='', group='', join='CROSS JOIN', using='')} SELECT {r6('sum(a)', 'sorted_ap')} FROM slab")
def mask_sorted_ap(spark, sf):
    return segmentation.sorted_average_precision(_shifted(spark, sf))


@query(f"{SHIFT_SQL}{_CURVE.format(key='image_id, ', by='PARTITION BY image_id ', group='GROUP BY image_id', join='JOIN', using=' USING (image_id)')} SELECT image_id, {r6('sum(a)', 'sorted_ap')} FROM slab GROUP BY 1")
def mask_sorted_ap_by_image(spark, sf):
    return segmentation.sorted_average_precision(_shifted(spark, sf), by_image=True)


# Learning ----------------------------------------------------------------------------------------


def _scored(spark, sf):
    return fx.table(spark, sf, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


@query(f"SELECT quality AS y_true, toxic AS y_pred, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY quality)::DOUBLE', 'share')} FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return learning.confusion(_scored(spark, sf))


REPORT_SQL = """WITH c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), k AS (SELECT DISTINCT unnest([t, p]) AS label FROM c), r AS (
  SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS predicted, coalesce((SELECT sum(n) FROM c WHERE t = label AND p = label), 0) AS tp FROM k)"""


@query(f"{REPORT_SQL} SELECT label, {r6('CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END', 'precision')}, {r6('CASE WHEN support > 0 THEN tp / support ELSE 0 END', 'recall')}, {r6('2 * tp / (support + predicted)', 'f1')}, CAST(support AS BIGINT) AS support FROM r")
def classification_report(spark, sf):
    return learning.report(_scored(spark, sf)).drop("tp")


@query(f"{REPORT_SQL} SELECT {r6('avg(2 * tp / (support + predicted))', 'macro_f1')}, {r6('sum(2 * tp / (support + predicted) * support) / sum(support)', 'weighted_f1')}, {r6('sum(tp) / sum(support)', 'accuracy')} FROM r")
def macro_f1(spark, sf):
    return learning.summary(learning.report(_scored(spark, sf)))


@query(f"SELECT label, count(*) AS n, {r6('max(count(*)) OVER () / count(*)::DOUBLE', 'weight')} FROM embeddings GROUP BY label")
def class_weights(spark, sf):
    return learning.class_weights(fx.table(spark, sf, "embeddings"), "label")


@query(f"SELECT {r6('avg(x)', 'mean')}, {r6('stddev_pop(x)', 'std')} FROM (SELECT (CAST(l_quantity AS DOUBLE) - avg(CAST(l_quantity AS DOUBLE)) OVER ()) / stddev_pop(CAST(l_quantity AS DOUBLE)) OVER () AS x FROM lineitem)")
def scaling(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))
    return learning.scaled(rows, learning.scaler(rows, ["x"])).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


PLACES_SQL = "WITH p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':0'), vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query(f"{PLACES_SQL} SELECT vec_id, label, CASE WHEN n = 1 OR k < round(n * 0.7) THEN 'train' WHEN k < round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM p")
def stratified_split(spark, sf):
    return learning.stratified_split(fx.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", ["label"])


@query(f"{PLACES_SQL} SELECT vec_id, label, CAST(k % 5 AS INT) AS fold FROM p")
def stratified_folds(spark, sf):
    return learning.folds(fx.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label")


def _features(spark, sf, n=8):
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)))
    return rows, [f"f{i}" for i in range(n)]


@query("SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS n FROM embeddings GROUP BY label")
def smote(spark, sf):
    rows, names = _features(spark, sf, 64)
    return learning.smote(rows, "id", "label", names).groupBy("label").agg(F.count("*").alias("n"))


@query()
def train_logistic(spark, sf):
    """Trains on the train split, scores the rest: macro-F1 and accuracy."""
    rows, names = _features(spark, sf, 64)
    parts = learning.stratified_split(rows, "id", ["label"])
    train, held = parts.where("split = 'train'"), parts.where("split <> 'train'")
    z = learning.scaler(train, names)
    model = learning.fit(learning.scaled(train, z), "LogisticRegression", names, "label", "class_weight")
    scored = held.select("id", F.col("label").alias("y_true")).join(learning.predict(model, learning.scaled(held, z), names).withColumnRenamed("prediction", "y_pred"), "id")
    return learning.summary(learning.report(scored))


# Annotations and relations -------------------------------------------------------------------------


def _annotations(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("image_id"), F.col("event_type").alias("category_id"), F.col("value").cast("double").alias("area"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("uncertain_iou"), F.lit(10).alias("width"), F.lit(20).alias("height"))


ANN_SQL = "WITH a AS (SELECT event_id AS id, user_id AS image_id, event_type AS category_id, CAST(value AS DOUBLE) AS area, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS uncertain_iou FROM events)"


@query(f"{ANN_SQL} SELECT image_id, count(*) AS n, {r6('sum(area)', 'area')} FROM a WHERE area > 0 AND (uncertain_iou IS NULL OR uncertain_iou >= 0.5) AND area / 200 < 0.4 GROUP BY 1")
def annotation_filters(spark, sf):
    return vision.keep_annotations(_annotations(spark, sf), 0.5, 0.4).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query(f"{ANN_SQL}, im AS (SELECT DISTINCT image_id, category_id FROM a), f AS (SELECT category_id, greatest(1, sqrt(2.0 * (SELECT count(DISTINCT image_id) FROM im) / count(*))) AS f FROM im GROUP BY 1) SELECT image_id, {r6('max(f)', 'repeat_factor')} FROM im JOIN f USING (category_id) GROUP BY 1")
def repeat_factors(spark, sf):
    return vision.repeat_factors(_annotations(spark, sf), 2.0)


@query("SELECT user_id AS video_id, event_id AS frame FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 4 = 0")
def every_nth_frame(spark, sf):
    return vision.every_nth(fx.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame")), 4)


@query("SELECT DISTINCT l_suppkey AS mask_id, l_orderkey % 400 AS pixel FROM lineitem")
def rle_round_trip(spark, sf):
    """Masks written as run lengths, and their pixels read back from the runs."""
    px = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mask_id"), (F.col("l_orderkey") % 400).cast("long").alias("pixel")).distinct()
    return vision.rle_of(px, ["mask_id"]).select("mask_id", F.explode(vision.rle_pixels(F.col("counts"))).alias("pixel"))


@query("SELECT l_suppkey AS mask_id, count(DISTINCT l_orderkey % 400) AS area FROM lineitem GROUP BY 1")
def rle_area(spark, sf):
    px = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mask_id"), (F.col("l_orderkey") % 400).cast("long").alias("pixel")).distinct()
    return vision.rle_of(px, ["mask_id"]).select("mask_id", vision.rle_area(F.col("counts")).alias("area"))


#: Whether a point (px, py) of local coordinates lies in a footprint: the crossings of a ray to the right of all its rings are odd.
INSIDE_SQL = "count(*) FILTER ((y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END)) % 2 = 1"


@query(f"WITH {fx.SHAPES_SQL}, pt AS (SELECT id, unnest([0.45, 0.5, 0.3]) * w AS px, unnest([0.45, 0.8, 0.9]) * h AS py, unnest([1, 2, 3]) AS k FROM shape) SELECT id, CAST(k AS INT) AS k, {INSIDE_SQL} AS inside FROM pt JOIN edge USING (id) GROUP BY id, k")
def point_in_polygon(spark, sf):
    """Whether three points of the bounds lie in the footprint: in the middle, in the U's gap, and near the top left."""
    rows = fx.shapes(spark, sf)
    b = g.bounds(F.col("geometry")["exterior"])
    at = lambda lo, hi, t: lo + t * (hi - lo)
    ks = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in ((1, 0.45, 0.45), (2, 0.5, 0.8), (3, 0.3, 0.9)))))
    rows = rows.withColumn("p", ks)
    return rows.select("id", "p.k", g.inside(F.col("geometry"), at(b["x0"], b["x1"], F.col("p.x")), at(b["y0"], b["y1"], F.col("p.y"))).alias("inside"))


@query(f"""WITH {fx.BLOCKS_SQL}, wall AS (
  SELECT a.id, least(a.y + 8, b.y + 8) - greatest(a.y, b.y) AS n FROM building a JOIN building b ON a.block = b.block AND abs(a.x - b.x) = 10
  UNION ALL SELECT a.id, least(a.x + 10, b.x + 10) - greatest(a.x, b.x) FROM building a JOIN building b ON a.block = b.block AND abs(a.y - b.y) = 8
) SELECT id, count(*) AS n, {r6('sum(n)', 'length')}, {r6('max(n)', 'longest')} FROM wall WHERE n > 0 GROUP BY 1""")
def walls_in_contact(spark, sf):
    """Numbers and lengths of walls in contact."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return position.contact_walls(fx.blocks(spark, sf)).groupBy("id").agg(F.count("*").alias("n"), F.sum(length).alias("length"), F.max(length).alias("longest"))


@query("SELECT p_brand AS brand, count(*) FILTER (p_size > 10) AS n FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 10) > 0")
def minimum_area(spark, sf):
    return learning.larger_than(fx.table(spark, sf, "part").withColumn("area", F.col("p_size")), 10).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS kept, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS removed FROM customer")
def label_whitelist(spark, sf):
    return learning.with_labels(fx.table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])[1]


#: Transverse Mercator by Krueger's series in the third flattening to the fourth order, hyperbolic functions by way of exp and ln.
UTM_SQL = f"""WITH {fx.SHAPES_SQL}, corner_at AS (SELECT id, ring, i, 6 + (x0 + x1) / 2000 AS lon, (y0 + y1) / 50 - 40 AS lat FROM edge JOIN shape USING (id)
), flat AS (SELECT 1 / 298.257223563::DOUBLE AS f), n1 AS (SELECT f / (2 - f) AS n FROM flat), k AS (
  SELECT n, 2 * sqrt(n) / (1 + n) AS e, 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, n / 2 - 2.0 / 3 * n ** 2 + 5.0 / 16 * n ** 3 + 41.0 / 180 * n ** 4 AS a1,
    13.0 / 48 * n ** 2 - 3.0 / 5 * n ** 3 + 557.0 / 1440 * n ** 4 AS a2, 61.0 / 240 * n ** 3 - 103.0 / 140 * n ** 4 AS a3, 49561.0 / 161280 * n ** 4 AS a4 FROM n1
), psi AS (
  SELECT *, ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / 2 - e * ln((1 + e * sin(radians(lat))) / (1 - e * sin(radians(lat)))) / 2 AS q, radians(lon - 9) AS l FROM corner_at CROSS JOIN k
), t AS (SELECT *, (exp(q) - exp(-q)) / 2 AS tn, (exp(q) + exp(-q)) / 2 AS ch FROM psi
), u AS (SELECT *, atan2(tn, cos(l)) AS xi, ln((1 + sin(l) / ch) / (1 - sin(l) / ch)) / 2 AS eta FROM t
), xy AS (
  SELECT id, ring, i, 500000 + 0.9996 * a * (eta + {" + ".join(f"a{j} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j in (1, 2, 3, 4))}) AS x,
    CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * a * (xi + {" + ".join(f"a{j} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j in (1, 2, 3, 4))}) AS y FROM u
)"""


@query(f"{UTM_SQL} SELECT id, CAST(ring AS INT) AS ring, CAST(i AS INT) AS corner, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM xy", places=3)
def utm_projection(spark, sf):
    """All corners of footprints that lie between 6 and 12 degrees east and on both sides of the equator, in zone 32."""
    turn = lambda q: g.point(6 + q["x"] / 2000, q["y"] / 50 - 40)
    geo = lambda c: F.struct(F.transform(c["exterior"], turn).alias("exterior"), F.transform(c["interiors"], lambda q: F.transform(q, turn)).alias("interiors"))
    rows = fx.shapes(spark, sf).select("id", F.posexplode(g.rings(geo(F.col("geometry")))).alias("ring", "r"))
    rows = rows.select("id", "ring", F.posexplode(F.slice("r", F.lit(1), F.size("r") - 1)).alias("corner", "p"))
    xy = g.to_utm(F.col("p.x"), F.col("p.y"), F.lit(32), F.col("p.y") < 0)
    return rows.withColumn("q", xy).select("id", "ring", "corner", "q.x", "q.y")


@query(f"""WITH {fx.SHAPES_SQL}, px AS (
  SELECT id, x0, y0, CAST(x0 + i AS INT) AS col, CAST(-y0 + 9 - j AS INT) AS row, i + 0.5 AS px, j + 0.5 AS py FROM shape, (SELECT unnest(range(14)) AS i), (SELECT unnest(range(10)) AS j)
), hit AS (SELECT id, row, col, {INSIDE_SQL} AS inside FROM px JOIN edge USING (id) GROUP BY ALL)
SELECT id, row, col, CAST((row * 31 + col * 17) % 101 AS DOUBLE) AS value FROM hit WHERE inside""")
def clip_raster(spark, sf):
    """The pixels of a raster of 1 m around all footprints whose centres lie in one."""
    at = fx.shapes(spark, sf).select(g.bounds(F.col("geometry")["exterior"]).alias("b")).select("b.x0", "b.y0")
    spread = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(13)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9))))
    spread = spread.select((F.col("x0") + F.col("i")).cast("int").alias("col"), (9 - F.col("y0") - F.col("j")).cast("int").alias("row"))
    grid = spread.select("row", "col", ((F.col("row") * 31 + F.col("col") * 17) % 101).cast("double").alias("value"))
    return raster.clip(grid, fx.shapes(spark, sf), 0.0, 10.0, 1.0)


@query(f"""{FORCES_SQL.format(gap=0.0002, least=0.001).split("), force AS")[0]}) SELECT b.id, CASE WHEN t.id IS NOT NULL THEN 3.0::DOUBLE END AS height, {r6('coalesce(total / sqrt(80), 0)', 'force')},
  {r6('coalesce(least(CASE WHEN total > 1e-9 THEN (each - total) / total WHEN each > 0 THEN 1e6 ELSE 0 END, 1e6), 0)', 'confinement_ratio')},
  {r6('coalesce(least(abs(m0), abs(m1), abs(m2)) * 80 / (80 * 164 / 12.0), 0)', 'angular_acc')}, {r6('coalesce(least(CASE WHEN total > 1e-9 THEN 2 * bend / total WHEN bend > 0 THEN 1e6 ELSE 0 END, 1e6), 0)', 'angle')}
FROM building b LEFT JOIN t USING (id)""")
def documented_forces(spark, sf):
    return position.contact_forces(fx.blocks(spark, sf), mode="documented").withColumn("confinement_ratio", F.least("confinement_ratio", F.lit(1e6))).withColumn("angle", F.least("angle", F.lit(1e6)))


@query(f"{MEASURES_SQL} SELECT id, {r6('height / sqrt(area / sqrt((centre + radius) / (centre - radius)))', 'slenderness')} FROM pr JOIN shape USING (id)")
def elevation_slenderness(spark, sf):
    rows = shape.prepared(fx.shapes(spark, sf), "height")
    return rows.select("id", raster.slenderness_of_elevation(F.col("height"), F.col("m")["area"], F.sqrt(F.col("p")["i1"] / F.col("p")["i2"])).alias("slenderness"))
