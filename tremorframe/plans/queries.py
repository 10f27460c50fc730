"""Registered queries over the synthetic fixtures, and the SQL that must give the same rows.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import geometry as g
from ..operators import position, shape
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, places: int = 6):
    """Registers a function as a query under its name, its doubles rounded (and -0 made 0)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((F.round(F.col(c.name), places) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, DoubleType) else F.col(c.name) for c in df.schema.fields))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


r6 = lambda x, name: f"round({x}, 6) + 0.0 AS {name}"

MEASURES_SQL = f"""WITH {fx.SHAPES_SQL}, part_sum AS (
  SELECT id, ring, CASE WHEN ring = 0 THEN 1.0 ELSE -1.0 END AS s, abs(sum(c)) / 2 AS a, sum((x1 + x2) * c) * sign(sum(c)) / 6 AS sx, sum((y1 + y2) * c) * sign(sum(c)) / 6 AS sy,
    sum((x1 * x1 + x1 * x2 + x2 * x2) * c) * sign(sum(c)) / 12 AS xx, sum((y1 * y1 + y1 * y2 + y2 * y2) * c) * sign(sum(c)) / 12 AS yy,
    sum((x1 * y2 + 2 * x1 * y1 + 2 * x2 * y2 + x2 * y1) * c) * sign(sum(c)) / 24 AS xy,
    sum(n) AS p, sum((x1 + x2) / 2 * n) AS px, sum((y1 + y2) / 2 * n) AS py
  FROM (SELECT *, x1 * y2 - x2 * y1 AS c, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS n FROM edge) GROUP BY id, ring
), total AS (
  SELECT id, sum(s * a) AS area, sum(s * sx) / sum(s * a) AS cx, sum(s * sy) / sum(s * a) AS cy, sum(s * xx) AS xx, sum(s * yy) AS yy, sum(s * xy) AS xy,
    sum(p) AS perimeter, sum(px) AS px, sum(py) AS py, sum(CASE WHEN ring = 0 THEN a END) AS filled, sum(CASE WHEN ring = 0 THEN p END) AS outline
  FROM part_sum GROUP BY id
), m AS (
  SELECT *, px / perimeter AS bx, py / perimeter AS by_, (area * cx + 3 * px) / (area + 3 * perimeter) AS mx, (area * cy + 3 * py) / (area + 3 * perimeter) AS my,
    xx - area * cx * cx AS ixx, yy - area * cy * cy AS iyy, xy - area * cx * cy AS ixy
  FROM total
), pr AS (
  SELECT *, (ixx + iyy) / 2 AS centre, sqrt(((ixx - iyy) / 2) ** 2 + ixy ** 2) AS radius, atan2(ixy, (ixx - iyy) / 2) / 2 AS theta FROM m
)
"""


@query(f"{MEASURES_SQL} SELECT p_brand AS brand, count(*) AS n, {r6('avg(area)', 'area')}, {r6('avg(perimeter)', 'perimeter')}, {r6('max(ixx + iyy)', 'iz')}, {r6('avg(4 * pi() * filled / outline ** 2)', 'polsby_popper')}, {r6('avg(sqrt((centre + radius) / (centre - radius)))', 'slenderness')} FROM pr JOIN part ON id = p_partkey GROUP BY 1")
def shape_summary(spark, sf):
    """The flagship: shape indices of all footprints, summed up by brand in one scan and one partial aggregate."""
    rows = shape.prepared(fx.shapes(spark, sf), "brand")
    m, f, p = F.col("m"), F.col("f"), F.col("p")
    return rows.groupBy("brand").agg(F.count("*").alias("n"), F.avg(m["area"]).alias("area"), F.avg(m["perimeter"]).alias("perimeter"), F.max(m["iz"]).alias("iz"), F.avg(4 * 3.141592653589793 * f["area"] / f["perimeter"] ** 2).alias("polsby_popper"), F.avg(F.sqrt(p["i1"] / p["i2"])).alias("slenderness"))


@query(f"{MEASURES_SQL} SELECT id, {r6('area', 'area')}, {r6('perimeter', 'perimeter')}, {r6('x0 + k.cx', 'cx')}, {r6('y0 + k.cy', 'cy')}, {r6('x0 + k.bx', 'bx')}, {r6('y0 + k.by_', 'by')}, {r6('x0 + k.mx', 'mx')}, {r6('y0 + k.my', 'my')} FROM pr k JOIN shape USING (id)")
def poly_measures(spark, sf):
    return shape.prepared(fx.shapes(spark, sf)).select("id", *(F.col("m")[c].alias(c) for c in ("area", "perimeter", "cx", "cy", "bx", "by", "mx", "my")))


@query(f"{MEASURES_SQL} SELECT id, {r6('ixx', 'ixx')}, {r6('iyy', 'iyy')}, {r6('ixy', 'ixy')}, {r6('ixx + iyy', 'iz')}, {r6('centre + radius', 'i1')}, {r6('centre - radius', 'i2')} FROM pr")
def poly_inertia(spark, sf):
    rows = shape.prepared(fx.shapes(spark, sf))
    return rows.select("id", *(F.col("m")[c].alias(c) for c in ("ixx", "iyy", "ixy", "iz")), *(F.col("p")[c].alias(c) for c in ("i1", "i2")))


@query(f"{MEASURES_SQL} SELECT id, {r6('4 * pi() * filled / outline ** 2', 'polsby_popper')} FROM pr")
def polsby_popper(spark, sf):
    return shape.polsby_popper(fx.shapes(spark, sf))


@query(f"{MEASURES_SQL} SELECT id, {r6('sqrt((centre + radius) / (centre - radius))', 'inertia_slenderness')}, {r6('degrees(theta)', 'direction')} FROM pr", places=6)
def inertia_slenderness(spark, sf):
    return shape.inertia_slenderness(fx.shapes(spark, sf))


@query(f"{MEASURES_SQL}, ext AS (SELECT id, max(x1 * cos(theta) + y1 * sin(theta)) - min(x1 * cos(theta) + y1 * sin(theta)) AS a, max(y1 * cos(theta) - x1 * sin(theta)) - min(y1 * cos(theta) - x1 * sin(theta)) AS b FROM pr JOIN edge USING (id) WHERE ring = 0 GROUP BY id) SELECT id, {r6('greatest(a, b) / least(a, b)', 'circumscribed_slenderness')} FROM ext")
def circumscribed_slenderness(spark, sf):
    return shape.circumscribed_slenderness(fx.shapes(spark, sf)).drop("direction")


@query(f"{MEASURES_SQL} SELECT id, {r6('area ** 2 / (4 * pi()) / (ixx + iyy)', 'inertia_circle')} FROM pr")
def inertia_circle(spark, sf):
    return shape.inertia_circle(fx.shapes(spark, sf))


#: The smallest rectangle has a side along some pair of corners; best: its sides, the longer first, and its direction.
RECTANGLE_SQL = f"""WITH {fx.SHAPES_SQL}, way AS (
  SELECT DISTINCT a.id, atan2(b.y1 - a.y1, b.x1 - a.x1) AS t FROM edge a JOIN edge b ON a.id = b.id AND a.ring = 0 AND b.ring = 0 AND a.i <> b.i
), spread AS (
  SELECT id, t, max(x1 * cos(t) + y1 * sin(t)) - min(x1 * cos(t) + y1 * sin(t)) AS a, max(y1 * cos(t) - x1 * sin(t)) - min(y1 * cos(t) - x1 * sin(t)) AS b
  FROM way JOIN edge USING (id) WHERE ring = 0 GROUP BY id, t
), best AS (
  SELECT id, greatest(a, b) AS l1, least(a, b) AS l2, t + CASE WHEN a >= b THEN 0 ELSE pi() / 2 END AS t1
  FROM spread QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(a * b, 9), abs(sin(2 * t))) = 1
)"""


@query(f"{RECTANGLE_SQL} SELECT id, {r6('l1 / l2', 'min_bbox_slenderness')} FROM best")
def min_bbox_slenderness(spark, sf):
    return shape.min_bbox_slenderness(fx.shapes(spark, sf)).drop("direction")


@query(f"WITH {fx.SHAPES_SQL} SELECT id, {r6('1 - (CASE kind WHEN 1 THEN w * h / 8 WHEN 3 THEN w * h / 4 WHEN 4 THEN w * h / 16 ELSE 0 END) / (CASE kind WHEN 1 THEN 0.75 WHEN 3 THEN 0.75 WHEN 4 THEN 0.75 ELSE 1 END * w * h)', 'compactness')} FROM shape")
def compactness(spark, sf):
    return shape.compactness(fx.shapes(spark, sf))


@query(f"WITH {fx.SHAPES_SQL} SELECT id, {r6('CASE kind WHEN 1 THEN 0.75 / 0.875 WHEN 3 THEN 0.75 WHEN 4 THEN 0.75 / 0.875 ELSE 1 END', 'compactness')} FROM shape")
def compactness_documented(spark, sf):
    return shape.compactness(fx.shapes(spark, sf), mode="documented")


#: Extents of each pocket along the smallest rectangle; the pockets are known for each kind.
POCKET_SQL = f"""{RECTANGLE_SQL}, pocket(kind, k, a, b) AS (VALUES
  (1, 0, 1, 0.5), (1, 0, 0.5, 0.5), (1, 0, 0.5, 1), (3, 0, 0.75, 1), (3, 0, 0.75, 0.5), (3, 0, 0.25, 0.5), (3, 0, 0.25, 1),
  (4, 0, 0.75, 0), (4, 0, 0.75, 0.5), (4, 0, 1, 0.5), (4, 1, 0, 0.5), (4, 1, 0.25, 0.5), (4, 1, 0.25, 0)
), reach AS (
  SELECT id, k, l1, l2, max(a * w * cos(t1) + b * h * sin(t1)) - min(a * w * cos(t1) + b * h * sin(t1)) AS b1, max(b * h * cos(t1) - a * w * sin(t1)) - min(b * h * cos(t1) - a * w * sin(t1)) AS b2
  FROM best JOIN shape USING (id) JOIN pocket USING (kind) GROUP BY id, k, l1, l2
)"""


@query(f"{POCKET_SQL} SELECT id, {r6('coalesce(max(least(b1 / l1, b2 / l2)), 0)', 'setback_ratio')} FROM shape LEFT JOIN reach USING (id) GROUP BY id")
def setback_ratio(spark, sf):
    return shape.setback_ratio(fx.shapes(spark, sf))


@query(f"{POCKET_SQL} SELECT id, {r6('coalesce(max(least(b1 / l2, b2 / l1)), 0)', 'gndt_beta_2')} FROM shape LEFT JOIN reach USING (id) GROUP BY id")
def gndt_beta_2(spark, sf):
    return shape.gndt_beta_2_setback_ratio(fx.shapes(spark, sf))


@query(f"WITH {fx.SHAPES_SQL} SELECT id, {r6('CASE kind WHEN 2 THEN 0.0625 ELSE 0 END', 'hole_ratio')} FROM shape")
def hole_ratio(spark, sf):
    return shape.asce_7_hole_ratio(fx.shapes(spark, sf))


@query(f"""{RECTANGLE_SQL} SELECT id, {r6('degrees(sum(acos(least(greatest(abs(x2 - x1) * 0 + abs((x2 - x1) * cos(t1) + (y2 - y1) * sin(t1)), abs((y2 - y1) * cos(t1) - (x2 - x1) * sin(t1))) / n, 1)) * n) / sum(n))', 'parallelity_angle')}
FROM (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS n FROM edge) JOIN best USING (id) GROUP BY id""", places=5)
def parallelity_angle(spark, sf):
    return shape.asce_7_parallelity_angle(fx.shapes(spark, sf))


@query(f"WITH {fx.SHAPES_SQL} SELECT id, {r6('CASE kind WHEN 2 THEN 0.25 ELSE 0 END', 'ntc_hole_ratio')} FROM shape")
def ntc_hole_ratio(spark, sf):
    return shape.NTC_hole_ratio(fx.shapes(spark, sf))


@query(f"""WITH {fx.SHAPES_SQL}, off AS (
  SELECT *, w / 2 AS p, h / 2 AS q, sqrt((w / 2) ** 2 + (h / 2) ** 2) AS d1, sqrt((w / 4) ** 2 + (h / 2) ** 2) AS d2 FROM shape
) SELECT id, {r6('''CASE kind
  WHEN 1 THEN (p * (p / 2 * q) / d1 + q * (q / 2 * p) / d1) / (w + h / 2 + d1 + w / 2 + h)
  WHEN 3 THEN (2 * (h / 2) * (h / 4) + (w / 2) * (h / 2)) / (2 * (w + h))
  WHEN 4 THEN 2 * ((w / 4) * (w / 8 * (h / 2) / d2) + (h / 2) * (h / 4 * (w / 4) / d2)) / (w / 2 + 2 * d2 + w + 2 * (h / 2))
  ELSE 0 END''', 'convex_hull_momentum')} FROM off""")
def convex_hull_momentum(spark, sf):
    return shape.convex_hull_momentum(fx.shapes(spark, sf))


#: The best of a grid over directions, then of a finer one around it.
EC_SQL = f"""{MEASURES_SQL}, way AS (SELECT CAST(unnest(range(18000)) AS DOUBLE) * pi() / 18000 AS x), kindly AS (
  SELECT min(id) AS id, w, h, kind FROM shape GROUP BY w, h, kind
), ecc AS (
  SELECT pr.*, {{e}} AS e, atan2({{ey}} * cos(theta) - {{ex}} * sin(theta), {{ex}} * cos(theta) + {{ey}} * sin(theta)) AS b FROM pr JOIN kindly USING (id)
), coarse AS (
  SELECT ecc.*, x FROM ecc JOIN way ON e > 1e-10 OR x = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY {{value}} DESC) = 1
), fine AS (
  SELECT coarse.* REPLACE (x + step * pi() / 18000 / 1000 AS x) FROM coarse JOIN (SELECT unnest(range(-1000, 1001)) AS step) ON e > 1e-10 OR step = 0
), worst AS (SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY id ORDER BY {{value}} DESC) = 1
)"""


def _ec(ex: str, ey: str, value: str) -> str:
    return EC_SQL.format(ex=f"({ex})", ey=f"({ey})", e=f"sqrt(({ex}) ** 2 + ({ey}) ** 2)", value=value)


EC8_SQL = _ec("mx - bx", "my - by_", "cos(x - b) ** 2 * (centre - radius * cos(2 * x))") + """ SELECT s.id,
  round(e * abs(cos(x - b)) / sqrt((ixx + iyy + area * e * e) / (centre - radius * cos(2 * x))), 5) + 0.0 AS eccentricity_ratio,
  round(sqrt((ixx + iyy + area * e * e) / (centre - radius * cos(2 * x))) / sqrt((ixx + iyy) / area), 5) + 0.0 AS radius_ratio,
  round(sqrt((centre + radius) / (centre - radius)), 5) + 0.0 AS slenderness,
  round(1 - (CASE s.kind WHEN 1 THEN 0.125 WHEN 3 THEN 0.25 WHEN 4 THEN 0.0625 ELSE 0 END) / (CASE WHEN s.kind IN (1, 3, 4) THEN 0.75 ELSE 1 END), 5) + 0.0 AS compactness,
  round(degrees(-theta), 5) + 0.0 AS angle_slenderness
FROM worst k JOIN kindly USING (id) JOIN shape s ON s.w = kindly.w AND s.h = kindly.h AND s.kind = kindly.kind"""


@query(EC8_SQL, places=5)
def eurocode_8(spark, sf):
    """All columns but the worst direction: symmetric shapes have two of them."""
    return shape.eurocode_8(fx.shapes(spark, sf)).drop("angle_eccentricity")


@query(_ec("mx - cx", "my - cy", "cos(x - b) ** 4 * (centre - radius * cos(2 * x)) / (centre + radius * cos(2 * x))") + """ SELECT s.id,
  round(e * abs(cos(x - b)) / (sqrt(area) * ((centre + radius * cos(2 * x)) / (centre - radius * cos(2 * x))) ** 0.25), 5) + 0.0 AS eccentricity_ratio
FROM worst k JOIN kindly USING (id) JOIN shape s ON s.w = kindly.w AND s.h = kindly.h AND s.kind = kindly.kind""", places=5)
def costa_rica(spark, sf):
    return shape.codigo_sismico_costa_rica(fx.shapes(spark, sf)).select("id", "eccentricity_ratio")


@query()
def eurocode_8_compat(spark, sf):
    return shape.eurocode_8(fx.shapes(spark, sf), mode="compat", axes="compat")


@query()
def gndt_beta_1(spark, sf):
    return shape.gndt_beta_1_main_shape_slenderness(fx.shapes(spark, sf))


@query(f"{RECTANGLE_SQL} SELECT id, {r6('l1 / l2', 'gndt_beta_3')} FROM best")
def gndt_beta_3(spark, sf):
    return shape.gndt_beta_3_footprint_slenderness(fx.shapes(spark, sf))


@query()
def gndt_beta_4(spark, sf):
    return shape.gndt_beta_4_eccentricity_ratio(fx.shapes(spark, sf))


#: The pockets' corners in order; their centroids by the shoelace formula; sections of the ring along both directions, crossings in order.
BETA6_SQL = f"""{RECTANGLE_SQL}, pocket(kind, k, i, a, b) AS (VALUES
  (1, 0, 0, 1, 0.5), (1, 0, 1, 0.5, 0.5), (1, 0, 2, 0.5, 1), (3, 0, 0, 0.75, 1), (3, 0, 1, 0.75, 0.5), (3, 0, 2, 0.25, 0.5), (3, 0, 3, 0.25, 1),
  (4, 0, 0, 0.75, 0), (4, 0, 1, 0.75, 0.5), (4, 0, 2, 1, 0.5), (4, 1, 0, 0, 0.5), (4, 1, 1, 0.25, 0.5), (4, 1, 2, 0.25, 0)
), turn AS (
  SELECT id, k, t1, a * w AS x1, b * h AS y1, coalesce(lead(a * w) OVER v, first_value(a * w) OVER v) AS x2, coalesce(lead(b * h) OVER v, first_value(b * h) OVER v) AS y2
  FROM best JOIN shape USING (id) JOIN pocket USING (kind) WINDOW v AS (PARTITION BY id, k ORDER BY i)
), centre AS (
  SELECT id, k, any_value(t1) AS t1, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy,
    max(x1 * cos(t1) + y1 * sin(t1)) - min(x1 * cos(t1) + y1 * sin(t1)) AS b1, max(y1 * cos(t1) - x1 * sin(t1)) - min(y1 * cos(t1) - x1 * sin(t1)) AS b2 FROM turn GROUP BY id, k
), way2 AS (SELECT *, t1 + d * pi() / 2 AS t FROM centre, (VALUES (0), (1)) v(d)
), side2 AS (
  SELECT p.id, k, d, (x1 - cx) * sin(t) - (y1 - cy) * cos(t) AS s1, (x2 - cx) * sin(t) - (y2 - cy) * cos(t) AS s2, (x1 - cx) * cos(t) + (y1 - cy) * sin(t) AS u1, (x2 - cx) * cos(t) + (y2 - cy) * sin(t) AS u2
  FROM way2 p JOIN edge e ON e.id = p.id AND ring = 0
), crossing AS (SELECT id, k, d, u1 + (u2 - u1) * s1 / (s1 - s2) AS u FROM side2 WHERE (s1 > 0) <> (s2 > 0)
), section AS (SELECT id, k, d, sum(CASE WHEN n % 2 = 0 THEN u ELSE -u END) AS c FROM (SELECT *, row_number() OVER (PARTITION BY id, k, d ORDER BY u) AS n FROM crossing) GROUP BY ALL
), worth AS (SELECT id, k, least(coalesce(max(c) FILTER (d = 1), 0) / (any_value(b1) + 1e-10), coalesce(max(c) FILTER (d = 0), 0) / (any_value(b2) + 1e-10)) AS r FROM centre LEFT JOIN section USING (id, k) GROUP BY id, k)"""


@query(f"{BETA6_SQL} SELECT id, {r6('coalesce(max(r), 0)', 'gndt_beta_6')} FROM shape LEFT JOIN worth USING (id) GROUP BY id")
def gndt_beta_6(spark, sf):
    return shape.gndt_beta_6_setback_slenderness(fx.shapes(spark, sf))


@query()
def slenderness_elevation(spark, sf):
    return shape.slenderness_elevation(fx.shapes(spark, sf))


@query(f"""WITH ec AS ({EC8_SQL}), sb AS ({POCKET_SQL} SELECT id, round(coalesce(max(least(b1 / l1, b2 / l2)), 0), 5) + 0.0 AS setback_ratio FROM shape LEFT JOIN reach USING (id) GROUP BY id), both_ AS (
  SELECT id, eccentricity_ratio, setback_ratio, slenderness, compactness, CASE WHEN slenderness > 4 THEN 'slenderness' WHEN setback_ratio > 0.2 THEN 'setbacks' WHEN eccentricity_ratio > 0.3 THEN 'eccentricity' ELSE 'regular' END AS fsi FROM ec JOIN sb USING (id)
) SELECT *, fsi = 'regular' AS regularity_boolean FROM both_""", places=5)
def footprint_irregularity(spark, sf):
    return shape.footprint_irregularity(fx.shapes(spark, sf))


#: Walls of axis-parallel rectangles of 10 by 8: a pair meets on at most one side, over the overlap of the other axis.
FORCES_SQL = f"""WITH {fx.BLOCKS_SQL}, wall AS (
  SELECT a.id, s.side, least(a.y + 8, b.y + 8) - greatest(a.y, b.y) AS n, (least(a.y + 8, b.y + 8) + greatest(a.y, b.y)) / 2 - a.y - 4 AS off
  FROM building a JOIN building b ON a.block = b.block AND a.id <> b.id JOIN (VALUES ('right', 10.0), ('left', -10.0)) s(side, d) ON abs(a.x + d - b.x) < {{gap}}
  UNION ALL
  SELECT a.id, s.side, least(a.x + 10, b.x + 10) - greatest(a.x, b.x), (least(a.x + 10, b.x + 10) + greatest(a.x, b.x)) / 2 - a.x - 5
  FROM building a JOIN building b ON a.block = b.block AND a.id <> b.id JOIN (VALUES ('top', 8.0), ('bottom', -8.0)) s(side, d) ON abs(a.y + d - b.y) < {{gap}}
), f AS (
  SELECT id, CASE side WHEN 'right' THEN -3 * n WHEN 'left' THEN 3 * n ELSE 0 END AS fx, CASE side WHEN 'top' THEN -3 * n WHEN 'bottom' THEN 3 * n ELSE 0 END AS fy,
    CASE side WHEN 'right' THEN 5 WHEN 'left' THEN -5 ELSE off END AS rx, CASE side WHEN 'top' THEN 4 WHEN 'bottom' THEN -4 ELSE off END AS ry
  FROM wall WHERE n > {{least}}
), s AS (
  SELECT *, sqrt(fx * fx + fy * fy) AS v, rx * fy - ry * fx AS c, sqrt(rx * rx + ry * ry) >= 0.5 * sqrt(80 / pi()) AS far,
    sum(fx) OVER w AS sx, sum(fy) OVER w AS sy FROM f WINDOW w AS (PARTITION BY id)
), t AS (
  SELECT id, sqrt(any_value(sx) ** 2 + any_value(sy) ** 2) AS total, sum(v) AS each,
    sum(CASE WHEN sx = 0 AND sy = 0 THEN 0 ELSE acos(greatest(-1, least(1, abs(fx * sx + fy * sy) / (v * sqrt(sx * sx + sy * sy))))) * v END) AS bend,
    sum(c) AS m0, sum(CASE WHEN far OR c <= 0 THEN c ELSE 0 END) AS m1, sum(CASE WHEN far OR c > 0 THEN c ELSE 0 END) AS m2
  FROM s GROUP BY id
), force AS (
  SELECT b.id, CASE WHEN t.id IS NOT NULL THEN 3.0::DOUBLE END AS height, coalesce(total / sqrt(80), 0) AS force, coalesce((each - total) / each, 0) AS confinement_ratio,
    coalesce(least(abs(m0), abs(m1), abs(m2)) * 80 / (80 * 164 / 12.0), 0) AS angular_acc, coalesce(2 * bend / each, 0) AS angle
  FROM building b LEFT JOIN t USING (id)
)"""
_FORCES = f"SELECT id, height, {r6('force', 'force')}, {r6('confinement_ratio', 'confinement_ratio')}, {r6('angular_acc', 'angular_acc')}, {r6('angle', 'angle')} FROM force"


@query(FORCES_SQL.format(gap=0.0002, least=0.001) + _FORCES)
def contact_forces(spark, sf):
    return position.contact_forces(fx.blocks(spark, sf))


@query(FORCES_SQL.format(gap=0.3, least=0.15) + _FORCES)
def contact_forces_buffer(spark, sf):
    return position.contact_forces(fx.blocks(spark, sf), buffer=0.15)


@query(FORCES_SQL.format(gap=0.0002, least=0.001) + """ SELECT id, CASE
  WHEN ((force > 0.166 AND angle > 0.78) OR confinement_ratio > 0.5) AND angular_acc > 2.133 THEN 'torque' WHEN confinement_ratio > 0.5 THEN 'confined'
  WHEN force > 0.166 AND angle > 0.78 THEN 'corner' WHEN force > 0.166 THEN 'lateral' ELSE 'isolated' END AS relative_position FROM force""")
def relative_position(spark, sf):
    return position.relative_position(position.contact_forces(fx.blocks(spark, sf))).select("id", "relative_position")


@query(f"WITH {fx.SHAPES_SQL} SELECT id, CAST(ring AS INT) AS ring, CAST(i AS INT) AS corner, {r6('x0 + x1', 'x')}, {r6('y0 + y1', 'y')} FROM edge JOIN shape USING (id)")
def wkt_round_trip(spark, sf):
    """Footprints written as WKT and parsed again: all corners."""
    text = fx.shapes(spark, sf).select("id", g.to_wkt(F.col("geometry")).alias("wkt"))
    rows = text.select("id", F.posexplode(g.rings(g.from_wkt(F.col("wkt")))).alias("ring", "r"))
    return rows.select("id", "ring", F.posexplode(F.slice("r", F.lit(1), F.size("r") - 1)).alias("corner", "p")).select("id", "ring", "corner", "p.x", "p.y")
