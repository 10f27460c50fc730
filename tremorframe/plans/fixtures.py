"""Synthetic inputs derived from the test tables: the same rule as columns and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to as many tasks as shuffles have: a small file is read in one task, which would then do all the work on what its rows become."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Corners as (share of width, share of height): rectangle, L, rectangle with a hole, U, T.
SHAPES = {
    0: [(0, 0), (1, 0), (1, 1), (0, 1)],
    1: [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)],
    2: [(0, 0), (1, 0), (1, 1), (0, 1)],
    3: [(0, 0), (1, 0), (1, 1), (0.75, 1), (0.75, 0.5), (0.25, 0.5), (0.25, 1), (0, 1)],
    4: [(0.25, 0), (0.75, 0), (0.75, 0.5), (1, 0.5), (1, 1), (0, 1), (0, 0.5), (0.25, 0.5)],
}
HOLE = [(0.375, 0.375), (0.375, 0.625), (0.625, 0.625), (0.625, 0.375)]


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, brand, height, geometry): one footprint a part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(k.alias("id"), F.col("p_brand").alias("brand"), (3 + s % 4 * 3).cast("double").alias("height"), (6 + s % 7).cast("double").alias("w"), (4 + s % 5).cast("double").alias("h"), (100.0 * (k % 100)).alias("x0"), (100.0 * F.floor(k / 100)).alias("y0"))
    at = lambda a, b: (F.col("x0") + a * F.col("w"), F.col("y0") + b * F.col("h"))
    ring = lambda corners: g.ring(*(at(a, b) for a, b in corners))
    shape = F.col("id") % 5
    exterior = F.when(shape == 0, ring(SHAPES[0]))
    for n, corners in list(SHAPES.items())[1:]:
        exterior = exterior.when(shape == n, ring(corners))
    holes = F.when(shape == 2, F.array(ring(HOLE))).otherwise(F.expr(f"cast(array() as array<{g.RING}>)"))
    return rows.select("id", "brand", "height", F.when(F.col("id").isNotNull(), F.struct(exterior.alias("exterior"), holes.alias("interiors"))).alias("geometry"))


def _corner_rows() -> str:
    rows = [(n, 0, i, a, b) for n, c in SHAPES.items() for i, (a, b) in enumerate(c)] + [(2, 1, i, a, b) for i, (a, b) in enumerate(HOLE)]
    return ", ".join(str(r) for r in rows)


#: CTEs: shape(id, brand, height, kind, w, h, x0, y0); edge(id, ring, i, x1, y1, x2, y2) in local coordinates, wound as above.
SHAPES_SQL = f"""
shape AS (
  SELECT p_partkey AS id, p_brand AS brand, CAST(3 + p_size % 4 * 3 AS DOUBLE) AS height, p_partkey % 5 AS kind,
    CAST(6 + p_size % 7 AS DOUBLE) AS w, CAST(4 + p_size % 5 AS DOUBLE) AS h,
    100.0::DOUBLE * (p_partkey % 100) AS x0, 100.0::DOUBLE * (p_partkey // 100) AS y0
  FROM part
), corner(kind, ring, i, a, b) AS (VALUES {_corner_rows()}),
side AS (
  SELECT kind, ring, i, CAST(a AS DOUBLE) AS a1, CAST(b AS DOUBLE) AS b1,
    CAST(coalesce(lead(a) OVER w, first_value(a) OVER w) AS DOUBLE) AS a2, CAST(coalesce(lead(b) OVER w, first_value(b) OVER w) AS DOUBLE) AS b2
  FROM corner WINDOW w AS (PARTITION BY kind, ring ORDER BY i)
), edge AS (
  SELECT id, ring, i, a1 * w AS x1, b1 * h AS y1, a2 * w AS x2, b2 * h AS y2 FROM shape JOIN side USING (kind)
)"""

#: Offsets of the four buildings of a block, by case: terrace, terrace with gaps, detached, corner, staggered.
BLOCKS = {
    0: [(0, 0), (10, 0), (20, 0), (30, 0)],
    1: [(0, 0), (10.1, 0), (20.2, 0), (30.3, 0)],
    2: [(0, 0), (20, 0), (40, 0), (60, 0)],
    3: [(0, 0), (10, 0), (0, 8), (30, 0)],
    4: [(0, 0), (10, 4), (-10, -4), (40, 0)],
}


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, height, geometry): rectangles of 10 by 8 in blocks of four."""
    k = F.col("p_partkey")
    b, slot = F.floor(k / 4), k % 4
    offset = F.create_map(*[x for c, o in BLOCKS.items() for s, (dx, dy) in enumerate(o) for x in (F.lit(c * 4 + s), F.struct(F.lit(float(dx)).alias("x"), F.lit(float(dy)).alias("y")))])
    o = offset[(b % 5 * 4 + slot).cast("int")]
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), (200.0 * (b % 50) + o["x"]).alias("x"), (200.0 * F.floor(b / 50) + o["y"]).alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select("id", F.lit(3.0).alias("height"), F.when(x.isNotNull(), g.polygon(g.ring((x, y), (x + 10, y), (x + 10, y + 8), (x, y + 8)))).alias("geometry"))


BLOCKS_SQL = f"""
place(kind, slot, dx, dy) AS (VALUES {", ".join(str((c, s, float(x), float(y))) for c, o in BLOCKS.items() for s, (x, y) in enumerate(o))}),
building AS (
  SELECT p_partkey AS id, p_partkey // 4 AS block, CAST(dx AS DOUBLE) AS x, CAST(dy AS DOUBLE) AS y
  FROM part JOIN place ON kind = (p_partkey // 4) % 5 AND slot = p_partkey % 4
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value) of each footprint's valid pixels: a footprint is a user, a pixel an event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster_id, row, col, value): rasters of suppliers."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("raster_id"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_orderkey") % 16).cast("int").alias("col"))
    return cells.agg(F.avg("l_quantity").cast("double").alias("value"))


GRID_SQL = """
grid AS (
  SELECT l_suppkey AS raster_id, CAST(l_linenumber AS INT) AS row, CAST(l_orderkey % 16 AS INT) AS col, CAST(avg(l_quantity) AS DOUBLE) AS value
  FROM lineitem GROUP BY ALL
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, height): terrain points of customers, 1,500 on each tile of 37 by 41, some of them far apart."""
    k = F.col("c_custkey")
    tile = F.floor(k / 1500)
    x, y = 60 * (tile % 10) + k % 37 + F.when(k % 97 == 0, 500).otherwise(0), 60 * F.floor(tile / 10) + k * 7 % 41
    # Halves as in the SQL: by the hundredfold double, where F.round goes by the decimal digits.
    cents = F.col("c_acctbal").cast("double") / 100 * 100
    height = F.signum(cents) * F.floor(F.abs(cents) + 0.5) / 100
    return table(spark, sf_dir, "customer").select(k.alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), height.alias("height"))


POINTS_SQL = """
pt AS (
  SELECT c_custkey AS id, CAST(60 * (c_custkey // 1500 % 10) + c_custkey % 37 + CASE WHEN c_custkey % 97 = 0 THEN 500 ELSE 0 END AS DOUBLE) AS x, CAST(60 * (c_custkey // 1500 // 10) + c_custkey * 7 % 41 AS DOUBLE) AS y, round(CAST(c_acctbal AS DOUBLE) / 100, 2) AS height
  FROM customer
)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, gt_label, pd_label) of each pixel: 0 is background."""
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("image_id"), (F.col("l_suppkey") % 5).cast("int").alias("gt_label"), (F.col("l_partkey") % 5).cast("int").alias("pd_label"))


MASKS_SQL = """
px AS (
  SELECT l_returnflag || l_linestatus AS image_id, CAST(l_suppkey % 5 AS INT) AS gt_label, CAST(l_partkey % 5 AS INT) AS pd_label FROM lineitem
)"""
