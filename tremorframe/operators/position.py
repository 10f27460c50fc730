"""Contact forces between neighbouring buildings and their relative position.

Walls in contact are found by a cell join: every edge enters the grid cells that its grown bounding box
touches, edges of different buildings meet in a cell, and nearly antiparallel ones within the gap cover an interval of each other. A pair is kept
in the one cell that holds the lower corner of both boxes' intersection, so no pair needs to be deduplicated. Intervals
merge per edge, as a stretch of wall counts once however many neighbours touch it. Both sides of each join grow with the buildings, and the planner
takes exploded edges for no larger than the file they come from, so all joins are by sorted shuffles, never by a broadcast through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Two walls touch within this gap in metres if no buffer is given; and may differ by this angle's sine.
TOUCH, PARALLEL = 2e-4, 0.05


def wall_edges(buildings: DataFrame) -> DataFrame:
    """(id, k, x1, y1, x2, y2, len) of all edges, exteriors counter-clockwise."""
    rows = buildings.select("id", F.posexplode(F.flatten(F.transform(g.rings(g.oriented(F.col("geometry"))), g.edges))).alias("k", "e"))
    return rows.select("id", "k", "e.*").withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("len > 0")


def contact_walls(buildings: DataFrame, buffer: float = 0.0, cell: float = 25.0) -> DataFrame:
    """(id, x1, y1, x2, y2): merged stretches of wall in contact with another building.

    Two walls touch if their gap is under 2 * ``buffer`` (a tolerance without one); stretches of up to
    max(buffer, 1 mm) are left out. ``cell`` is the grid's size, about a building's.
    """
    gap = max(2 * buffer, TOUCH)
    e = wall_edges(buildings)
    low = lambda a, b: F.floor((F.least(a, b) - gap) / cell)
    high = lambda a, b: F.floor((F.greatest(a, b) + gap) / cell)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    e = e.withColumns({"gx0": low(x1, x2), "gy0": low(y1, y2), "gx1": high(x1, x2), "gy1": high(y1, y2)})
    in_cells = e.withColumn("gx", F.explode(F.sequence("gx0", "gx1"))).withColumn("gy", F.explode(F.sequence("gy0", "gy1")))
    other = in_cells.select("gx", "gy", *(F.col(c).alias("o_" + c) for c in ("id", "x1", "y1", "x2", "y2", "len", "gx0", "gy0")))
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("len"), (F.col("y2") - F.col("y1")) / F.col("len")
    vx, vy = (F.col("o_x2") - F.col("o_x1")) / F.col("o_len"), (F.col("o_y2") - F.col("o_y1")) / F.col("o_len")
    away = lambda x, y: (F.col(x) - F.col("x1")) * uy - (F.col(y) - F.col("y1")) * ux
    along = lambda x, y: (F.col(x) - F.col("x1")) * ux + (F.col(y) - F.col("y1")) * uy
    met = in_cells.join(other.hint("merge"), ["gx", "gy"]).where((F.col("id") != F.col("o_id")) & (F.col("gx") == F.greatest("gx0", "o_gx0")) & (F.col("gy") == F.greatest("gy0", "o_gy0")))
    met = met.where((ux * vx + uy * vy < 0) & (F.abs(ux * vy - uy * vx) < PARALLEL))
    met = met.where((F.abs(away("o_x1", "o_y1")) < gap) & (F.abs(away("o_x2", "o_y2")) < gap))
    t0 = F.greatest(F.least(along("o_x1", "o_y1"), along("o_x2", "o_y2")), F.lit(0.0))
    t1 = F.least(F.greatest(along("o_x1", "o_y1"), along("o_x2", "o_y2")), F.col("len"))
    spans = met.select("id", "k", "x1", "y1", ux.alias("ux"), uy.alias("uy"), t0.alias("t0"), t1.alias("t1")).where("t1 > t0")
    w = Window.partitionBy("id", "k").orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("t0") <= reach, 0).otherwise(1)).over(w)
    merged = spans.withColumn("run", run).groupBy("id", "k", "run").agg(*(F.first(c).alias(c) for c in ("x1", "y1", "ux", "uy")), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    at = lambda o, u, t: F.col(o) + F.col(u) * F.col(t)
    return merged.where(F.col("t1") - F.col("t0") > max(buffer, 1e-3)).select("id", at("x1", "ux", "t0").alias("x1"), at("y1", "uy", "t0").alias("y1"), at("x1", "ux", "t1").alias("x2"), at("y1", "uy", "t1").alias("y2"))


def momentum(rx: Column, ry: Column, fx: Column, fy: Column, least: Column) -> list[Column]:
    """The four moments of a force: with a short lever arm only half of them count."""
    c, far = rx * fy - ry * fx, F.hypot(rx, ry) >= least
    return [c, F.when(far | (c <= 0), c).otherwise(0.0), F.when(far | (c > 0), c).otherwise(0.0), c]


def contact_forces(buildings: DataFrame, buffer: float = 0.0, height: str | None = "height", min_radius: float = 0.5, mode: str = "compat", cell: float = 25.0) -> DataFrame:
    """(id, height, force, confinement_ratio, angular_acc, angle) of every building.

    A wall in contact pushes along its inward (left) normal with length times height (1 per wall where the
    height is 0, as a normal without scale is a unit vector; length alone without a height column). ``compat`` divides confinement and angle by the
    sum of forces; ``documented`` divides them by the resultant, infinite where that vanishes.
    A building without contact has zeros and a null height.
    """
    h = F.coalesce(F.col(height).cast("double"), F.lit(0.0)) if height else F.lit(1.0)
    shaped = buildings.select("id", h.alias("h"), g.sums(F.col("geometry")).alias("s")).select("id", "h", g.measures_of(F.col("s")).alias("m")).select("id", "h", "m.area", "m.cx", "m.cy", "m.iz")
    walls = contact_walls(buildings.select("id", "geometry"), buffer, cell).join(shaped.hint("merge"), "id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    scale = F.when(F.col("h") == 0, 1 / F.hypot(dx, dy)).otherwise(F.col("h"))
    fx, fy = -dy * scale, dx * scale
    walls = walls.withColumns({"fx": fx, "fy": fy, "rx": (F.col("x1") + F.col("x2")) / 2 - F.col("cx"), "ry": (F.col("y1") + F.col("y2")) / 2 - F.col("cy")})
    moments = momentum(F.col("rx"), F.col("ry"), F.col("fx"), F.col("fy"), min_radius * F.sqrt(F.col("area") / math.pi))
    walls = walls.withColumns({f"m{i}": m for i, m in enumerate(moments)}).withColumn("f", F.hypot("fx", "fy"))
    # The resultant is needed by each wall's angle: a window over the same partitioning as the aggregate that follows.
    w = Window.partitionBy("id")
    walls = walls.withColumns({"sx": F.sum("fx").over(w), "sy": F.sum("fy").over(w)})
    # A resultant that is only rounding is none.
    some = F.hypot("sx", "sy") > 1e-9 * F.sum("f").over(w)
    walls = walls.withColumns({"sx": F.when(some, F.col("sx")).otherwise(0.0), "sy": F.when(some, F.col("sy")).otherwise(0.0)})
    bend = g.acute(F.col("fx"), F.col("fy"), F.col("sx"), F.col("sy"))
    fold = F.when(bend > math.pi / 2, math.pi - bend).otherwise(bend)
    total = walls.groupBy("id").agg(
        F.first("h").alias("height"), F.first("area").alias("area"), F.first("iz").alias("iz"), F.hypot(F.first("sx"), F.first("sy")).alias("resultant"), F.sum("f").alias("sum_f"),
        F.sum(F.col("f") * fold).alias("bend"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(4)),
    )
    base = F.col("sum_f") if mode == "compat" else F.col("resultant")
    ratio = lambda x: F.when(base > 0, x / base).otherwise(F.when(x > 0, float("inf")).otherwise(0.0))
    least = F.least(*(F.abs(F.col(f"m{i}")) for i in range(4)))
    forces = total.select(
        "id", "height", (F.col("resultant") / F.sqrt("area")).alias("force"), ratio(F.col("sum_f") - F.col("resultant")).alias("confinement_ratio"),
        (least * F.col("area") / F.col("iz")).alias("angular_acc"), ratio(2 * F.col("bend")).alias("angle"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return buildings.select("id").join(forces.hint("merge"), "id", "left").select("id", "height", *map(zero, ("force", "confinement_ratio", "angular_acc", "angle")))


def position_class(min_angular_acc: float = 2.133, min_confinement: float = 0.5, min_angle: float = 0.78, min_force: float = 0.166) -> Column:
    """torque, confined, corner, lateral or isolated: the last rule that holds, of increasing rank."""
    lateral = F.col("force") > min_force
    corner = lateral & (F.col("angle") > min_angle)
    confined = F.col("confinement_ratio") > min_confinement
    torque = (corner | confined) & (F.col("angular_acc") > min_angular_acc)
    return F.when(torque, "torque").when(confined, "confined").when(corner, "corner").when(lateral, "lateral").otherwise("isolated")


def relative_position(forces: DataFrame, **thresholds: float) -> DataFrame:
    """``contact_forces`` with the class in ``relative_position``."""
    return forces.withColumn("relative_position", position_class(**thresholds))
