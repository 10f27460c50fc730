"""Plan-irregularity indices of building footprints.

Operators are ``DataFrame -> DataFrame`` keyed by ``id``: they need columns ``id`` and ``geometry`` and run
without a shuffle, one pass over the footprints. ``prepared`` computes what they share (edge sums,
principal axes, hull kernel) once; Catalyst prunes what an index doesn't use.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernels

#: A line's section counts as through a point within this distance in metres.
NEAR = 1e-3
#: Steps of the grid over directions, and of its refinements.
GRID, REFINE = 720, 40


def prepared(buildings: DataFrame, *columns: str, mode: str = "exact") -> DataFrame:
    """(id, geometry, m, f, p, *columns): ``measures`` of the footprint and of it filled, and its principal axes."""
    # The filled sums are those of the exterior alone.
    rows = buildings.select("id", F.col("geometry"), *columns, g.sums(F.col("geometry")).alias("s"), g.sums(g.filled(F.col("geometry"))).alias("sf"))
    rows = rows.select("id", "geometry", *columns, g.measures_of(F.col("s")).alias("m"), g.measures_of(F.col("sf")).alias("f"))
    return rows.withColumn("p", g.principal(F.col("m"), mode))


def polsby_popper(buildings: DataFrame, fill_holes: bool = True) -> DataFrame:
    """4 pi A / P^2: 1 for a circle."""
    m = F.col("f" if fill_holes else "m")
    return prepared(buildings).select("id", (4 * math.pi * m["area"] / m["perimeter"] ** 2).alias("polsby_popper"))


def inertia_slenderness(buildings: DataFrame, mode: str = "exact") -> DataFrame:
    """sqrt(I1 / I2) and the elongation's direction in degrees."""
    p = F.col("p")
    return prepared(buildings, mode=mode).select("id", F.sqrt(p["i1"] / p["i2"]).alias("inertia_slenderness"), F.degrees(g.folded(F.atan2(p["v1y"], p["v1x"]))).alias("direction"))


def along(r: Column, dx: Column, dy: Column) -> Column:
    """Extent of a ring along a unit direction."""
    u = F.transform(r, lambda q: q["x"] * dx + q["y"] * dy)
    return F.array_max(u) - F.array_min(u)


def circumscribed_slenderness(buildings: DataFrame, mode: str = "exact") -> DataFrame:
    """Ratio of the extents along the principal axes, at least 1, and the longer one's direction in degrees."""
    p, r = F.col("p"), F.col("geometry")["exterior"]
    rows = prepared(buildings, mode=mode).select("id", "p", along(r, p["v1x"], p["v1y"]).alias("a"), along(r, p["v2x"], p["v2y"]).alias("b"))
    first = F.col("a") >= F.col("b")
    angle = F.when(first, F.atan2(p["v1y"], p["v1x"])).otherwise(F.atan2(p["v2y"], p["v2x"]))
    return rows.select("id", (F.greatest("a", "b") / F.least("a", "b")).alias("circumscribed_slenderness"), F.degrees(g.folded(angle)).alias("direction"))


def with_hull(buildings: DataFrame, min_length: float = 0.0, min_area: float = 0.0, *columns: str) -> DataFrame:
    """(id, geometry, h, *columns) with ``hull_measures`` of the exterior."""
    return buildings.select("id", "geometry", *columns, kernels.hull_measures(F.col("geometry")["exterior"], min_length, min_area).alias("h"))


def min_bbox_slenderness(buildings: DataFrame) -> DataFrame:
    """Side ratio of the smallest rectangle around, and the direction of its shorter side in degrees."""
    h = F.col("h")
    return with_hull(buildings).select("id", (h["l1"] / h["l2"]).alias("min_bbox_slenderness"), F.degrees(g.folded(F.atan2(h["d1x"], -h["d1y"]))).alias("direction"))


def inertia_circle(buildings: DataFrame) -> DataFrame:
    """(pi r^4 / 4) / Iz for the circle of equal area: 0.5 for a circle, as Iz is the polar moment."""
    m = F.col("m")
    return prepared(buildings).select("id", (m["area"] ** 2 / (4 * math.pi) / m["iz"]).alias("inertia_circle"))


def compactness(buildings: DataFrame, mode: str = "compat") -> DataFrame:
    """``compat``: 1 - largest pocket / filled area. ``documented``: filled area / hull area."""
    h, area = F.col("h"), g.signed_area(F.col("geometry")["exterior"])
    value = 1 - h["max_pocket"] / F.abs(area) if mode == "compat" else F.abs(area) / h["hull_area"]
    return with_hull(buildings).select("id", value.alias("compactness"))


def convex_hull_momentum(buildings: DataFrame) -> DataFrame:
    """Length of the edges off the hull times their distance to it, by the hull's length; 0 if convex."""
    return with_hull(buildings).select("id", F.col("h")["hull_momentum"].alias("convex_hull_momentum"))


def setback_ratio(buildings: DataFrame, min_length: float = 0.0, min_area: float = 0.0) -> DataFrame:
    """Largest over pockets of the smaller ratio of pocket to rectangle along its two directions (ASCE 7 and NTC)."""
    return with_hull(buildings, min_length, min_area).select("id", F.col("h")["setback"].alias("setback_ratio"))


asce_7_setback_ratio = NTC_setback_ratio = setback_ratio


def gndt_beta_2_setback_ratio(buildings: DataFrame, min_length: float = 0.0, min_area: float = 0.0) -> DataFrame:
    """The same with the rectangle's sides crossed."""
    return with_hull(buildings, min_length, min_area).select("id", F.col("h")["crossed_setback"].alias("gndt_beta_2"))


def asce_7_hole_ratio(buildings: DataFrame) -> DataFrame:
    """Area of the holes by the filled area."""
    holes = F.aggregate(F.transform(F.col("geometry")["interiors"], lambda r: F.abs(g.signed_area(r))), F.lit(0.0), lambda a, x: a + x)
    return buildings.select("id", (holes / F.abs(g.signed_area(F.col("geometry")["exterior"]))).alias("hole_ratio"))


def asce_7_parallelity_angle(buildings: DataFrame) -> DataFrame:
    """Length-weighted mean angle in degrees between edges and the smallest rectangle's nearer side."""
    h = F.col("h")

    def bend(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        n = F.hypot(dx, dy)
        cos = F.when(n > 0, F.least(F.greatest(F.abs(dx * h["d1x"] + dy * h["d1y"]), F.abs(dy * h["d1x"] - dx * h["d1y"])) / n, F.lit(1.0))).otherwise(1.0)
        return F.struct((F.acos(cos) * n).alias("a"), n.alias("n"))

    bends = F.transform(F.flatten(F.transform(g.rings(F.col("geometry")), g.edges)), bend)
    total = F.aggregate(bends, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("n")), lambda s, b: F.struct((s["a"] + b["a"]).alias("a"), (s["n"] + b["n"]).alias("n")))
    return with_hull(buildings).select("id", total.alias("t")).select("id", F.degrees(F.col("t")["a"] / F.col("t")["n"]).alias("parallelity_angle"))


def NTC_hole_ratio(buildings: DataFrame, mode: str = "exact") -> DataFrame:  # noqa: N802
    """Largest over holes and principal axes of the hole's width by the footprint's section through its centroid; 0 without holes.

    A hole's width is the section less its solid part, but at least the side of the rectangle of its area with its slenderness.
    """
    rows = prepared(buildings, mode=mode).select("id", "geometry", "p", F.explode_outer(F.transform(F.col("geometry")["interiors"], lambda r: F.struct(r.alias("r"), g.sums(F.struct(r.alias("exterior"), F.slice(F.col("geometry")["interiors"], 1, 0).alias("interiors"))).alias("s")))).alias("hole"))
    rows = rows.select("id", "geometry", "p", F.col("hole.r").alias("r"), g.measures_of(F.col("hole.s")).alias("hm"))
    rows = rows.withColumn("hp", g.principal(F.col("hm"), mode))
    hm, hp, p, ext = F.col("hm"), F.col("hp"), F.col("p"), F.col("geometry")["exterior"]

    def ratio(vx: Column, vy: Column, slender: Column) -> Column:
        side = g.chord(ext, hm["cx"], hm["cy"], vx, vy)
        gaps = F.aggregate(F.transform(F.col("geometry")["interiors"], lambda r: g.chord(r, hm["cx"], hm["cy"], vx, vy)), F.lit(0.0), lambda a, x: a + x)
        return F.try_divide(F.greatest(gaps, F.sqrt(hm["area"] * slender)), side)

    slender = F.sqrt(hp["i2"] / hp["i1"])
    both = F.greatest(ratio(p["v2x"], p["v2y"], slender), ratio(p["v1x"], p["v1y"], 1 / slender))
    return rows.select("id", both.alias("v")).groupBy("id").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("ntc_hole_ratio"))


# Eccentricity codes --------------------------------------------------------------------------


def _direction(rows: DataFrame, power: int, mode: str) -> DataFrame:
    """Adds ``x``: the direction in the principal frame where the squared (Costa Rica: fourth power of the) eccentricity by torsional radius is largest.

    ``documented``: of all directions, a grid refined around its best. ``compat``: uphill from 0. A kernel over batches: a lambda over
    a grid of directions would evaluate its other columns once per direction.
    """

    def value(x: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        across = c - r * np.cos(2 * x)
        return np.cos(x - b) ** power * (across if power == 2 else across / (c + r * np.cos(2 * x)))

    @F.pandas_udf("double")
    def best(bs: pd.Series, cs: pd.Series, rs: pd.Series) -> pd.Series:
        b, c, r = (s.to_numpy(float)[:, None] for s in (bs, cs, rs))
        if mode == "documented":
            x, width = np.full(b.shape, math.pi / 2), math.pi / 2
            steps = np.arange(-GRID // 2, GRID // 2) / (GRID // 2)
            for _ in range(4):
                at = x + steps * width
                x = np.take_along_axis(at, value(at, b, c, r).argmax(1)[:, None], 1)
                width, steps = width * 4 / len(steps), np.arange(-REFINE, REFINE + 1) / REFINE
            return pd.Series(x[:, 0])
        x = np.zeros(b.shape)
        step = np.where(value(x + 1e-4, b, c, r) >= value(x - 1e-4, b, c, r), 1.0, -1.0) * math.pi / GRID
        for _ in range(40):
            for _ in range(GRID):
                up = value(x + step, b, c, r) > value(x, b, c, r)
                if not up.any():
                    break
                x = np.where(up, x + step, x)
            step = -step / 2
        return pd.Series(x[:, 0])

    return rows.withColumn("x", F.when(F.col("e") > 1e-10, best("b", "c", "r")).otherwise(0.0))


def eurocode_8(buildings: DataFrame, mode: str = "documented", axes: str = "exact") -> DataFrame:
    """Eccentricity and torsional radius ratios, slenderness and compactness, and the two directions in degrees.

    The eccentricity vector runs from the walls' centroid to the centre of mass; the worst direction for
    eccentricity / torsional radius is taken (``documented``: of all; ``compat``: the one found uphill from the major axis).
    """
    return _eurocode_8(buildings, mode, axes).drop("h")


def _eurocode_8(buildings: DataFrame, mode: str = "documented", axes: str = "exact") -> DataFrame:
    """``eurocode_8`` and its ``hull_measures`` in ``h``."""
    m, p = F.col("m"), F.col("p")
    rows = prepared(buildings, mode=axes).withColumn("h", kernels.hull_measures(F.col("geometry")["exterior"]))
    ex, ey = m["mx"] - m["bx"], m["my"] - m["by"]
    b = F.atan2(p["v1x"] * ey - p["v1y"] * ex, p["v1x"] * ex + p["v1y"] * ey)
    rows = rows.select("id", "m", "p", "h", F.col("f")["area"].alias("filled"), F.hypot(ex, ey).alias("e"), b.alias("b"), p["centre"].alias("c"), p["radius"].alias("r"), F.atan2(p["v1y"], p["v1x"]).alias("v1"))
    rows = _direction(rows, 2, mode)
    x, e, c, r = F.col("x"), F.col("e"), F.col("c"), F.col("r")
    torsional = F.sqrt((m["iz"] + m["area"] * e * e) / (c - r * F.cos(2 * x)))
    return rows.select(
        "id", (e * F.abs(F.cos(x - F.col("b"))) / torsional).alias("eccentricity_ratio"), (torsional / F.sqrt(m["iz"] / m["area"])).alias("radius_ratio"),
        F.sqrt(p["i1"] / p["i2"]).alias("slenderness"), (1 - F.col("h")["max_pocket"] / F.col("filled")).alias("compactness"),
        F.degrees(-g.folded(F.col("v1") + x)).alias("angle_eccentricity"), F.degrees(-g.folded(F.col("v1"))).alias("angle_slenderness"), "h",
    )


def codigo_sismico_costa_rica(buildings: DataFrame, mode: str = "documented", axes: str = "exact") -> DataFrame:
    """Eccentricity by the dimension of the plan, from the area centroid to the centre of mass, in the worst direction."""
    m, p = F.col("m"), F.col("p")
    ex, ey = m["mx"] - m["cx"], m["my"] - m["cy"]
    b = F.atan2(p["v1x"] * ey - p["v1y"] * ex, p["v1x"] * ex + p["v1y"] * ey)
    rows = prepared(buildings, mode=axes).select("id", "m", F.hypot(ex, ey).alias("e"), b.alias("b"), p["centre"].alias("c"), p["radius"].alias("r"), F.atan2(p["v1y"], p["v1x"]).alias("v1"))
    rows = _direction(rows, 4, mode)
    x, e, c, r = F.col("x"), F.col("e"), F.col("c"), F.col("r")
    dimension = F.sqrt(m["area"]) * F.pow((c + r * F.cos(2 * x)) / (c - r * F.cos(2 * x)), 0.25)
    return rows.select("id", (e * F.abs(F.cos(x - F.col("b"))) / dimension).alias("eccentricity_ratio"), F.degrees(-g.folded(F.col("v1") + x + math.pi / 2)).alias("angle_eccentricity"))


# GNDT ------------------------------------------------------------------------------------------


def basic_lengths(buildings: DataFrame, *columns: str) -> DataFrame:
    """(id, geometry, h, a, l, ax, ay, *columns): main shape a (side of the largest inscribed square) and total length l of the worse pair of
    rectangle side and inscribed extent; (ax, ay) is the direction of a."""
    rows = with_hull(buildings, 0.0, 0.0, *columns).withColumn("k", kernels.inscribed_circle(F.col("geometry")["exterior"]))
    k, h = F.col("k"), F.col("h")
    reach = k["radius"] * (2 - math.cos(math.pi / 32)) + 1e-3

    def meet(e: Column) -> Column:
        dx, dy, fx, fy = e["x2"] - e["x1"], e["y2"] - e["y1"], e["x1"] - k["cx"], e["y1"] - k["cy"]
        a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - reach * reach
        root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
        t = F.filter(F.array((-b - root) / a, (-b + root) / a), lambda t: (t >= 0) & (t <= 1))
        return F.when((a > 0) & (b * b > a * c), F.transform(t, lambda t: F.struct((fx + t * dx).alias("x"), (fy + t * dy).alias("y")))).otherwise(F.expr(f"cast(array() as {g.RING})"))

    rows = rows.withColumn("q", F.flatten(F.transform(g.edges(F.col("geometry")["exterior"]), meet)))
    rows = rows.withColumns({"a1": along(F.col("q"), h["d1x"], h["d1y"]), "a2": along(F.col("q"), -h["d1y"], h["d1x"])})
    first = F.col("a1") * h["l2"] > F.col("a2") * h["l1"]
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return rows.select("id", "geometry", *columns, "h", pick(F.col("a1"), F.col("a2")).alias("a"), pick(h["l2"], h["l1"]).alias("l"), pick(h["d1x"], -h["d1y"]).alias("ax"), pick(h["d1y"], h["d1x"]).alias("ay"))


def gndt_beta_1_main_shape_slenderness(buildings: DataFrame) -> DataFrame:
    return basic_lengths(buildings).select("id", (F.col("a") / F.col("l")).alias("gndt_beta_1"))


def gndt_beta_3_footprint_slenderness(buildings: DataFrame) -> DataFrame:
    return min_bbox_slenderness(buildings).select("id", F.col("min_bbox_slenderness").alias("gndt_beta_3"))


def gndt_beta_4_eccentricity_ratio(buildings: DataFrame) -> DataFrame:
    """Signed eccentricity (centre of mass from the walls' centroid) along the main shape's direction, by a."""
    rows = basic_lengths(buildings).withColumn("s", g.sums(F.col("geometry"))).withColumn("m", g.measures_of(F.col("s")))
    m = F.col("m")
    return rows.select("id", (((m["mx"] - m["bx"]) * F.col("ax") + (m["my"] - m["by"]) * F.col("ay")) / F.col("a")).alias("gndt_beta_4"))


def gndt_beta_6_setback_slenderness(buildings: DataFrame, min_length: float = 0.0, min_area: float = 0.0, mode: str = "documented") -> DataFrame:
    """Largest over pockets of min(c1 / b1, c2 / b2): c is the footprint's length on the line through the pocket's centroid, c1 along the
    smallest rectangle's shorter side and c2 along the longer, b the pocket's extents; 0 without pockets.

    ``compat`` counts only sections within 1 mm of the centroid, which lies outside the footprint, so it is 0 but for pockets thinner than that.
    Pockets with an extent under ``min_length`` count 0, and all do if 1 - area / hull area <= ``min_area``.
    """
    ext = F.col("geometry")["exterior"]
    rows = with_hull(buildings).withColumn("k", kernels.pockets(ext)).select("id", "geometry", "h", "k", F.abs(g.signed_area(ext)).alias("area"))
    h = F.col("h")

    def section(p: Column, dx: Column, dy: Column) -> Column:
        length = g.chord(ext, p["cx"], p["cy"], dx, dy)
        return length if mode == "documented" else F.when(F.least(p["b1"], p["b2"]) < 2 * NEAR, length).otherwise(0.0)

    def ratio(p: Column) -> Column:
        value = F.least(section(p, -h["d1y"], h["d1x"]) / (p["b1"] + 1e-10), section(p, h["d1x"], h["d1y"]) / (p["b2"] + 1e-10))
        return F.when(F.least(p["b1"], p["b2"]) >= min_length, value).otherwise(0.0)

    worst = F.coalesce(F.array_max(F.transform("k", ratio)), F.lit(0.0))
    full = 1 - F.col("area") / h["hull_area"] <= min_area
    return rows.select("id", F.when(F.col("geometry").isNotNull(), F.when(full, 0.0).otherwise(worst)).alias("gndt_beta_6"))


# Classes -----------------------------------------------------------------------------------------


def slenderness_elevation(buildings: DataFrame) -> DataFrame:
    """Height by the side of the main shape."""
    return basic_lengths(buildings, "height").select("id", (F.col("height") / F.col("a")).alias("slenderness_elevation"))


def fsi_class(eccentricity: Column, setback: Column, slenderness: Column, limits: tuple[float, float, float] = (0.3, 0.2, 4.0)) -> Column:
    """Footprint shape class: regular, overridden by eccentricity, then setbacks, then slenderness (the last that holds)."""
    return F.when(slenderness > limits[2], "slenderness").when(setback > limits[1], "setbacks").when(eccentricity > limits[0], "eccentricity").otherwise("regular")


def footprint_irregularity(buildings: DataFrame) -> DataFrame:
    """The indices' values and the class of each footprint (``fsi``), and whether it is regular. One pass: both indices read the same hull."""
    rows = _eurocode_8(buildings).where("id is not null").withColumn("setback_ratio", F.col("h")["setback"])
    cls = fsi_class(F.col("eccentricity_ratio"), F.col("setback_ratio"), F.col("slenderness"))
    return rows.select("id", "eccentricity_ratio", "setback_ratio", "slenderness", "compactness", cls.alias("fsi"), (cls == "regular").alias("regularity_boolean"))
