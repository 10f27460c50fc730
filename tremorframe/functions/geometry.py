"""Polygon measures as column expressions.

A ring is ``array<struct<x: double, y: double>>``, closed (first point = last point). A polygon is
``struct<exterior: ring, interiors: array<ring>>``. Nothing here shuffles or leaves the JVM: sums run
over a ring's edges in local coordinates (relative to its first vertex), so large map coordinates
lose no precision. Null or empty polygons give nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"
RING = f"array<{POINT}>"
POLYGON = f"struct<exterior: {RING}, interiors: array<{RING}>>"

_SUMS = ("a", "sx", "sy", "xx", "yy", "xy", "p", "bx", "by")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*xy: tuple[Column, Column]) -> Column:
    """A closed ring of the given corners."""
    return F.array(*(point(x, y) for x, y in [*xy, xy[0]]))


def polygon(exterior: Column, *interiors: Column) -> Column:
    holes = F.array(*interiors) if interiors else F.expr(f"cast(array() as array<{RING}>)")
    return F.struct(exterior.alias("exterior"), holes.alias("interiors"))


def edges(r: Column) -> Column:
    """Array of (x1, y1, x2, y2)."""
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def rings(g: Column) -> Column:
    return F.concat(F.array(g["exterior"]), g["interiors"])


def signed_area(r: Column) -> Column:
    """Positive for a counter-clockwise ring."""
    o = F.try_element_at(r, F.lit(1))
    return F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + (e["x1"] - o["x"]) * (e["y2"] - o["y"]) - (e["x2"] - o["x"]) * (e["y1"] - o["y"])) / 2


def oriented(g: Column) -> Column:
    """Counter-clockwise exterior, clockwise holes."""
    turn = lambda r, ccw: F.when((signed_area(r) > 0) == F.lit(ccw), r).otherwise(F.reverse(r))
    return F.when(g.isNotNull(), F.struct(turn(g["exterior"], True).alias("exterior"), F.transform(g["interiors"], lambda r: turn(r, False)).alias("interiors")))


def filled(g: Column) -> Column:
    """Without its holes."""
    return F.when(g.isNotNull(), F.struct(g["exterior"].alias("exterior"), F.slice(g["interiors"], 1, 0).alias("interiors")))


def _ring_sums(r: Column, ox: Column, oy: Column) -> Column:
    """Edge sums of a ring, its winding made positive."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in _SUMS))

    def step(s: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        c, n = x1 * y2 - x2 * y1, F.hypot(x2 - x1, y2 - y1)
        add = {
            "a": c, "sx": (x1 + x2) * c, "sy": (y1 + y2) * c, "xx": (x1 * x1 + x1 * x2 + x2 * x2) * c, "yy": (y1 * y1 + y1 * y2 + y2 * y2) * c,
            "xy": (x1 * y2 + 2 * x1 * y1 + 2 * x2 * y2 + x2 * y1) * c, "p": n, "bx": (x1 + x2) / 2 * n, "by": (y1 + y2) / 2 * n,
        }
        return F.struct(*((s[k] + v).alias(k) for k, v in add.items()))

    def finish(s: Column) -> Column:
        sign = F.signum(s["a"])
        return F.struct(*((s[k] * (sign if k not in ("p", "bx", "by") else 1)).alias(k) for k in _SUMS))

    return F.aggregate(edges(r), zero, step, finish)


def sums(g: Column) -> Column:
    """Struct of a polygon's edge sums: holes count negative in areas and moments, positive in lengths."""
    o = F.try_element_at(g["exterior"], F.lit(1))
    each = F.transform(rings(g), lambda r, i: F.struct(_ring_sums(r, o["x"], o["y"]).alias("s"), F.when(i == 0, 1.0).otherwise(-1.0).alias("w")))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in _SUMS))
    total = F.aggregate(each, zero, lambda t, e: F.struct(*((t[k] + e["s"][k] * (1.0 if k in ("p", "bx", "by") else e["w"])).alias(k) for k in _SUMS)))
    # As a CASE the optimizer keeps it one column, instead of copying the sums into each use of a field.
    return F.when(g["exterior"].isNotNull(), F.struct(total.alias("t"), o["x"].alias("ox"), o["y"].alias("oy")))


def measures_of(s: Column) -> Column:
    """Measures from a column of ``sums`` (put that in a column of its own first, so that it is computed once)."""
    t = s["t"]
    area = t["a"] / 2
    cx, cy = t["sx"] / (3 * t["a"]), t["sy"] / (3 * t["a"])
    bx, by = t["bx"] / t["p"], t["by"] / t["p"]
    ixx, iyy, ixy = t["xx"] / 12 - area * cx * cx, t["yy"] / 12 - area * cy * cy, t["xy"] / 24 - area * cx * cy
    # Walls weigh three metres of floor a metre of length.
    mass = area + 3 * t["p"]
    mx, my = (area * cx + 3 * t["bx"]) / mass, (area * cy + 3 * t["by"]) / mass
    place = lambda x, y: [s["ox"] + x, s["oy"] + y]
    values = [area, t["p"], *place(cx, cy), *place(bx, by), *place(mx, my), ixx, iyy, ixy, ixx + iyy]
    names = ["area", "perimeter", "cx", "cy", "bx", "by", "mx", "my", "ixx", "iyy", "ixy", "iz"]
    return F.when(t["a"] != 0, F.struct(*(v.alias(k) for k, v in zip(names, values, strict=True))))


def measures(g: Column) -> Column:
    """Area, perimeter (all rings), area centroid (cx, cy), boundary centroid (bx, by), centre of mass of floor and walls
    (mx, my), central moments ixx (of x squared), iyy, ixy, and the polar moment iz."""
    return measures_of(sums(g))


def principal(m: Column, mode: str = "exact") -> Column:
    """Principal moments i1 >= i2 of ``measures``, and the unit axes (v1x, v1y) along the elongation and (v2x, v2y) across.

    ``compat`` mirrors the axis if ixx < iyy and takes the product of inertia without its sign.
    """
    ixy = F.abs(m["ixy"]) if mode == "compat" else m["ixy"]
    half, centre = (m["ixx"] - m["iyy"]) / 2, (m["ixx"] + m["iyy"]) / 2
    r = F.sqrt(half * half + ixy * ixy)
    angle = F.atan2(ixy, half) / 2
    if mode == "compat":
        p, q = F.abs(F.cos(angle)), F.abs(F.sin(angle))
        first = m["ixx"] >= m["iyy"]
        v = [F.when(first, p).otherwise(-p), -q, -q, F.when(first, -p).otherwise(p)]
    else:
        v = [F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle)]
    return F.when(m.isNotNull(), F.struct((centre + r).alias("i1"), (centre - r).alias("i2"), centre.alias("centre"), r.alias("radius"), *(x.alias(k) for x, k in zip(v, ("v1x", "v1y", "v2x", "v2y"), strict=True))))


def folded(angle: Column) -> Column:
    """An angle in radians as the direction of an axis, in (-pi/2, pi/2]."""
    a = F.pmod(angle, F.lit(math.pi))
    return F.when(a > math.pi / 2, a - math.pi).otherwise(a)


def wrapped(angle: Column) -> Column:
    """An angle in radians in (-pi, pi]."""
    a = F.pmod(angle, F.lit(2 * math.pi))
    return F.when(a > math.pi, a - 2 * math.pi).otherwise(a)


def acute(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The angle between two vectors in radians, 0 for a null vector."""
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(n > 0, F.acos(F.greatest(F.least((ax * bx + ay * by) / n, F.lit(1.0)), F.lit(-1.0)))).otherwise(0.0)


def bounds(r: Column) -> Column:
    x, y = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def chord(r: Column, px: Column, py: Column, dx: Column, dy: Column) -> Column:
    """Length of a ring's section along the line through (px, py) with unit direction (dx, dy): all its inside pieces."""
    cuts = F.filter(
        F.transform(
            edges(r),
            lambda e: F.struct(
                ((e["x1"] - px) * dy - (e["y1"] - py) * dx).alias("s1"), ((e["x2"] - px) * dy - (e["y2"] - py) * dx).alias("s2"),
                ((e["x1"] - px) * dx + (e["y1"] - py) * dy).alias("t1"), ((e["x2"] - px) * dx + (e["y2"] - py) * dy).alias("t2"),
            ),
        ),
        lambda c: (c["s1"] > 0) != (c["s2"] > 0),
    )
    t = F.array_sort(F.transform(cuts, lambda c: c["t1"] + (c["t2"] - c["t1"]) * c["s1"] / (c["s1"] - c["s2"])))
    return F.aggregate(F.transform(t, lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0.0), lambda a, v: a + v)


def covers(r: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring (crossing rule: lower and left edges belong to it)."""
    n = F.size(F.filter(edges(r), lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))))
    return n % 2 == 1


def inside(g: Column, x: Column, y: Column) -> Column:
    return covers(g["exterior"], x, y) & ~F.exists(g["interiors"], lambda r: covers(r, x, y))


# Text and binary forms -----------------------------------------------------------------------


def from_wkt(text: Column) -> Column:
    """POLYGON (with or without z, which is dropped) as a polygon; other kinds and nulls give null."""
    rows = F.split(F.regexp_replace(F.regexp_extract(text, r"(?is)^\s*POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\((.*)\)\s*\)\s*$", 1), r"\s+", " "), r" ?\) ?, ?\( ?")
    as_ring = lambda r: F.transform(F.split(r, " ?, ?"), lambda p: point(F.split(F.trim(p), " ")[0], F.split(F.trim(p), " ")[1]))
    every = F.transform(rows, as_ring)
    return F.when(text.rlike(r"(?is)^\s*POLYGON\s*(ZM|Z|M)?\s*\(\s*\("), F.struct(every[0].alias("exterior"), F.slice(every, F.lit(2), F.size(every)).alias("interiors")))


def polygons_from_wkt(text: Column) -> Column:
    """Array of polygons of a POLYGON (one) or MULTIPOLYGON (one a part), z and m dropped; other kinds, EMPTY and nulls give an empty array."""
    multi = r"(?is)^\s*MULTIPOLYGON\s*(?:ZM|Z|M)?\s*\(\s*\(\s*\((.*)\)\s*\)\s*\)\s*$"
    single = r"(?is)^\s*POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\((.*)\)\s*\)\s*$"
    body = F.when(text.rlike(multi), F.regexp_extract(text, multi, 1)).when(text.rlike(single), F.regexp_extract(text, single, 1))
    number = lambda p, k: F.element_at(F.split(F.trim(p), r"\s+"), k)
    as_ring = lambda r: F.transform(F.split(r, r"\s*,\s*"), lambda p: point(number(p, 1), number(p, 2)))

    def one(part: Column) -> Column:
        every = F.transform(F.split(part, r"\)\s*,\s*\("), as_ring)
        return F.struct(F.element_at(every, 1).alias("exterior"), F.slice(every, F.lit(2), F.size(every)).alias("interiors"))

    return F.coalesce(F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), one), F.expr(f"cast(array() as array<{POLYGON}>)"))


def to_wkt(g: Column) -> Column:
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    as_text = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", "), F.lit(")"))
    return F.when(g.isNotNull(), F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings(g), as_text), ", "), F.lit(")")))


def from_geojson(geometry: Column) -> Column:
    """``struct<type: string, coordinates: array<array<array<double>>>>`` of type Polygon."""
    every = F.transform(geometry["coordinates"], lambda r: F.transform(r, lambda p: point(p[0], p[1])))
    return F.when(geometry["type"] == "Polygon", F.struct(every[0].alias("exterior"), F.slice(every, F.lit(2), F.size(every)).alias("interiors")))


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)), F.lit(1)).cast("int")


# WGS84 ellipsoid and UTM constants.
_A, _F, _K0, _E0, _N0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """Point (x, y) in metres of degrees on WGS84: Krueger's series to the order 4 (under a millimetre inside a zone)."""
    n = _F / (2 - _F)
    scale = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4,
    ]
    phi, dlon = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return point(_E0 + _K0 * scale * x, F.when(south, _N0).otherwise(0.0) + _K0 * scale * y)


def projected(g: Column, zone: Column, south: Column) -> Column:
    """A polygon of degrees in metres of one UTM zone."""
    turn = lambda r: F.transform(r, lambda p: to_utm(p["x"], p["y"], zone, south))
    return F.when(g.isNotNull(), F.struct(turn(g["exterior"]).alias("exterior"), F.transform(g["interiors"], turn).alias("interiors")))
