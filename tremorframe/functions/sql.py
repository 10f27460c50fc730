"""SQL functions over polygons, as temporary SQL functions: plain expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import POLYGON, RING

_TYPES = {"r": RING.replace("struct<x: double, y: double>", "STRUCT<x: DOUBLE, y: DOUBLE>"), "g": POLYGON}

_EDGES = "zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> {})"

#: Name: (parameters, type, body).
FUNCTIONS = {
    "ring_area": ("r", "DOUBLE", "abs(aggregate(" + _EDGES.format("(a.x - r[0].x) * (b.y - r[0].y) - (b.x - r[0].x) * (a.y - r[0].y)") + ", 0D, (s, c) -> s + c)) / 2"),
    "ring_perimeter": ("r", "DOUBLE", "aggregate(" + _EDGES.format("hypot(b.x - a.x, b.y - a.y)") + ", 0D, (s, c) -> s + c)"),
    "poly_area": ("g", "DOUBLE", "ring_area(g.exterior) - aggregate(transform(g.interiors, i -> abs(aggregate(zip_with(slice(i, 1, size(i) - 1), slice(i, 2, size(i) - 1), (a, b) -> (a.x - i[0].x) * (b.y - i[0].y) - (b.x - i[0].x) * (a.y - i[0].y)), 0D, (s, c) -> s + c)) / 2), 0D, (s, c) -> s + c)"),
    "poly_compactness": ("g", "DOUBLE", "4 * pi() * ring_area(g.exterior) / pow(ring_perimeter(g.exterior), 2)"),
    "position_class": (
        "force DOUBLE, confinement DOUBLE, angle DOUBLE, angular_acc DOUBLE",
        "STRING",
        "CASE WHEN ((force > 0.166 AND angle > 0.78) OR confinement > 0.5) AND angular_acc > 2.133 THEN 'torque' WHEN confinement > 0.5 THEN 'confined' WHEN force > 0.166 AND angle > 0.78 THEN 'corner' WHEN force > 0.166 THEN 'lateral' ELSE 'isolated' END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        declared = f"{parameters} {_TYPES[parameters]}" if parameters in _TYPES else parameters
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
