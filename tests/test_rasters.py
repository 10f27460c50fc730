"""Roof parts and setbacks in elevation against hand-made buildings and plain versions."""

import itertools
import random

import numpy as np
import pytest

from tremorframe.functions import geometry as g
from tremorframe.operators import raster


def flood(values):
    """Sets of equal neighbours, by walking."""
    seen, sets = set(), []
    for start in itertools.product(range(values.shape[0]), range(values.shape[1])):
        if start in seen or values[start] < 0:
            continue
        todo, own = [start], {start}
        while todo:
            r, c = todo.pop()
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < values.shape[0] and 0 <= q[1] < values.shape[1] and q not in own and values[q] == values[start]:
                    own.add(q)
                    todo.append(q)
        seen |= own
        sets.append(own)
    return sets


def test_components_and_sieve():
    r = np.random.default_rng(4)
    for _ in range(40):
        values = r.integers(-1, 3, (r.integers(1, 9), r.integers(1, 9)))
        labels = raster.components(values)
        sets = flood(values)
        assert {frozenset(map(tuple, np.argwhere(labels == k).tolist())) for k in np.unique(labels[labels >= 0])} == set(map(frozenset, sets))
        layers = values.copy()
        done = raster.sieved(layers, 4)
        assert ((layers < 0) == (values < 0)).all() and (raster.components(layers) == done).all()
        for own in flood(layers):
            near = {(a + x, b + y) for a, b in own for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0))} - own
            alone = all(not (0 <= a < values.shape[0] and 0 <= b < values.shape[1]) or values[a, b] < 0 for a, b in near)
            assert len(own) >= 4 or alone
        # Large sets keep their layer.
        for own in sets:
            if len(own) >= 4:
                assert all(layers[q] == values[q] for q in own)


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def test_outlines_cover_their_pixels():
    r = np.random.default_rng(7)
    for _ in range(60):
        mask = np.zeros((7, 7), bool)
        for q in max(flood(r.integers(0, 2, (7, 7))), key=len):
            mask[q] = True
        rings = raster.outlines(mask)
        assert all(ring[0] == ring[-1] for ring in rings)
        assert abs(area(rings[0])) - sum(abs(area(x)) for x in rings[1:]) == mask.sum()
        polygon = [np.array([(c, a) for a, c in ring], float) for ring in rings]
        for a, c in itertools.product(range(7), range(7)):
            assert raster._contains(polygon, c + 0.5, a + 0.5) == mask[a, c]


def pixels(spark, values, ident=1):
    return [(ident, a, c, float(v) if v is not None else None) for a, row in enumerate(values) for c, v in enumerate(row)]


def test_two_towers_are_two_parts(spark):
    values = np.full((10, 20), 5.0)
    values[2:5, 2:6] = 15
    values[2:5, 12:16] = 15
    values[8, 3] = 15  # one square metre: sieved
    values[:, :1] = 3
    df = spark.createDataFrame(pixels(spark, values), "id int, row int, col int, value double")
    parts = sorted((p.area, p.part) for p in raster.roof_parts(df).collect())
    towers = [p for p in raster.roof_parts(df).collect() if p.area == 12]
    assert len(towers) == 2 and len({p.height for p in towers}) == 1 and 13 < towers[0].height < 15
    assert {min(q["x"] for q in p.geometry["exterior"]) for p in towers} == {2.0, 12.0} and {max(q["y"] for q in p.geometry["exterior"]) for p in towers} == {-2.0}
    assert parts[-1][0] == 200 - 24 - 10 and all(p.area >= 4 for p in raster.roof_parts(df).collect())


def rectangle(x0, y0, x1, y1):
    return {"exterior": [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))], "interiors": []}


def test_setback_by_hand(spark):
    schema = f"id long, geometry {g.POLYGON}, building_height double, ground_altitude double"
    buildings = spark.createDataFrame([(1, rectangle(0, 0, 20, 10), 30.0, 0.0), (2, rectangle(0, 0, 20, 10), 30.0, 0.0), (3, rectangle(0, 0, 20, 10), 30.0, 40.0), (4, rectangle(0, 0, 20, 10), None, 0.0), (5, rectangle(0, 0, 9, 9), 9.0, 0.0)], schema)
    low, tower = rectangle(4, 0, 20, 10), rectangle(0, 0, 4, 10)
    parts = [(1, 5.0, low), (1, 30.0, tower), (2, 5.0, low), (2, 15.0, tower), (3, 5.0, low), (3, 30.0, tower), (4, 1.0, low)]
    parts += [(6, 5.0, rectangle(0, 0, 20, 8)), (6, 30.0, rectangle(8, 8, 12, 10))]
    got = {r.id: r.elevation_setback for r in raster.setback_elevation(buildings, spark.createDataFrame(parts, f"id long, height double, geometry {g.POLYGON}")).collect()}
    # The section through the tower is 20 long, 16 of it outside; the drop of 25 is more than those, one of 10 is less.
    assert got[1] == pytest.approx(0.8) and got[2] == 0 and got[4] is None and got[5] == 0
    # The part starts under the lower 15 % of the building.
    assert got[3] == pytest.approx(2.4)


def test_symmetric_setback(spark):
    """A tower in the middle of one side: across it the outside lies evenly around."""
    foot, base, tower = (raster._rings(x) for x in (rectangle(0, 0, 20, 10), rectangle(0, 0, 20, 8), rectangle(8, 8, 12, 10)))
    parts = [(5.0, [np.array([(0, 0), (20, 0), (20, 10), (12, 10), (12, 8), (8, 8), (8, 10), (0, 10), (0, 0)], float)]), (40.0, tower)]
    assert raster.part_setback(foot, parts, 1, True, 1.0, 1.0, 5 / 3) == pytest.approx(16 / 20 * 5 / 3)
    assert raster.part_setback(foot, parts, 1, False, 1.0, 1.0, 5 / 3) == pytest.approx(8 / 10)
    assert raster.part_setback(foot, [(5.0, base), (40.0, tower)], 0, False, 1.0, 1.0, 5 / 3) == 0


def test_setback_of_holes_of_different_corners(spark):
    def polygon(exterior, *interiors):
        return {"exterior": [{"x": float(x), "y": float(y)} for x, y in exterior], "interiors": [[{"x": float(x), "y": float(y)} for x, y in r] for r in interiors]}

    block = [(0, 0), (20, 0), (20, 10), (0, 10), (0, 0)]
    square, bend = [(2, 1), (6, 1), (6, 5), (2, 5), (2, 1)], [(12, 3), (16, 3), (16, 7), (14, 7), (14, 6), (12, 6), (12, 3)]
    yards = [(15, 8), (16, 9), (17, 8), (15, 8)], [(18, 1), (19, 1), (19, 2), (18, 2), (18, 1)]
    schema = f"id long, geometry {g.POLYGON}, building_height double, ground_altitude double"
    buildings = spark.createDataFrame([(1, polygon(block), 30.0, 0.0), (2, polygon(block, *yards), 30.0, 0.0)], schema)
    parts = [(1, 5.0, polygon(block, square, bend)), (1, 30.0, polygon(square)), (1, 8.0, polygon(bend))]
    parts += [(2, 5.0, polygon([(4, 0), (20, 0), (20, 10), (4, 10), (4, 0)], *yards)), (2, 30.0, polygon([(0, 0), (4, 0), (4, 10), (0, 10), (0, 0)]))]
    got = {r.id: r.elevation_setback for r in raster.setback_elevation(buildings, spark.createDataFrame(parts, f"id long, height double, geometry {g.POLYGON}")).collect()}
    # Both sections through the high parts are 20 long, 16 of it outside; the bend's drop of 3 is less than what lies outside it.
    assert got[1] == pytest.approx(0.8) and got[2] == pytest.approx(0.8)
