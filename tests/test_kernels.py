import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.functions import geometry as g
from tremorframe.functions import kernels
from tremorframe.operators import learning, position, segmentation, shape


def star(r, n):
    """A simple ring: random radii by angle."""
    a = [2 * math.pi * (i + r.uniform(0, 0.4)) / n for i in range(n)]  # no gap of half a turn, so the ring is simple
    p = [(round(1000 + q * math.cos(t), 3), round(2000 + q * math.sin(t), 3)) for t in a for q in [r.uniform(3, 10)]]
    return [*p, p[0]]


def hull(points):
    p = sorted(set(points))
    half = []
    for side in (p, p[::-1]):
        out = []
        for q in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        half += out[:-1]
    return half


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def frame(spark, rings):
    rows = [(i, {"exterior": [{"x": x, "y": y} for x, y in r], "interiors": []} if r else None) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"id long, geometry {g.POLYGON}")


def test_hull_measures_equal_brute_force(spark):
    r = random.Random(2)
    rings = [star(r, r.choice([3, 4, 6, 9, 17, 40])) for _ in range(120)]
    rings += [x[::-1] for x in rings[:20]] + [None]
    got = {x.id: x.h for x in shape.with_hull(frame(spark, rings)).collect()}
    for i, ring in enumerate(rings[:-1]):
        h = hull(ring)
        best = min(np.ptp([x * c + y * s for x, y in h]) * np.ptp([y * c - x * s for x, y in h]) for (ax, ay), (bx, by) in zip(h, [*h[1:], h[0]]) for c, s in [np.array([bx - ax, by - ay]) / math.hypot(bx - ax, by - ay)])
        assert got[i].hull_area == pytest.approx(area(h), rel=1e-7)
        assert got[i].l1 * got[i].l2 == pytest.approx(best, rel=1e-7) and got[i].l1 >= got[i].l2 - 1e-9
        # Pockets add up to what the hull has over the ring.
        assert got[i].max_pocket <= area(h) - abs(area(ring)) + 1e-6 and (got[i].n_pockets > 0) == (area(h) - abs(area(ring)) > 1e-6)
    assert got[len(rings) - 1].hull_area is None


def test_inscribed_circle(spark):
    rings = [[(0, 0), (12, 0), (12, 5), (0, 5), (0, 0)], [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6), (0, 0)], [(0, 0), (3, 0), (0, 4), (0, 0)]]
    rows = frame(spark, [[(float(x), float(y)) for x, y in r] for r in rings]).select("id", kernels.inscribed_circle(F.col("geometry")["exterior"]).alias("k")).collect()
    got = {r.id: r.k.radius for r in rows}
    assert got[0] == pytest.approx(2.5, abs=1e-3) and got[2] == pytest.approx(1.0, abs=1e-3)
    assert got[1] == pytest.approx(4 - 2 * math.sqrt(2), abs=1e-3)  # touches both outer sides and the inner corner


def test_measures_of_square_and_hole(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]  # clockwise
    (m,) = shape.prepared(frame(spark, [square])).collect()
    assert (m.m.area, m.m.perimeter, m.m.cx, m.m.iz) == pytest.approx((1, 4, 0.5, 1 / 6))
    assert shape.inertia_circle(frame(spark, [square])).head().inertia_circle == pytest.approx(3 / (2 * math.pi))
    assert shape.polsby_popper(frame(spark, [square])).head().polsby_popper == pytest.approx(math.pi / 4)
    assert shape.prepared(frame(spark, [None])).head().m is None


def test_contact_of_two_squares(spark):
    unit = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    df = frame(spark, [unit(0.0), unit(1.0), unit(9.0)])
    got = {r.id: r for r in position.contact_forces(df, height=None).collect()}
    assert (got[0].force, got[0].confinement_ratio, got[0].angle) == pytest.approx((1, 0, 0)) and got[2].force == 0 and got[2].height is None
    assert {r.id: r.relative_position for r in position.relative_position(position.contact_forces(df, height=None)).collect()} == {0: "lateral", 1: "lateral", 2: "isolated"}


def test_hungarian_equals_brute_force():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 4), (4, 4), (5, 3), (6, 6)]:
        w = np.round(r.random((n, m)) * (r.random((n, m)) > 0.4), 3)
        rows, cols = segmentation.hungarian(w)
        best = max(sum(w[i, p[i]] if n <= m else w[p[i], i] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert w[rows, cols].sum() == pytest.approx(best)


def sorted_ap(jaccards, n_gt, n_pd, truncation=1.0):
    tp = len(jaccards)
    fn = n_gt - tp
    if tp == 0 and fn:
        return 0.0
    if n_pd == 0 and fn == 0:
        return 1.0
    curve = []
    for k, j in enumerate(sorted(jaccards)):
        value = (tp - k) / (n_pd + fn + k)
        curve.append((min(j, truncation), value))
        if j > truncation:
            break
    area, x0, y0 = 0.0, 0.0, curve[0][1]
    for x, y in curve:
        area, x0, y0 = area + (x - x0) * (y + y0) / 2, x, y
    return area + (1 - x0) * y0 / 2


def test_sorted_average_precision(spark):
    r = random.Random(6)
    rows = [(i, r.choice([0, 1, 2, 3]), g_) for i in range(6) for _ in range(120) for g_ in [r.choice([0, 1, 2, 3, 4])]]
    rows = [(i, a, a if r.random() < i / 6 else b) for i, a, b in rows] + [(10, 1, 0)] * 3 + [(11, 0, 0)] * 2 + [(12, 0, 1)] * 2
    px = spark.createDataFrame(rows, "image_id int, gt_label int, pd_label int")
    pairs = {}
    for p in segmentation.matched(segmentation.intersections(px), 0.001, "hungarian").collect():
        pairs.setdefault(p.image_id, []).append(p.jaccard)
    n = {i: (len({a for j, a, _ in rows if j == i} - {0}), len({b for j, _, b in rows if j == i} - {0})) for i in {x[0] for x in rows}}
    got = {x.image_id: x.sorted_ap for x in segmentation.sorted_average_precision(px, by_image=True).collect()}
    want = {i: sorted_ap(pairs.get(i, []), *n[i]) if n[i] != (0, 2) and not (n[i][0] == 0 and n[i][1]) else 0.0 for i in n}
    assert got == pytest.approx(want)
    every = [j for x in pairs.values() for j in x]
    for t in (1.0, 0.5, 0.2):
        got = segmentation.sorted_average_precision(px, truncation=t, buckets=7).head().sorted_ap
        assert got == pytest.approx(sorted_ap(every, sum(a for a, _ in n.values()), sum(b for _, b in n.values()), t))


def test_published_confusion_matrices(spark):
    """Macro-F1 and accuracy of a published matrix (rows: true class)."""
    matrix = [[18, 1, 4, 1], [2, 43, 25, 0], [14, 16, 213, 1], [0, 0, 5, 2]]
    rows = [(i, j) for i, r in enumerate(matrix) for j, n in enumerate(r) for _ in range(n)]
    s = learning.summary(learning.report(spark.createDataFrame(rows, "y_true int, y_pred int"))).head()
    assert (round(s.macro_f1, 4), round(s.accuracy, 4)) == (0.6284, 0.8)
    m = learning.confusion_matrix(spark.createDataFrame(rows, "y_true int, y_pred int"), [0, 1, 2, 3]).orderBy("y_true").collect()
    assert [list(r)[1:] for r in m] == matrix
