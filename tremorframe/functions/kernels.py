"""Ring kernels that built-in functions can't express: hull, smallest rectangle, pockets, inscribed circle.

They take a ring as two arrays of doubles (Arrow batches) and work on padded matrices, all
rings of a batch at once, so Python runs a few dozen numpy calls per vertex position and none
per ring. Rings of similar size are padded together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HULL = "hull_area double, hull_perimeter double, l1 double, l2 double, d1x double, d1y double, n_pockets int, max_pocket double, setback double, crossed_setback double, hull_momentum double"
CIRCLE = "cx double, cy double, radius double"


def padded(x: pd.Series, y: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, x, y, corners) for rings of similar size: local coordinates without the closing point, counter-clockwise, padded by the last corner."""
    n = np.array([0 if v is None else max(len(v) - 1, 0) for v in x])
    size = np.where(n >= 3, 1 << np.ceil(np.log2(np.maximum(n, 4))).astype(int), 0)
    for s in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == s)
        k = n[rows]
        at = np.minimum(np.arange(s)[None, :], k[:, None] - 1)
        base = np.cumsum(k + 1) - (k + 1)
        gx, gy = (np.concatenate([np.asarray(v.iloc[r], float) for r in rows])[base[:, None] + at] for v in (x, y))
        gx, gy = gx - gx[:, :1], gy - gy[:, :1]
        turn = cross_sum(gx, gy) < 0
        back = np.maximum(k[:, None] - 1 - np.arange(s)[None, :], 0)
        for g in (gx, gy):
            g[turn] = np.take_along_axis(g[turn], back[turn], 1)
            g[turn] = np.take_along_axis(g[turn], at[turn], 1)
        yield rows, gx, gy, k


def cross_sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed area (repeated corners at the end add nothing)."""
    return (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)


def on_hull(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which corners lie on the convex hull, corners within its edges included (gift wrapping of all rings at once)."""
    rows, s = x.shape
    every = np.arange(rows)
    tol = 1e-9 * (1 + np.abs(x).max(1) + np.abs(y).max(1)) ** 2
    real = np.arange(s)[None, :] < n[:, None]
    start = np.lexsort((np.where(real, y, np.inf), np.where(real, x, np.inf)), axis=1)[:, 0]
    hull = np.zeros((rows, s), bool)
    now, live = start.copy(), np.ones(rows, bool)
    for _ in range(s + 1):
        px, py = x[every, now][:, None], y[every, now][:, None]
        dx, dy = x - px, y - py
        d2 = np.where(real, dx * dx + dy * dy, 0)
        # The next corner is the one that no other lies to the right of; of several in line the farthest.
        best = d2.argmax(1)
        for k in range(s):
            c = dx[every, best] * dy[:, k] - dy[every, best] * dx[:, k]
            better = real[:, k] & (d2[:, k] > 0) & ((c < -tol) | ((np.abs(c) <= tol) & (d2[:, k] > d2[every, best]) & (dx[:, k] * dx[every, best] + dy[:, k] * dy[every, best] > 0)))
            best = np.where(better, k, best)
        bx, by = dx[every, best][:, None], dy[every, best][:, None]
        length = np.sqrt(bx * bx + by * by)
        t = dx * bx + dy * by
        near = (np.abs(bx * dy - by * dx) <= np.maximum(tol[:, None], 1e-6 * length)) & (t >= 0) & (t <= length * length * (1 + 1e-12))
        hull |= near & real & live[:, None]
        now = np.where(live, best, now)
        live &= now != start
        if not live.any():
            break
    return hull


def extents(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the corners' spread along a unit direction and across it."""
    u, v = x * dx[:, None] + y * dy[:, None], y * dx[:, None] - x * dy[:, None]
    return np.ptp(u, axis=1), np.ptp(v, axis=1)


def smallest_rectangle(x: np.ndarray, y: np.ndarray, hull: np.ndarray) -> tuple[np.ndarray, ...]:
    """(longer side, shorter side, unit direction of the longer): over hull edges, ties by the smaller angle."""
    rows, s = x.shape
    best = np.full((rows, 5), np.inf)
    last = np.where(hull, np.arange(s), -1).max(1)
    every = np.arange(rows)
    px, py = x[every, last], y[every, last]
    for k in range(s):
        ex, ey = x[:, k] - px, y[:, k] - py
        n = np.hypot(ex, ey)
        ok = hull[:, k] & (n > 1e-12)
        dx, dy = np.where(ok, ex / np.where(ok, n, 1), 1.0), np.where(ok, ey / np.where(ok, n, 1), 0.0)
        a, b = extents(x, y, dx, dy)
        swap = b > a + 1e-9
        dx, dy = np.where(swap, -dy, dx), np.where(swap, dx, dy)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        angle = np.mod(np.arctan2(dy, dx), np.pi)
        angle = np.where(np.abs(a - b) <= 1e-9, np.mod(angle, np.pi / 2), angle)
        angle = np.where(angle > np.pi - 1e-9, 0.0, angle)
        area = a * b
        tie = np.abs(area - best[:, 0]) <= 1e-9 * (1 + area)
        better = ok & ((~tie & (area < best[:, 0])) | (tie & (angle < best[:, 1] - 1e-9)))
        best[better] = np.stack([area, angle, a, b, angle], 1)[better]
        px, py = np.where(hull[:, k], x[:, k], px), np.where(hull[:, k], y[:, k], py)
    return best[:, 2], best[:, 3], np.cos(best[:, 4]), np.sin(best[:, 4])


def _hull_batch(x: np.ndarray, y: np.ndarray, n: np.ndarray, min_length: float, min_area: float) -> np.ndarray:
    rows, s = x.shape
    hull = on_hull(x, y, n)
    every = np.arange(rows)
    # Start at a hull corner, so that no pocket runs over the end.
    first = hull.argmax(1)
    at = (first[:, None] + np.arange(s)) % n[:, None]
    at[np.arange(s)[None, :] >= n[:, None]] = 0
    at = np.where(np.arange(s)[None, :] >= n[:, None], first[:, None], at)
    x, y, hull = (np.take_along_axis(v, at, 1) for v in (x, y, hull))
    l1, l2, d1x, d1y = smallest_rectangle(x, y, hull)
    area = cross_sum(x, y) / 2
    hull_area, hull_len = np.zeros(rows), np.zeros(rows)
    px, py = x[:, 0].copy(), y[:, 0].copy()
    sx, sy = px.copy(), py.copy()  # the hull corner before the pocket
    total, moment, chord_sum = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    u = x * d1x[:, None] + y * d1y[:, None]
    v = y * d1x[:, None] - x * d1y[:, None]
    lo_u, hi_u, lo_v, hi_v = u[:, 0].copy(), u[:, 0].copy(), v[:, 0].copy(), v[:, 0].copy()
    count, biggest, ratio, crossed = np.zeros(rows, int), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    inside = np.zeros(rows, bool)
    # Distances of a pocket's edge midpoints to its chord need the chord's end: find it for each position.
    nxt = np.full(rows, 0)
    ends = np.zeros((rows, s), int)
    for k in range(s - 1, -1, -1):
        ends[:, k] = nxt
        nxt = np.where(hull[:, k], k, nxt)
    for k in range(1, s + 1):
        j = k % s
        cx, cy, h = x[:, j], y[:, j], hull[:, j]
        e = ends[:, k - 1]
        qx, qy = x[every, e] - sx, y[every, e] - sy
        mx, my = (px + cx) / 2 - sx, (py + cy) / 2 - sy
        q2 = np.maximum(qx * qx + qy * qy, 1e-18)
        t = np.clip((mx * qx + my * qy) / q2, 0, 1)
        gap = np.hypot(mx - t * qx, my - t * qy)
        off = inside | ~h
        moment += np.where(off, np.hypot(cx - px, cy - py) * gap, 0)
        total += np.where(off, px * cy - cx * py, 0)
        lo_u, hi_u, lo_v, hi_v = np.minimum(lo_u, u[:, j]), np.maximum(hi_u, u[:, j]), np.minimum(lo_v, v[:, j]), np.maximum(hi_v, v[:, j])
        # A hull corner ends the pocket, if there is one, and starts anew.
        hull_area += np.where(h, sx * cy - cx * sy, 0)
        hull_len += np.where(h, np.hypot(cx - sx, cy - sy), 0)
        end = h & inside
        pocket = np.abs(total + cx * sy - sx * cy) / 2
        count += end
        biggest = np.where(end, np.maximum(biggest, pocket), biggest)
        b1, b2 = hi_u - lo_u, hi_v - lo_v
        void = (b1 < min_length) | (b2 < min_length)
        b1, b2 = np.where(void, 0, b1), np.where(void, 0, b2)
        ratio = np.where(end, np.maximum(ratio, np.minimum(b1 / l1, b2 / l2)), ratio)
        crossed = np.where(end, np.maximum(crossed, np.minimum(b1 / l2, b2 / l1)), crossed)
        total = np.where(h, 0, total)
        for low, value in ((lo_u, u[:, j]), (hi_u, u[:, j]), (lo_v, v[:, j]), (hi_v, v[:, j])):
            low[:] = np.where(h, value, low)
        inside = ~h
        sx, sy = np.where(h, cx, sx), np.where(h, cy, sy)
        px, py = cx, cy
    hull_area /= 2
    full = 1 - area / hull_area <= min_area
    ratio, crossed = np.where(full, 0, ratio), np.where(full, 0, crossed)
    return np.stack([hull_area, hull_len, l1, l2, d1x, d1y, count, biggest, ratio, crossed, moment / hull_len], 1)


def _rows(x: pd.Series, y: pd.Series, names: list[str], work: Callable[..., np.ndarray]) -> pd.DataFrame:
    out = np.full((len(x), len(names)), np.nan)
    for rows, gx, gy, n in padded(x, y):
        out[rows] = work(rows, gx, gy, n)
    frame = pd.DataFrame(out, columns=names)
    return frame.astype(object).where(frame.notna(), None)


def hull_measures(exterior: Column, min_length: float = 0.0, min_area: float = 0.0) -> Column:
    """Struct of a ring's hull area and perimeter, smallest rectangle (l1 >= l2, unit direction d1 of l1), number of pockets
    (areas between hull and ring), the largest one's area, the setback ratio max(min(b1/l1, b2/l2)) over pockets
    with extents b along the rectangle's directions, the same with l1 and l2 crossed, and the hull momentum.

    Pockets with an extent under ``min_length`` count 0, and all do if 1 - area / hull area <= ``min_area``.
    """
    names = [c.split()[0] for c in HULL.split(", ")]

    @F.pandas_udf(HULL)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = _rows(x, y, names, lambda rows, gx, gy, n: _hull_batch(gx, gy, n, min_length, min_area))
        return out.assign(n_pockets=out.n_pockets.astype("Int32"))

    return run(F.transform(exterior, lambda p: p["x"]), F.transform(exterior, lambda p: p["y"]))


def pockets(exterior: Column) -> Column:
    """Array of a ring's pockets, the areas between it and its hull: area, centroid (cx, cy), extents b1 and b2 along the smallest rectangle's directions."""

    def of_ring(x: np.ndarray, y: np.ndarray, hull: np.ndarray, d: tuple[float, float]) -> list[dict]:
        n, out = len(x), []
        corners = np.flatnonzero(hull)
        for a, b in zip(corners, np.append(corners[1:], corners[0] + n), strict=True):
            if b - a < 2:
                continue
            at = np.arange(a, b + 1) % n
            px, py = x[at], y[at]
            c = px * np.roll(py, -1) - np.roll(px, -1) * py
            if abs(c.sum()) < 1e-12:
                continue
            u, v = px * d[0] + py * d[1], py * d[0] - px * d[1]
            centre = [float(((p + np.roll(p, -1)) * c).sum() / (3 * c.sum())) for p in (px, py)]
            out.append({"area": float(abs(c.sum()) / 2), "cx": centre[0], "cy": centre[1], "b1": float(np.ptp(u)), "b2": float(np.ptp(v))})
        return out

    @F.pandas_udf("array<struct<area: double, cx: double, cy: double, b1: double, b2: double>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = [None] * len(x)
        for rows, gx, gy, n in padded(x, y):
            hull = on_hull(gx, gy, n)
            _, _, dx, dy = smallest_rectangle(gx, gy, hull)
            for k, r in enumerate(rows):
                found = of_ring(gx[k, : n[k]], gy[k, : n[k]], hull[k, : n[k]], (dx[k], dy[k]))
                for p in found:
                    p["cx"], p["cy"] = p["cx"] + x.iloc[r][0], p["cy"] + y.iloc[r][0]
                out[r] = found
        return pd.Series(out, dtype=object)

    return run(F.transform(exterior, lambda p: p["x"]), F.transform(exterior, lambda p: p["y"]))


def _distance(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of points (rows x points) to the rings, negative outside."""
    inside = np.zeros(px.shape, bool)
    best = np.full(px.shape, np.inf)
    for k in range(x.shape[1]):
        x1, y1, x2, y2 = (v[:, None] for v in (x[:, k - 1], y[:, k - 1], x[:, k], y[:, k]))
        dx, dy = x2 - x1, y2 - y1
        t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.maximum(dx * dx + dy * dy, 1e-18), 0, 1)
        best = np.minimum(best, np.hypot(px - x1 - t * dx, py - y1 - t * dy))
        cut = (y1 > py) != (y2 > py)
        inside ^= cut & (px < x1 + (py - y1) * dx / np.where(dy == 0, 1, dy))
    return np.where(inside, best, -best)


def _circle_batch(x: np.ndarray, y: np.ndarray, grid: int = 16, keep: int = 4, rounds: int = 18) -> np.ndarray:
    x0, y0 = x.min(1), y.min(1)
    w, h = np.ptp(x, axis=1), np.ptp(y, axis=1)
    step = (np.arange(grid) + 0.5) / grid
    px = x0[:, None] + w[:, None] * np.repeat(step, grid)
    py = y0[:, None] + h[:, None] * np.tile(step, grid)
    d = _distance(px, py, x, y)
    top = np.argsort(-d, axis=1)[:, :keep]
    cx, cy, r = (np.take_along_axis(v, top, 1) for v in (px, py, d))
    span_x, span_y = w / grid, h / grid
    offsets = [(a, b) for a in (-1, -0.5, 0, 0.5, 1) for b in (-1, -0.5, 0, 0.5, 1) if a or b]
    for _ in range(rounds):
        base_x, base_y = cx.copy(), cy.copy()
        for a, b in offsets:
            qx, qy = base_x + a * span_x[:, None], base_y + b * span_y[:, None]
            q = _distance(qx, qy, x, y)
            better = q > r
            cx, cy, r = np.where(better, qx, cx), np.where(better, qy, cy), np.where(better, q, r)
        span_x, span_y = span_x * 0.55, span_y * 0.55
    best = r.argmax(1)[:, None]
    return np.hstack([np.take_along_axis(v, best, 1) for v in (cx, cy, r)])


def inscribed_circle(exterior: Column) -> Column:
    """Struct (cx, cy, radius) of a ring's largest inscribed circle: a grid, its four best cells refined (about 1e-4 of the ring's size)."""

    @F.pandas_udf(CIRCLE)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        def work(rows: np.ndarray, gx: np.ndarray, gy: np.ndarray, n: np.ndarray) -> np.ndarray:
            out = _circle_batch(gx, gy)
            out[:, 0] += [x.iloc[r][0] for r in rows]
            out[:, 1] += [y.iloc[r][0] for r in rows]
            return out

        return _rows(x, y, ["cx", "cy", "radius"], work)

    return run(F.transform(exterior, lambda p: p["x"]), F.transform(exterior, lambda p: p["y"]))
