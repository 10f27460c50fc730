"""Heights from raster pixels, in long form: one row a pixel, ``(id, value)`` or ``(raster_id, row, col, value)``; nodata is null."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def histogram(pixels: DataFrame, bins: int, key: str = "id") -> DataFrame:
    """(key, bin, n, share, lo, hi, width) of equal bins over each key's range, the last one closed; empty bins included.

    A single value fills the middle of a range of width 1 around it.
    """
    valid = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    ends = valid.groupBy(key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(key, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total", (F.col("hi") - F.col("lo")).alias("range"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = valid.join(ends, key).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = every.join(counts, [key, "bin"], "left").fillna(0, ["n"])
    width = (F.col("hi") - F.col("lo")) / bins
    return rows.select(key, "bin", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), "range")


def peaks(bins: DataFrame, sentinel: str, key: str = "id", least: Column | None = None) -> DataFrame:
    """The bins that are peaks: strictly above both neighbours (of a plateau the middle), at least mean + population std of the shares.

    ``sentinel`` "after" adds an empty neighbour after the last bin, "before" one before the first; the other border is never a peak.
    """
    w = Window.partitionBy(key).orderBy("bin")
    rows = bins.withColumn("run", F.sum(F.when(F.col("share") == F.lag("share").over(w), 0).otherwise(1)).over(w))
    stats = Window.partitionBy(key)
    rows = rows.withColumns({"floor": F.avg("share").over(stats) + F.stddev_pop("share").over(stats), "last": F.max("bin").over(stats)})
    runs = rows.groupBy(key, "run").agg(F.first("share").alias("share"), F.min("bin").alias("from"), F.max("bin").alias("to"), F.first("floor").alias("floor"), F.first("last").alias("last"))
    w = Window.partitionBy(key).orderBy("run")
    before = F.coalesce(F.lag("share").over(w), F.lit(-1.0) if sentinel == "before" else F.lit(float("inf")))
    after = F.coalesce(F.lead("share").over(w), F.lit(-1.0) if sentinel == "after" else F.lit(float("inf")))
    ok = (F.col("share") > before) & (F.col("share") > after) & (F.col("share") >= (F.col("floor") if least is None else least))
    return runs.where("true").withColumn("ok", ok).where("ok").select(key, F.floor((F.col("from") + F.col("to")) / 2).cast("int").alias("bin"))


def peak_height(pixels: DataFrame, kind: str = "roof", resolution: float = 1.0, bins: int = 5) -> DataFrame:
    """(id, altitude): median of the pixels strictly inside the highest peak bin (of roof: sentinel after; of ground: before).

    Without a peak: the median of all if their range is under ten times the resolution, else null.
    """
    h = histogram(pixels, bins)
    top = peaks(h, "after" if kind == "roof" else "before").groupBy("id").agg(F.max("bin").alias("bin"))
    edge = h.join(top, ["id", "bin"]).select("id", "lo", "hi")
    valid = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    spread = h.groupBy("id").agg(F.first("range").alias("range"))
    rows = valid.join(spread, "id").join(edge, "id", "left")
    use = F.when(F.col("lo").isNull(), F.when(F.col("range") < 10 * resolution, F.col("value"))).when((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")), F.col("value"))
    return rows.groupBy("id").agg(F.median(use).alias("altitude"))


def trimmed_steepness(gradients: DataFrame, key: str = "id") -> DataFrame:
    """(key, steepness): mean of the gradient magnitudes below mean + population std."""
    limit = gradients.groupBy(key).agg((F.avg("gradient") + F.stddev_pop("gradient")).alias("limit"))
    return gradients.join(limit, key).groupBy(key).agg(F.avg(F.when(F.col("gradient") < F.col("limit"), F.col("gradient"))).alias("steepness"))


def gradient(grid: DataFrame, dx: float = 1.0, dy: float = 1.0, key: str = "raster_id") -> DataFrame:
    """Adds gx, gy and gradient: central differences inside, one-sided at an edge or beside nodata, null without a neighbour."""

    def along(order: str, other: str, step: float) -> Column:
        w = Window.partitionBy(key, other).orderBy(order)
        near = lambda f, k: F.when(f(order).over(w) == F.col(order) + k, f("value").over(w))
        a, b, v = near(F.lag, -1), near(F.lead, 1), F.col("value")
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * step)).when(b.isNotNull(), (b - v) / step).when(a.isNotNull(), (v - a) / step)

    rows = grid.withColumn("gx", along("col", "row", dx)).withColumn("gy", along("row", "col", dy))
    return rows.withColumn("gradient", F.sqrt(F.coalesce(F.col("gx"), F.lit(0.0)) ** 2 + F.coalesce(F.col("gy"), F.lit(0.0)) ** 2))


def height_data(dsm: DataFrame, dtm: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, roof_altitude, ground_altitude, height, roof_steepness, ground_steepness) from surface and terrain pixels of each footprint.

    Steepness needs pixels with ``row`` and ``col``; it is null for those without.
    """
    one = None
    for pixels, kind in ((dsm, "roof"), (dtm, "ground")):
        rows = peak_height(pixels, kind, resolution).withColumnRenamed("altitude", f"{kind}_altitude")
        if {"row", "col"} <= set(pixels.columns):
            steep = trimmed_steepness(gradient(pixels.where(F.col("value").isNotNull()), resolution, resolution, "id"))
            rows = rows.join(steep.withColumnRenamed("steepness", f"{kind}_steepness"), "id", "left")
        else:
            rows = rows.withColumn(f"{kind}_steepness", F.lit(None).cast("double"))
        one = rows if one is None else one.join(rows, "id", "full")
    return one.select("id", "roof_altitude", "ground_altitude", (F.col("roof_altitude") - F.col("ground_altitude")).alias("height"), "roof_steepness", "ground_steepness")


def clip(grid: DataFrame, footprints: DataFrame, x0: float, y0: float, size: float, tile: int = 64, all_touched: bool = False) -> DataFrame:
    """(id, row, col, value): pixels of a raster whose centre lies in a footprint (or whose box meets its bounds, ``all_touched``).

    Pixels and footprints' bounds meet in tiles of ``tile`` pixels, so the join is an equi-join, by a sorted shuffle: both sides grow. Rows run downwards from y0.
    """
    b = g.bounds(F.col("geometry")["exterior"])
    cell = lambda v: F.floor(v / size).cast("int")
    shapes = footprints.select("id", "geometry", F.when(F.col("id").isNotNull(), b).alias("b")).select("id", "geometry", cell(F.col("b.x0") - x0).alias("c0"), cell(F.col("b.x1") - x0).alias("c1"), cell(y0 - F.col("b.y1")).alias("r0"), cell(y0 - F.col("b.y0")).alias("r1"))
    shapes = shapes.withColumn("tc", F.explode(F.sequence(F.floor(F.col("c0") / tile), F.floor(F.col("c1") / tile)))).withColumn("tr", F.explode(F.sequence(F.floor(F.col("r0") / tile), F.floor(F.col("r1") / tile))))
    pixels = grid.select("row", "col", "value", F.floor(F.col("col") / tile).alias("tc"), F.floor(F.col("row") / tile).alias("tr"))
    met = pixels.join(shapes.hint("merge"), ["tc", "tr"]).where("col between c0 and c1 and row between r0 and r1")
    if not all_touched:
        met = met.where(g.inside(F.col("geometry"), x0 + (F.col("col") + 0.5) * size, y0 - (F.col("row") + 0.5) * size))
    return met.select("id", "row", "col", "value")


def extent(grid: DataFrame, x0: float, y0: float, size: float, key: str = "raster_id") -> DataFrame:
    """(key, rows, cols, n, nodata, x_min, y_min, x_max, y_max): a raster's metadata from its pixels; rows run downwards from y0."""
    out = grid.groupBy(key).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nodata"))
    return out.select(key, (F.col("r1") - F.col("r0") + 1).alias("rows"), (F.col("c1") - F.col("c0") + 1).alias("cols"), "n", "nodata", (x0 + F.col("c0") * size).alias("x_min"), (y0 - (F.col("r1") + 1) * size).alias("y_min"), (x0 + (F.col("c1") + 1) * size).alias("x_max"), (y0 - F.col("r0") * size).alias("y_max"))


def resampled(grid: DataFrame, scale: float, key: str = "raster_id") -> DataFrame:
    """(key, row, col, value): the raster with pixels ``scale`` times as large, bilinear between the four pixels around each new centre.

    Beyond the outer centres the nearest pixels count; nodata has no weight. Both sides meet in an equi-join on the pixel: a new pixel asks four.
    """
    ends = grid.groupBy(key).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    count = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a) + 1) / scale), F.lit(1)).cast("int")
    new = ends.withColumn("row", F.explode(F.sequence(F.lit(0), count("r0", "r1") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), count("c0", "c1") - 1)))
    # Centres in the old raster's numbers.
    at = lambda c, low, high: F.greatest(F.least((F.col(c) + 0.5) * scale - 0.5 + F.col(low), F.col(high).cast("double")), F.col(low).cast("double"))
    new = new.withColumns({"y": at("row", "r0", "r1"), "x": at("col", "c0", "c1")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1))))
    asks = new.withColumn("d", corner).select(key, "row", "col", "x", "y", (F.floor("y") + F.col("d.dr")).cast("int").alias("r"), (F.floor("x") + F.col("d.dc")).cast("int").alias("c"))
    weight = (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c")))
    asks = asks.withColumn("w", weight).where("w > 0")
    old = grid.where(F.col("value").isNotNull()).select(key, F.col("row").alias("r"), F.col("col").alias("c"), "value")
    met = asks.join(old, [key, "r", "c"], "left")
    seen = F.sum(F.when(F.col("value").isNotNull(), F.col("w")))
    return met.groupBy(key, "row", "col").agg((F.sum(F.col("w") * F.col("value")) / seen).alias("value"))


def by_window(pixels: DataFrame, function: Callable[[np.ndarray], dict], schema: str, key: str = "id") -> DataFrame:
    """``function`` of each footprint's pixels as a matrix (NaN where there is none): a row (key, *schema) each. A footprint's pixels meet in one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["row"] - frame["row"].min(), frame["col"] - frame["col"].min()
        values = np.full((r.max() + 1, c.max() + 1), np.nan)
        values[r, c] = frame["value"]
        return pd.DataFrame([{key: frame[key].iloc[0], **function(values)}])

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.select(key, "row", "col", "value").groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def roof_layers(pixels: DataFrame, bins: int = 20, least: float = 0.01, mode: str = "documented") -> DataFrame:
    """(id, marks): the heights at which layers start, between the peaks of a histogram; a peak holds at least ``least`` of the pixels.

    A layer starts above its peak bin's lower edge (``compat``: one bin lower).
    """
    h = histogram(pixels, bins)
    start = F.col("lo") - (F.col("hi") - F.col("lo") if mode == "compat" else 0.0)
    return h.join(peaks(h, "after", least=F.lit(least)), ["id", "bin"]).groupBy("id").agg(F.array_sort(F.collect_set(start)).alias("marks"))


def roof_parts(pixels: DataFrame, bins: int = 20, least: float = 0.01, min_area: float = 4.0, size: float = 1.0, mode: str = "documented", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(id, part, height, area, geometry): roof parts of each footprint's ``pixels`` (id, row, col, value).

    A pixel belongs to the highest layer (see ``roof_layers``) that starts under its value; a part is a set of pixels of one layer that
    touch by their sides, its height where the layer starts. Sets under ``min_area`` go to their largest neighbour, smallest first. Parts are numbered by their
    first pixel, row by row. Rows run downwards from y0. A footprint's pixels meet in one task: they are as many as its area has.
    """
    valid = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    layer = F.size(F.filter("marks", lambda m: m < F.col("value"))).cast("int")
    marked = valid.join(roof_layers(valid, bins, least, mode), "id").select("id", "row", "col", layer.alias("layer"), "marks")
    few = int(round(min_area / size**2))

    def parts(frame: pd.DataFrame) -> pd.DataFrame:
        marks = frame["marks"].iloc[0]
        r0, c0 = frame["row"].min(), frame["col"].min()
        layers = np.full((frame["row"].max() - r0 + 1, frame["col"].max() - c0 + 1), -1)
        layers[frame["row"] - r0, frame["col"] - c0] = frame["layer"]
        labels = sieved(layers, few)
        out = []
        for label in np.unique(labels[(labels >= 0) & (layers >= 0)]):
            mask = labels == label
            k = layers[mask][0]
            if k > 0:
                rings = outlines(mask)
                place = lambda ring: [{"x": float(x0 + (c0 + c) * size), "y": float(y0 - (r0 + r) * size)} for r, c in ring]
                out.append((float(marks[k - 1]), float(mask.sum() * size**2), {"exterior": place(rings[0]), "interiors": [place(x) for x in rings[1:]]}))
        return pd.DataFrame({"id": frame["id"].iloc[0], "part": np.arange(1, len(out) + 1, dtype=np.int32), "height": [o[0] for o in out], "area": [o[1] for o in out], "geometry": [o[2] for o in out]})

    kind = pixels.schema["id"].dataType.simpleString()
    return marked.groupBy("id").applyInPandas(parts, f"id {kind}, part int, height double, area double, geometry {g.POLYGON}")


def components(values: np.ndarray) -> np.ndarray:
    """Sets of pixels of equal value that touch by their sides, labelled by their first pixel; -1 where the value is negative."""
    n = values.size
    parent = np.arange(n)
    number = parent.reshape(values.shape)
    a = np.concatenate([number[:, :-1][same := (values[:, :-1] == values[:, 1:])], number[:-1][below := (values[:-1] == values[1:])]])
    b = np.concatenate([number[:, 1:][same], number[1:][below]])
    while len(a):
        # Each set takes the smallest label that touches it, then labels are followed to their end.
        np.minimum.at(parent, np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b]))
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        keep = parent[a] != parent[b]
        a, b = a[keep], b[keep]
    return np.where(values >= 0, parent.reshape(values.shape), -1)


def sieved(layers: np.ndarray, few: int) -> np.ndarray:
    """Labels of the sets of equal layers after those of under ``few`` pixels went, smallest first, to their largest neighbour; changes ``layers`` likewise."""
    while True:
        labels = components(layers)
        known, size = np.unique(labels[labels >= 0], return_counts=True)
        sizes = dict(zip(known.tolist(), size.tolist(), strict=True))
        moved = False
        for label in sorted((k for k, n in sizes.items() if n < few), key=lambda k: (sizes[k], k)):
            mask = labels == label
            edge = np.zeros_like(mask)
            edge[1:] |= mask[:-1]
            edge[:-1] |= mask[1:]
            edge[:, 1:] |= mask[:, :-1]
            edge[:, :-1] |= mask[:, 1:]
            near = set(labels[edge & ~mask & (labels >= 0)].tolist())
            if near:
                layers[mask] = layers.ravel()[max(near, key=lambda k: (sizes[k], -k))]
                moved = True
                break
        if not moved:
            return labels


def outlines(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (row, col of pixel corners) around a set of pixels that touch by their sides: the exterior, then its holes."""
    inside = np.pad(mask, 1)
    turn = {}  # corner -> next corners, with the set on the right hand (rows run downwards)
    for dr, dc, a, b in ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0))):
        rows, cols = np.nonzero(inside[1:-1, 1:-1] & ~inside[1 + dr : inside.shape[0] - 1 + dr, 1 + dc : inside.shape[1] - 1 + dc])
        for r_, c_ in zip(rows.tolist(), cols.tolist(), strict=True):
            turn.setdefault((r_ + a[0], c_ + a[1]), []).append((r_ + b[0], c_ + b[1]))
    rings = []
    while turn:
        ring = [min(turn)]
        step = None
        while True:
            at = ring[-1]
            nexts = turn[at]
            # Where two pixels touch by a corner only, the ring stays with its own pixel: it turns right.
            k = 0 if len(nexts) == 1 or step is None else next(i for i, q in enumerate(nexts) if (q[0] - at[0], q[1] - at[1]) == (step[1], -step[0]))
            to = nexts.pop(k)
            if not nexts:
                del turn[at]
            new = (to[0] - at[0], to[1] - at[1])
            if step == new:
                ring.pop()
            ring.append(to)
            step = new
            if to == ring[0]:
                break
        rings.append(ring)
    area = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)))
    return sorted(rings, key=lambda x: (-area(x), x))


def inside_spans(rings: list[np.ndarray], px: float, py: float, dx: float, dy: float) -> list[tuple[float, float]]:
    """Stretches (from, to) along a line that lie inside rings taken together by the crossing rule."""
    cuts = []
    for p in rings:
        s, t = (p[:, 0] - px) * dy - (p[:, 1] - py) * dx, (p[:, 0] - px) * dx + (p[:, 1] - py) * dy
        at = np.flatnonzero((s[:-1] > 0) != (s[1:] > 0))
        cuts += (t[at] + (t[at + 1] - t[at]) * s[at] / (s[at] - s[at + 1])).tolist()
    cuts.sort()
    return list(zip(cuts[::2], cuts[1::2], strict=True))


def gap_to(rings: list[np.ndarray], x: float, y: float) -> float:
    """Distance of a point to the nearest edge."""
    best = math.inf
    for p in rings:
        d = np.diff(p, axis=0)
        t = np.clip(((x - p[:-1, 0]) * d[:, 0] + (y - p[:-1, 1]) * d[:, 1]) / np.maximum((d * d).sum(1), 1e-18), 0, 1)
        best = min(best, np.hypot(x - p[:-1, 0] - t * d[:, 0], y - p[:-1, 1] - t * d[:, 1]).min())
    return best


def _contains(rings: list[np.ndarray], x: float, y: float) -> bool:
    return sum(bool(((p[:-1, 1] > y) != (p[1:, 1] > y))[k] and x < p[k, 0] + (y - p[k, 1]) * (p[k + 1, 0] - p[k, 0]) / (p[k + 1, 1] - p[k, 1])) for p in rings for k in range(len(p) - 1) if p[k, 1] != p[k + 1, 1]) % 2 == 1


def _rings(polygon: dict) -> list[np.ndarray]:
    return [np.array([(q["x"], q["y"]) for q in r]) for r in [polygon["exterior"], *(polygon["interiors"] if polygon["interiors"] is not None else [])]]


def _centroid(rings: list[np.ndarray]) -> tuple[float, float]:
    total, sx, sy = 0.0, 0.0, 0.0
    o = rings[0][0]
    for k, p in enumerate(rings):
        x, y = p[:, 0] - o[0], p[:, 1] - o[1]
        c = x[:-1] * y[1:] - x[1:] * y[:-1]
        sign = (1 if k == 0 else -1) * np.sign(c.sum())
        total, sx, sy = total + sign * c.sum(), sx + sign * ((x[:-1] + x[1:]) * c).sum(), sy + sign * ((y[:-1] + y[1:]) * c).sum()
    return o[0] + sx / (3 * total), o[1] + sy / (3 * total)


#: Beyond a part's edge, neighbours are met at this distance; a section passes a centroid within NEAR. In metres.
BESIDE, NEAR = 0.25, 1e-3


def part_setback(footprint: list[np.ndarray], parts: list[tuple[float, list[np.ndarray]]], own: int, across: bool, min_slope: float, min_symmetry: float, symmetry_factor: float) -> float:
    """The share of the section through a part that lies outside it, along (or ``across``) the way from the nearest point of the
    footprint's boundary to the part's centroid; 0 without a lower part beside it, or if the drop to the highest such is small against the share's length."""
    height, rings = parts[own]
    cx, cy = _centroid(rings)
    best = (math.inf, 0.0, 0.0)
    for p in footprint:
        d = np.diff(p, axis=0)
        t = np.clip(((cx - p[:-1, 0]) * d[:, 0] + (cy - p[:-1, 1]) * d[:, 1]) / np.maximum((d * d).sum(1), 1e-18), 0, 1)
        qx, qy = p[:-1, 0] + t * d[:, 0], p[:-1, 1] + t * d[:, 1]
        k = int(np.hypot(cx - qx, cy - qy).argmin())
        best = min(best, (float(np.hypot(cx - qx[k], cy - qy[k])), float(qx[k]), float(qy[k])), key=lambda b: b[0])
    n, qx, qy = best
    if n < 1e-9:
        return 0.0
    dx, dy = (cx - qx) / n, (cy - qy) / n
    if across:
        dx, dy = dy, -dx
    section = next(((a, b) for a, b in inside_spans(footprint, cx, cy, dx, dy) if a - NEAR < 0 < b + NEAR), None)
    if section is None:
        return 0.0
    a, b = section
    solid = [(max(a, u), min(b, v)) for u, v in inside_spans(rings, cx, cy, dx, dy) if min(b, v) > max(a, u)]
    edges = [a, *(x for s in solid for x in s), b]
    free = [(u, v) for u, v in zip(edges[::2], edges[1::2], strict=True) if v - u > 1e-9]
    outside = sum(v - u for u, v in free)
    if not outside:
        return 0.0
    lower = []
    for u, v in free:
        for end, other in ((u, v), (v, u)):
            if not any(abs(end - x) < 1e-12 for s in solid for x in s):
                continue
            # The point beyond the end that is BESIDE away from the part, by bisection.
            low, high = end, other
            gap = lambda t: gap_to(rings, cx + t * dx, cy + t * dy)
            if gap(high) < BESIDE:
                continue
            for _ in range(50):
                mid = (low + high) / 2
                low, high = (mid, high) if gap(mid) < BESIDE else (low, mid)
            x, y = cx + high * dx, cy + high * dy
            lower += [h for k, (h, r) in enumerate(parts) if k != own and h < height and _contains(r, x, y)]
    if not lower or (height - max(lower)) / outside <= min_slope:
        return 0.0
    ratio = outside / (b - a)
    middle = sum((u + v) / 2 * (v - u) for u, v in free) / outside
    return ratio * (symmetry_factor if abs(middle) < min_symmetry else 1.0)


def setback_elevation(buildings: DataFrame, parts: DataFrame, min_setback_height: float = 1.0, min_symmetry_distance: float = 1.0, height_limit: float = 0.15, height_factor: float = 3.0, symmetry_factor: float = 0.5 / 0.3) -> DataFrame:
    """(id, elevation_setback) of ``buildings`` (id, geometry, building_height, ground_altitude) with ``parts`` (id, height, geometry): see ``part_setback``.

    The larger of both directions, times ``symmetry_factor`` where the outside lies evenly around the part, and ``height_factor`` where
    the part starts in the lower ``height_limit`` of the building; the largest of a building's parts, 0 without. Buildings of unknown heights get null.
    """
    kind = buildings.schema["id"].dataType.simpleString()

    def worst(key: tuple, table: pa.Table) -> pa.Table:
        # Plain lists: pandas would stack a polygon's holes, which fails where their numbers of corners differ.
        row = table.slice(0, 1).to_pylist()[0]
        shapes = sorted(((p["height"], _rings(p["geometry"])) for p in row["parts"]), key=lambda p: (p[0], p[1][0].tolist()))
        footprint, value = _rings(row["geometry"]), 0.0
        for k, (h, _) in enumerate(shapes):
            factor = height_factor if row["building_height"] * height_limit + row["ground_altitude"] > h else 1.0
            for across in (False, True):
                value = max(value, factor * part_setback(footprint, shapes, k, across, min_setback_height, min_symmetry_distance, symmetry_factor))
        return pa.table({"id": table["id"][:1], "elevation_setback": pa.array([value], pa.float64())})

    # Dealt by number: the rows are few bytes and much work, and the adaptive planner would put them all in one task.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A building's parts are as many as its roof has.
    of = parts.repartition(tasks, "id").groupBy("id").agg(F.collect_list(F.struct("height", "geometry")).alias("parts"))
    known = buildings.where("geometry is not null and building_height is not null and ground_altitude is not null")
    met = known.select("id", "geometry", "building_height", "ground_altitude").join(of.hint("merge"), "id")
    found = met.groupBy("id").applyInArrow(worst, f"id {kind}, elevation_setback double")
    rest = known.select("id").join(found, "id", "left").select("id", F.coalesce("elevation_setback", F.lit(0.0)).alias("elevation_setback"))
    return buildings.select("id").join(rest, "id", "left")


def slenderness_of_elevation(height: Column, area: Column, slenderness: Column) -> Column:
    """Height by the shorter side of a plan of that area and slenderness."""
    return height / F.sqrt(area / slenderness)


def to_tiles(grid: DataFrame, size: int = 64) -> DataFrame:
    """Pixels as tiles (raster_id, tr, tc, cells: array of (row, col, value))."""
    return grid.groupBy("raster_id", F.floor(F.col("row") / size).alias("tr"), F.floor(F.col("col") / size).alias("tc")).agg(F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("cells"))


def from_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.select("raster_id", F.explode("cells").alias("c")).select("raster_id", "c.*")


