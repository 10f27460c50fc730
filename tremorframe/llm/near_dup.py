"""Near-duplicate detection: SetSketch registers, bands, joint likelihood, full-set check.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words are runs other
than white space 0x09-0x0D and space; a shorter text is one shingle). A SetSketch keeps, per
register, an exponentially spaced truncated minimum (base 1.001, so two registers agree with
a probability close to the Jaccard similarity); sketches of two sets merge by ``max``. Bands
of four registers, 32 of them, miss a pair of similarity 0.75 with probability 5e-6.

Links need only connect, so copies are never expanded into all pairs: equal sets become one
class; each class in a bucket is first paired with the bucket's smallest class only, and the one
it most probably resembles is verified on full sets. Then only pairs of one bucket whose
components still differ are compared: those of small buckets (up to SMALL_BUCKET classes) are estimated by likelihood and
verified, those of larger ones go block by block on full sets, which gives the same links: the estimate only saves verification.

Edge cases: a null, empty or blank text has no shingles and no links of its own (its own component);
rows of equal doc_id are one node, whatever their texts: they and all that any of their texts is linked to are one component; each gives a row; a null doc_id links to nothing
of its own, gets a null component and is kept; an empty table gives no rows; other columns
are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .graph import components
from .text import buffers, hashes, mix, pieces, sums, words

WORDS = 5
REGISTERS, BANDS = 128, 32
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Pairs whose likelihood estimate is lower are not verified: over six standard errors under 0.75.
LEAST_ESTIMATE = 0.5
#: Buckets of up to this many classes are compared by a join, larger ones in blocks.
SMALL_BUCKET, BLOCK = 64, 256
_G = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted 64-bit shingle hashes of all rows, row offsets)."""
    data, off = buffers(column, lower=True)
    starts, lengths, rows = words(data, off)
    h = hashes(data, starts, lengths)
    n = np.diff(rows)
    if len(h) >= WORDS:
        s = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            s = mix(s * _G + h[k : len(h) - WORDS + 1 + k])
    else:
        s = np.empty(0, np.uint64)
    out, off2 = [], np.zeros(len(n) + 1, np.int64)
    for i, (a, c) in enumerate(zip(rows[:-1].tolist(), n.tolist(), strict=True)):
        if c >= WORDS:
            x = np.unique(s[a : a + c - WORDS + 1])
        elif c:
            x = np.uint64(c)
            for w in h[a : a + c]:
                x = mix(np.array([x], np.uint64) * _G + w)[0]
            x = np.array([x], np.uint64)
        else:
            x = s[:0]
        out.append(x)
        off2[i + 1] = off2[i] + len(x)
    return (np.concatenate(out) if out else s[:0]), off2


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x REGISTERS, uint16); rows without elements are 0.

    Every element is a Poisson process of rate RATE * REGISTERS whose points fall on random
    registers; a register's first point is thus exponential. Points beyond a bound that the
    row's minima exceed with probability e^-10 are not drawn; rows that need them are drawn again.
    """
    rows, n = len(off) - 1, np.diff(off)
    first = np.full(rows * REGISTERS, np.inf)
    todo, factor = n > 0, 1.0
    with np.errstate(divide="ignore"):
        bound = (np.log(REGISTERS) + 10) / (RATE * n)
    while todo.any():
        own = np.repeat(np.arange(rows), n)
        pick = todo[own]
        own, state = own[pick], h[pick]
        at = np.zeros(len(own))
        while len(own):
            state = mix(state + _G)
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * REGISTERS)
            near = at < bound[own] * factor
            own, at, state = own[near], at[near], state[near]
            np.minimum.at(first, own * REGISTERS + (state & np.uint64(REGISTERS - 1)).astype(np.int64), at)
        todo &= np.isinf(first.reshape(rows, -1)).any(1)
        factor *= 4
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first) / np.log(BASE))
    return np.where(np.isinf(first), 0, np.clip(k, 0, TOP)).astype("<u2").reshape(rows, -1)


def _likelihood(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joint log likelihood of ``more`` registers being larger in the first sketch and ``less`` in the second, at similarity ``j``."""
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 201) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    grid = np.linspace(0, 1, steps)[None, :] * np.minimum(na / nb, nb / na)[:, None]
    fit = _likelihood((a > b).sum(1)[:, None], (a < b).sum(1)[:, None], na[:, None], nb[:, None], grid)
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text): rows of equal doc_id and tie are alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_shingles, d1, d2, regs): hash of the text, set size, 128-bit set digest and registers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            h, off = shingle_sets(piece["text"])
            regs = registers(h, off)
            digest = [sums(mix(h ^ np.uint64(s)).view(np.int64), off) for s in (0x5DEECE66D, 0x2545F4914F6CDD1D)]
            regs_pa = pa.Array.from_buffers(pa.binary(2 * REGISTERS), len(regs), [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["tie"], pa.array(np.diff(off)), *map(pa.array, digest), regs_pa], ["doc_id", "tie", "n_shingles", "d1", "d2", "regs"])

    return identified(docs).mapInArrow(run, "doc_id long, tie long, n_shingles long, d1 long, d2 long, regs binary")


def fixed(column: pa.Array, kind: str) -> np.ndarray:
    data, off = buffers(column)
    return data[: off[-1]].view(kind).reshape(len(column), -1)


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, estimate) of the pairs whose set sizes and sketches allow the threshold."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    near = F.expr("100 * least(na, nb) >= 75 * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                j = likely_jaccard(fixed(part["ra"], "<u2"), fixed(part["rb"], "<u2"), part["na"].to_numpy().astype(float), part["nb"].to_numpy().astype(float))
                keep = pa.array(j >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([part["a"].filter(keep), part["b"].filter(keep), pa.array(j).filter(keep)], ["a", "b", "estimate"])

    return pairs.join(side("b"), "b").join(side("a"), "a").where(near).mapInArrow(run, "a long, b long, estimate double")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("sa", "sb"):
                data, off = buffers(batch[name])
                flat = data[: off[-1]].view("<u8")
                sides.append([flat[a:b] for a, b in zip(off[:-1] // 8, off[1:] // 8, strict=True)])
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
            size = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64)
            keep = pa.array(100 * both >= 75 * (size - both))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["u", "v"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, shingles) of the classes ``ids`` (id, rep), from the text of their ``rep``: the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            h, off = shingle_sets(piece["text"])
            raw = h.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([piece["id"], pa.array([raw[8 * a : 8 * b] for a, b in zip(off, off[1:], strict=False)], pa.binary())], ["id", "shingles"])

    rows = identified(docs)
    if repeated:
        rows = rows.groupBy("doc_id", "tie").agg(F.first("text").alias("text"))
    return rows.join(ids.select("id", "rep.doc_id", "rep.tie"), ["doc_id", "tie"]).select("id", "text").mapInArrow(run, "id long, shingles binary")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, by products of 0/1 matrices, ``width`` shingles a time."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (x, y)]
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float32)
    cells = []
    for h, row in sides:
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        hit = both[at] == h if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], row[hit][order]))
    for k in range(0, len(both), width):
        part = []
        for (at, row), n in zip(cells, out.shape, strict=True):
            lo, hi = np.searchsorted(at, [k, k + width])
            m = np.zeros((n, width), np.float32)
            m[row[lo:hi], at[lo:hi] - k] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def block_links(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) in large buckets between the rows marked ``ask`` and all the bucket's, block by block on full sets.

    Of the links of one class to another component one is given: components need no more.
    """
    counts = large.groupBy("key").agg(F.count("*").alias("m"), F.count_if("ask").alias("r")).where("r > 0")
    rows = large.join(counts, "key").join(sets, "id")
    nm, nr = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("r") / BLOCK).cast("int")
    span = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    own = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    cols = ["key", "id", "c", "shingles"]
    left = rows.where("ask").select(*cols, F.lit(0).alias("side"), own(nr).alias("br"), span(nm).alias("bm"))
    right = rows.select(*cols, F.lit(1).alias("side"), span(nr).alias("br"), own(nm).alias("bm"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame.side == 0], frame[frame.side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        sx, sy = ([np.frombuffer(b, "<u8") for b in f.shingles] for f in (x, y))
        both = shared_counts(sx, sy)
        union = np.array([len(s) for s in sx])[:, None] + np.array([len(s) for s in sy])[None, :] - both
        cx, cy, iy = x.c.to_numpy(), y.c.to_numpy(), y.id.to_numpy()
        linked = (100 * both >= 75 * union) & (cx[:, None] != cy[None, :])
        out = []
        for k in np.flatnonzero(linked.any(1)):
            at = np.flatnonzero(linked[k])
            at = at[np.unique(cy[at], return_index=True)[1]]
            out.append(pd.DataFrame({"u": x.id.iloc[k], "v": iy[at]}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}).astype("int64")

    return left.unionByName(right).groupBy("key", "br", "bm").applyInPandas(compare, "u long, v long")


def links(docs: DataFrame, classes: DataFrame, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of different classes that connect all that are linked, and (id, component) of those classes."""
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * REGISTERS // BANDS} + 1, {2 * REGISTERS // BANDS})))")
    banded = classes.select("id", F.explode(band).alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = store.written(banded.join(buckets, "key"), "members")
    first = estimated(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes)
    best = first.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    sets = store.written(full_sets(docs, members.select("id").distinct().join(classes.select("id", "rep"), "id"), repeated), "sets", "none")
    near = store.written(verified(best, sets), "links")
    found = components(near)
    # Pairs of one bucket whose components differ are left. In large buckets each class outside the hub's component
    # first meets one bucket, its largest; what is still mixed then meets all of its buckets.
    for turn in (0, 1):
        label = members.join(found, "id", "left").select("key", "hub", "m", "id", F.coalesce("component", "id").alias("c"))
        if turn:
            label = label.where(F.col("m") > SMALL_BUCKET)
        mixed = label.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.col("id") == F.col("hub"), F.col("c"))).alias("hub_c")).where("low <> high").select("key", "hub_c")
        rest = store.written(label.join(mixed, "key").select("key", "m", "id", "c", (F.col("c") != F.col("hub_c")).alias("ask")), "mixed")
        large = rest.where(F.col("m") > SMALL_BUCKET).drop("m")
        some_large = bool(large.head(1))
        late = None
        if some_large:
            if not turn:
                chosen = rest.where((F.col("m") > SMALL_BUCKET) & F.col("ask")).groupBy("id").agg(F.max_by("key", F.struct("m", "key")).alias("one"))
                large = large.join(chosen, "id", "left").withColumn("ask", F.col("ask") & (F.col("key") == F.col("one"))).drop("one")
            late = block_links(large, sets)
        if not turn:
            small = rest.where(F.col("m") <= SMALL_BUCKET).select("key", "id", "c")
            other = small.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
            pairs = small.withColumnRenamed("id", "a").join(other, "key").where("a < b and c <> cb").select("a", "b").distinct()
            few = verified(estimated(pairs, classes), sets)
            late = late.unionByName(few) if late else few
        if late is None:
            break
        late = store.written(late.distinct(), "links")
        if late.head(1):
            near = near.unionByName(late)
            found = components(near)
        if not some_large:
            break
    for table in (sets, members):
        store.drop(table)
    return near, found


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """What the two operators below share.

    (doc_id, tie, n_shingles, id) of every row, where ``id`` is the class of its set, if any; classes (id, n, regs, rep: smallest doc_id and
    its tie); of doc_ids that stand on several rows (doc_id, low, high: its classes), None without such; links; and the classes' components.
    """
    id_ = F.when(F.col("n_shingles") > 0, F.xxhash64("d1", "d2", "n_shingles")).alias("id")
    signed = store.written(sketches(docs).select("doc_id", "tie", "n_shingles", id_, "regs"), "sketches")
    sets = signed.where("id is not null and doc_id is not null").groupBy("id").agg(F.first("n_shingles").alias("n"), F.min(F.struct("doc_id", "tie")).alias("rep"), F.min("regs").alias("regs"))
    classes = store.written(sets, "classes")
    rows = signed.drop("regs")
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = store.written(again, "repeated")
    repeated = bool(again.head(1))
    near, found = links(docs, classes, repeated)
    return rows, classes, again if repeated else None, near, found


def lowest(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, rep) of every class: the smallest doc_id, and its tie, of its component."""
    label = found.join(classes.select("id", "rep"), "id")
    low = label.groupBy("component").agg(F.min("rep").alias("best"))
    best = found.join(low, "component").select("id", "best")
    return classes.select("id", "rep").join(best, "id", "left").select("id", F.coalesce("best", "rep").alias("rep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    rows, classes, again, near, found = grouped(docs)
    if again is not None:
        twins = rows.where("id is not null").join(again.where("low <> high"), "doc_id").select(F.col("low").alias("u"), F.col("id").alias("v")).where("u <> v").distinct()
        found = components(near.unionByName(twins))
    label = lowest(classes, found).select("id", F.col("rep.doc_id").alias("component"))
    out = rows.join(label, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    if again is not None:
        # A row without shingles goes with the other rows of its doc_id.
        own = again.where("low is not null").join(label, F.col("low") == F.col("id")).select("doc_id", "component")
        empty = rows.where("id is null").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
        out = out.where("n_shingles > 0").unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    out = store.written(out.select("doc_id", "n_shingles", component.alias("component_id")), "components")
    for table in (rows, classes, near, found):
        store.drop(table)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicate texts: of each group the row of the smallest doc_id.

    Here rows of equal doc_id and different texts are different documents; of rows with equal doc_id and text one stays.
    Rows without shingles and rows of a null doc_id stay.
    """
    rows, classes, again, near, found = grouped(docs)
    empty = rows.where("id is null and doc_id is not null").select("doc_id", "tie")
    stay = store.written(lowest(classes, found).select("rep.doc_id", "rep.tie").unionByName(empty).distinct(), "kept")
    for table in (rows, classes, near, found):
        store.drop(table)
    tie = F.xxhash64(F.col("text").cast("string"))
    kept = stay.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    out = docs.join(kept, (docs["doc_id"].cast("long") == F.col("_id")) & (tie == F.col("_tie")), "left_semi").select(*docs.columns)
    if again is not None:
        out = out.withColumn("_tie", tie).dropDuplicates(["doc_id", "_tie"]).drop("_tie")
    return out.unionByName(docs.where("doc_id is null"))
