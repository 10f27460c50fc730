"""Exact top-k search by inner product: a Voronoi join.

Pivots from a bounded sample cut the space into cells. Per cell a summary holds the number of
vectors, the largest distance to the pivot and a histogram of distances. Neighbouring cells of queries form
groups of about QUERIES rows. For a group the summaries give a score that K candidates surely
reach, and per data cell a score that none exceeds: only cells above go to the group. A
group's data are split evenly by hash into blocks of about ROWS, so a hot cell spreads over many
tasks; each block is solved by matrix products, and the blocks' best K merge.

Scores are exact integers: products run in float64 while it holds them exactly, else in int64.

Edge cases: vectors that are null or hold null or non-finite components, and null ids, take no part; scores that may pass 64 bits are an error; shorter vectors count as padded with
zeros; rows with a query's vec_id are not its candidates; other repeated rows are candidates each; repeated queries: the smallest vector
is asked once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

K, PIVOTS, BINS = 20, 128, 32
QUERIES, ROWS = 8192, 8192


def quantised(table: DataFrame) -> DataFrame:
    """(vec_id, v): components floor(64 * x) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 64).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    n = pa.compute.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy()
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, cell, d): each vector with its nearest pivot and the distance to it; v as padded int64 bytes."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.astype(float)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                v = matrix(part["v"], width)
                f = v.astype(float)
                cell = ((p * p).sum(1)[None, :] - 2 * f @ p.T).argmin(1)
                d = np.sqrt(((f - p[cell]) ** 2).sum(1))
                raw = pa.array([r.tobytes() for r in v], pa.binary())
                yield pa.RecordBatch.from_arrays([part["vec_id"], raw, pa.array(cell, pa.int32()), pa.array(d)], ["vec_id", "v", "cell", "d"])

    return vectors.mapInArrow(run, "vec_id long, v binary, cell int, d double")


def needed(pivots: np.ndarray, radius: np.ndarray, asked: np.ndarray, histogram: list[tuple[int, float, int]], k: int) -> np.ndarray:
    """Whether queries of cell i (row) may need data of cell j (column).

    For q = p_i + a and s = p_j + b: q.s = p_i.p_j + a.p_j + p_i.b + a.b. ``asked`` bounds |a|, ``radius`` |b|;
    ``histogram``: (cell, upper bound of |b|, count).
    """
    p = pivots.astype(float)
    norm, base = np.sqrt((p * p).sum(1)), p @ p.T
    slack = 1e-6 * (1 + np.abs(base))
    fixed = asked[:, None] * norm[None, :]
    reach = norm[:, None] + asked[:, None]
    upper = base + fixed + reach * radius[None, :] + slack
    cells, far, n = (np.array(x) for x in zip(*histogram, strict=True))
    lower = base[:, cells] - fixed[:, cells] - reach * far[None, :] - slack[:, cells]
    order = np.argsort(-lower, axis=1)
    enough = np.cumsum(n[order], axis=1) >= k + 1  # one of them may be the query itself
    at = np.where(enough.any(1), enough.argmax(1), -1)
    surely = np.where(at >= 0, np.take_along_axis(lower, order, 1)[np.arange(len(p)), np.maximum(at, 0)], -np.inf)
    return (upper >= surely[:, None]) & (radius >= 0)[None, :]


def grouped(pivots: np.ndarray, counts: np.ndarray, size: int) -> list[list[int]]:
    """Cells with queries, in groups of about ``size`` queries; cells that follow along the widest axis stand together."""
    some = np.flatnonzero(counts)
    p = pivots[some].astype(float)
    axis = p.var(0).argmax() if len(some) else 0
    groups, now, n = [], [], 0
    for c in some[np.argsort(p[:, axis], kind="stable")].tolist():
        if now and n + counts[c] > size:
            groups.append(now)
            now, n = [], 0
        now.append(c)
        n += counts[c]
    return [*groups, now] if now else groups


def best_of_block(q: np.ndarray, s: np.ndarray, q_ids: np.ndarray, s_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, data numbers, scores) of each query's k best; ``s_ids`` ascend, so earlier rows win ties."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(s).max(initial=0)) * max(q.shape[1], 1)
    if big >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    exact = np.float64 if big < 2**53 else np.int64
    st, m = s.astype(exact).T, len(s)
    place = np.arange(m - 1, -1, -1)
    for a in range(0, len(q), 256):
        score = (q[a : a + 256].astype(exact) @ st).astype(np.int64)
        own = q_ids[a : a + 256, None] == s_ids[None, :]
        if big * m < 2**62:
            rank = score * m + place
            rank[own] = np.iinfo(np.int64).min + 1  # last: the negated minimum would wrap and come first
            top = np.argpartition(-rank, min(k, m - 1) - 1 if m > k else m - 1, axis=1)[:, :k]
        else:
            top = np.stack([np.lexsort((-place, -r, o))[:k] for r, o in zip(score, own, strict=True)])
        row = np.repeat(np.arange(len(top)), top.shape[1])
        keep = ~own[row, top.ravel()]
        yield row[keep] + a, top.ravel()[keep], score[row, top.ravel()][keep]


def top_k(table: DataFrame, every: int = 20, k: int = K, queries: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    result = "query_id long, vec_id long, score long"
    vectors = quantised(table)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).head()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(size.width, 1)
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows at most
    pivots = np.unique(np.array([r.v + [0] * (width - len(r.v)) for r in chosen], np.int64), axis=0)
    data = store.written(placed(vectors, pivots), "placed")
    asks = data.where(F.col("vec_id") % every == 0)
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()  # one row a cell
    radius = np.full(len(pivots), -1.0)
    for r in summary:
        radius[r.cell] = r.r
    step = max(radius.max(), 1e-9) / BINS
    bins = data.groupBy("cell", F.ceil(F.col("d") / step).alias("bin")).agg(F.count("*").alias("n")).collect()  # BINS + 1 rows a cell
    asked, counts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in asks.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
        asked[r.cell], counts[r.cell] = r.r, r.n
    use = needed(pivots, radius, asked, [(r.cell, (r.bin + 1e-6) * step, r.n) for r in bins], k)
    n_cell = np.zeros(len(pivots), np.int64)
    for r in summary:
        n_cell[r.cell] = r.n
    groups = grouped(pivots, counts, queries)
    # At most one row for each pair of a group and a cell.
    ask_rows, data_rows = [], []
    for g, cells in enumerate(groups):
        wanted = np.flatnonzero(use[cells].any(0))
        blocks = int(-(-n_cell[wanted].sum() // rows)) or 1
        parts = int(-(-counts[cells].sum() // queries))
        ask_rows += [(int(c), g, parts, blocks) for c in cells]
        data_rows += [(int(c), g, parts, blocks) for c in wanted]
    schema = "cell int, g int, parts int, blocks int"
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    once = asks.groupBy("vec_id").agg(F.min_by(F.struct("v", "cell"), "v").alias("x")).select("vec_id", "x.v", "x.cell")
    left = once.join(F.broadcast(spark.createDataFrame(ask_rows, schema)), "cell").select(F.lit(0).alias("side"), "g", own("parts").alias("part"), span("blocks").alias("block"), "vec_id", "v")
    right = data.join(F.broadcast(spark.createDataFrame(data_rows, schema)), "cell").select(F.lit(1).alias("side"), "g", span("parts").alias("part"), own("blocks").alias("block"), "vec_id", "v")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        q, s = frame[frame.side == 0], frame[frame.side == 1].sort_values(["vec_id", "v"])
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        vq, vs = (np.frombuffer(b"".join(x.v), np.int64).reshape(len(x), -1) for x in (q, s))
        qi, si = q.vec_id.to_numpy(), s.vec_id.to_numpy()
        return pd.concat([pd.DataFrame({"query_id": qi[a], "vec_id": si[b], "score": c}) for a, b, c in best_of_block(vq, vs, qi, si, k)])

    best = left.unionByName(right).groupBy("g", "part", "block").applyInPandas(solve, result)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
