"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in a normal form: A-Z lower-cased, each run of white space one space, UTF-8
bytes. A document leaks an item if some stretch of both aligns with
``matches - Q * edits >= LEAST`` (LEAST is the item's length if that is less). Each edit breaks
at most Q of the q-grams that a perfect stretch would share, so such an alignment keeps at
least ``LEAST - Q + 1`` of them: the lemma's bound. They are counted per diagonal band, WIDTH
diagonals wide and overlapping by half, so that an alignment that drifts by up to WIDTH / 2
diagonals lies in one band whole. Bands that meet the bound are verified by a local alignment
confined to the band.

The benchmark is indexed in blocks of at most ``block_bytes`` of text; every block is broadcast
(its size is thereby bounded) and meets all documents. The q-grams that a document shares with a block are expanded
HITS at a time and reduced to distinct (band, item position), so repetitive texts do not fill memory.

Edge cases: null or empty texts and items of under Q + 1 bytes match nothing; repeated items
and rows give a row each; a null item_id or doc_id is carried along; an empty table on either side
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import PAD, SPACE, buffers, mix, pieces, returned

Q, LEAST, WIDTH = 8, 40, 32
ROW = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, score long"
FILTER_BITS = 22
#: Shared q-grams that are expanded at a time, and bands that are aligned at a time.
HITS, ALIGNED = 1_000_000, 20_000
#: Bytes of text that ``clean_rows`` normalises at a time, which takes some 40 times as much (a longer text comes alone).
NORMALISED = 1 << 20


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, place of each byte in the unnormalised buffer) of the normal forms."""
    data, off = buffers(column, lower=True)
    n = int(off[-1])
    blank = SPACE[data[:n]]
    keep = np.ones(n, bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    firsts = off[:-1][off[:-1] < off[1:]]
    keep[firsts] = True
    place = np.flatnonzero(keep)
    out = np.full(len(place) + PAD, 32, np.uint8)
    out[:-PAD] = np.where(blank[place], 32, data[place])
    return out, np.concatenate([[0], np.cumsum(keep)])[off], place


KEYED = np.dtype([("key", np.int64), ("i", np.int64)])


def distinct(rows: np.ndarray) -> np.ndarray:
    order = np.lexsort((rows["i"], rows["key"]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1])
    return rows[new]


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each byte, as an integer."""
    return np.ndarray(len(data) - PAD + 1, "<u8", data.data, strides=(1,))


class Index:
    """Sorted q-grams of a block of items, with a bit table before them."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        self.ids = ids
        self.data, self.off, _ = normal(pa.array(texts, pa.large_string()))
        g = grams(self.data)
        at = np.concatenate([np.arange(a, max(a, b - Q + 1)) for a, b in zip(self.off, self.off[1:], strict=False)]) if ids else np.empty(0, np.int64)
        order = np.argsort(g[at], kind="stable")
        self.gram, self.at = g[at][order], at[order].astype(np.uint32)
        self.size = np.diff(self.off)
        self.least = np.minimum(LEAST, self.size)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.slot(self.gram)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def hits(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc, item, position in doc, position in item) of all shared q-grams, about HITS at a time."""
        g = grams(data)[: off[-1]]
        at = np.flatnonzero(self.bits[self.slot(g)])
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[doc + 1]
        at, doc = at[inside], doc[inside]
        low = np.searchsorted(self.gram, g[at], "left")
        n = np.searchsorted(self.gram, g[at], "right") - low
        some = n > 0
        at, doc, low, n = at[some], doc[some], low[some], n[some]
        total, k = np.concatenate([[0], np.cumsum(n)]), 0
        while k < len(at):
            end = max(k + 1, int(np.searchsorted(total, total[k] + HITS, "right")) - 1)
            m = n[k:end]
            where = self.at[np.repeat(low[k:end] - (total[k:end] - total[k]), m) + np.arange(total[end] - total[k])].astype(np.int64)
            item = np.searchsorted(self.off, where, "right") - 1
            yield np.repeat(doc[k:end], m), item, np.repeat(at[k:end] - off[doc[k:end]], m), where - self.off[item]
            k = end

    def bands(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, item, first diagonal) of the bands that meet the lemma's bound."""
        half, found, waiting = WIDTH // 2, np.empty(0, KEYED), []
        for doc, item, j, i in self.hits(data, off):
            upper = (j - i) // half  # a diagonal lies in the bands that start at upper * half and the half before
            for band in (upper, upper - 1):
                part = np.empty(len(doc), KEYED)
                part["key"], part["i"] = ((doc * len(self.ids) + item) << 32) + (band + (1 << 31)), i
                waiting.append(part)
            # One count per item position and band.
            if sum(map(len, waiting)) > max(2 * len(found), 2 * HITS):
                found, waiting = distinct(np.concatenate([found, *waiting])), []
        found = distinct(np.concatenate([found, *waiting]))
        k, n = np.unique(found["key"], return_counts=True)
        pair, band = k >> 32, (k & 0xFFFFFFFF) - (1 << 31)
        doc, item = pair // max(len(self.ids), 1), pair % max(len(self.ids), 1)
        enough = (n >= self.least[item] - Q + 1) & (self.size[item] > Q)
        return doc[enough], item[enough], band[enough] * half

    def best(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, item, score, doc start, doc end, item start, item end) of the leaks: each document's and item's best stretch."""
        doc, item, first = self.bands(data, off)
        out = np.empty((7, 0), np.int64)
        for k in range(0, len(doc), ALIGNED):
            d, i = doc[k : k + ALIGNED], item[k : k + ALIGNED]
            part = np.stack([d, i, *self.aligned(data, off, d, i, first[k : k + ALIGNED])])
            out = np.concatenate([out, part[:, (part[2] >= self.least[i]) & (part[2] > 0)]], 1)
            out = out[:, np.lexsort((out[3], -out[2], out[1], out[0]))]
            new = np.ones(out.shape[1], bool)
            new[1:] = (out[:2, 1:] != out[:2, :-1]).any(0)
            out = out[:, new]
        return tuple(out)

    def aligned(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, item: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(score, doc start, doc end, item start, item end) of each band's best local alignment: match 1, edit -Q."""
        k, span = len(doc), np.arange(WIDTH)
        h = np.zeros((k, WIDTH), np.int64)
        start = np.zeros((k, WIDTH), np.int64)  # packed: item position << 32 | doc position
        best = np.zeros((5, k), np.int64)
        size, n = self.size[item], off[doc + 1] - off[doc]
        for i in range(int(size.max()) if k else 0):
            j = i + first[:, None] + span
            ok = (j >= 0) & (j < n[:, None]) & (i < size)[:, None]
            x = data[np.clip(off[doc][:, None] + j, 0, len(data) - 1)]
            same = ok & (x == self.data[np.minimum(self.off[item] + i, len(self.data) - 1)][:, None])
            here = (i << 32) | np.maximum(j, 0)
            begin = np.where(h > 0, start, here)
            t = np.where(same, h + 1, h - Q)
            down, down_start = np.full_like(h, -1), np.zeros_like(h)
            down[:, :-1], down_start[:, :-1] = h[:, 1:] - Q, start[:, 1:]
            begin = np.where(down > t, down_start, begin)
            t = np.maximum(np.maximum(t, down), 0)
            # Gaps along the document: the best of t[d'] - Q * (d - d') over earlier diagonals d'.
            far = np.maximum.accumulate(((t + Q * span) << 6) | (WIDTH - 1 - span), axis=1)
            origin = WIDTH - 1 - (far & 63)
            score = (far >> 6) - Q * span
            h = np.where(ok & (score > 0), score, 0)
            start = np.take_along_axis(begin, origin, 1)
            top = h.argmax(1)
            value = np.take_along_axis(h, top[:, None], 1)[:, 0]
            better = value > best[0]
            if better.any():
                s = np.take_along_axis(start, top[:, None], 1)[:, 0]
                for row, new in enumerate((value, s & 0xFFFFFFFF, i + first + top + 1, s >> 32, np.full(k, i + 1))):
                    best[row][better] = new[better]
        return tuple(best)


def indexed(benchmark: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """Indexes of the benchmark's blocks, each broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    context, block, size = benchmark.sparkSession.sparkContext, [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        n = len(r.text.encode())
        if block and size + n > block_bytes:
            yield context.broadcast(Index([x.item_id for x in block], [x.text for x in block]))
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield context.broadcast(Index([x.item_id for x in block], [x.text for x in block]))


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The leaks of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): for each document and item the best stretch.

    Ends are exclusive; places in the document count code points of its text, places in the item bytes
    of its normal form; ``score`` is matches less Q per edit.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None

    def search(model) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                index = model.value
                data, off, place = normal(piece["text"])
                doc, item, score, a, b, c, d = index.best(data, off)
                raw, raw_off = buffers(piece["text"])
                points = np.concatenate([[0], np.cumsum((raw[:-PAD] & 0xC0) != 0x80)])
                at = lambda p: points[place[off[doc] + p]] - points[raw_off[doc]]
                ids = piece["doc_id"].take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[k] for k in item], pa.int64()), *(pa.array(x, pa.int64()) for x in (at(a), at(b - 1) + 1, c, d, score))], [x.split()[0] for x in ROW.split(", ")])

        return docs.mapInArrow(run, ROW)

    for model in indexed(benchmark, block_bytes):
        out = search(model) if out is None else out.unionByName(search(model))
    return out if out is not None else spark.createDataFrame([], ROW)


def clean_rows(batches: Iterator[pa.RecordBatch], model: Broadcast, at: int) -> Iterator[pa.RecordBatch]:
    """The rows whose column ``at`` leaks no item of the index."""
    for piece in pieces((b.set_column(at, "text", b.column(at)) for b in returned(batches)), limit=NORMALISED):
        index = model.value
        data, off, _ = normal(piece.column(at))
        clean = np.ones(piece.num_rows, bool)
        clean[index.best(data, off)[0]] = False
        yield piece.filter(pa.array(clean))


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that leak no item, in one pass without a shuffle."""
    at = docs.columns.index("text")

    def keep(model):
        return lambda batches: clean_rows(batches, model, at)

    for model in indexed(benchmark, block_bytes):
        docs = docs.mapInArrow(keep(model), docs.schema)
    return docs
