"""Mixing sources to target weights by blocks of fixed length.

A source's documents, in chunks of about CHUNK documents, are laid end to end and cut into
blocks of BLOCK words (the last of a chunk may be shorter). A target in words becomes a number of slots of
the source; all slots fill output shards of SHARD_SLOTS. Each shard's counts by source are a multinomial draw given those numbers:
the range of all shards is halved again and again, and at each half the counts of the first are drawn from what the whole has, so any range of shards is drawn without the others.
Within the source, slot j reads block ``permutation(j mod blocks)``, a keyed Feistel network walked until it falls in
range, so every block is read floor or ceil of slots / blocks times, and no document more than
the cap of its source. Slots and blocks meet in a join on (source, block).
``mixed_shards`` gives the shards' texts, ``mixed_texts`` the documents as the mix takes them.

Order within a chunk is by doc_id, then text. Nothing depends on the partitioning, so reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, the last; documents
of no words are kept with ``taken`` 0; rows of equal doc_id count each; a null doc_id sorts first; an empty table gives no rows;
other columns are ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .text import SPACE, buffers, mix as scramble, pieces, returned, words

BLOCK, CHUNK, SHARD_SLOTS = 64, 512, 16384
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
SEED = 20240607
#: Chunks that are numbered together; shards that one task fills; sources whose plan is broadcast.
PART, TASK_SHARDS, FEW_SOURCES = 1024, 64, 10_000


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 per key, applied to each j < n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = j.astype(np.uint64), np.arange(len(j))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (scramble(right + key[todo] + np.uint64(r * 0x1F123BB5)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words to take of each source: ``share`` of all by weight, capped, the excess reshared by weight until none is above."""
    total, free, out = share * sum(sizes), [k for k, s in enumerate(sizes) if s], [0.0] * len(sizes)
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    while free:
        left = total - sum(out)
        over = [k for k in free if left * w[k] / sum(w[i] for i in free) > cap * sizes[k]]
        if not over:
            for k, v in [(k, left * w[k] / sum(w[i] for i in free)) for k in free]:
                out[k] = v
            break
        for k in over:
            out[k] = cap * sizes[k]
        free = [k for k in free if k not in over]
    return out


def sized(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, source, size, tie, *extra): words of each text and a hash of it that breaks ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            n = np.diff(words(*buffers(piece["text"]))[2])
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(n, pa.int64())], [*piece.schema.names[:-1], "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, tie long, size long")


def laid(rows: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows with chunk, start (words before it in its chunk) and the chunk's first block; and one row a source with size and blocks."""
    n = max(1, -(-rows.count() // chunk))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)))
    w = Window.partitionBy("source", "chunk").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words")).withColumn("n", F.ceil(F.col("words") / block))
    # One row for about CHUNK documents; a source's blocks are numbered by PART chunks, then within each.
    chunks = chunks.withColumn("part", F.floor(F.col("chunk") / PART))
    before = lambda order, *key: F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = chunks.groupBy("source", "part").agg(F.sum("n").alias("n")).select(F.col("source").alias("s"), F.col("part").alias("p"), before("part", "source").alias("low"))
    within = chunks.select("source", "chunk", "part", before("chunk", "source", "part").alias("high"))
    first = within.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("source", "chunk", (F.col("low") + F.col("high")).alias("first_block"))
    same = [placed["source"].eqNullSafe(first["source"]), placed["chunk"] == first["chunk"]]
    joined = placed.join(first, same).select(placed["*"], first["first_block"])
    return joined, chunks.groupBy("source").agg(F.sum("words").alias("size"), F.sum("n").alias("blocks"))


def dealt(counts: np.ndarray, first: np.ndarray, low: int, high: int, start: int, end: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots by source, each source's first slot) of the shards of [start, end) in [low, high), which has ``counts`` slots by source from ``first`` on."""
    if high <= start or low >= end:
        return
    if high - low == 1:
        yield low, counts, first
        return
    middle = (low + high) // 2
    n = (middle - low) * size
    left = np.random.default_rng([SEED, low, high]).multinomial(n, counts / counts.sum())
    over = np.maximum(left - counts, 0)
    left -= over
    # What a source lacks goes to those with most left.
    for k in np.argsort(-(counts - left), kind="stable") if over.any() else ():
        more = min(n - left.sum(), counts[k] - left[k])
        left[k] += more
    yield from dealt(left, first, low, middle, start, end, size)
    yield from dealt(counts - left, first + left, middle, high, start, end, size)


def slots(spark: SparkSession, plan: list[tuple], size: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, source_no, block): what each output slot reads. ``plan``: see ``planned``."""
    number, total, blocks = (np.array(x, np.int64) for x in zip(*((k, s, b) for k, _, _, _, s, b in plan if s), strict=True)) if any(p[4] for p in plan) else (np.empty(0, np.int64),) * 3
    shards = -(-int(total.sum()) // size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["id"].to_numpy():
                for _, n, first in dealt(total, np.zeros_like(total), 0, shards, shard, shard + 1, size):
                    own = np.repeat(np.arange(len(n)), n)
                    at = np.arange(len(own))
                    j = first[own] + at - (np.cumsum(n) - n)[own]
                    key = scramble(number[own].astype(np.uint64) + np.uint64(SEED))
                    block = permuted(j % blocks[own], blocks[own], key)
                    place = np.random.default_rng([SEED, int(shard)]).permutation(len(own))  # sources stand mixed within a shard
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard)), pa.array(place), pa.array(number[own], pa.int32()), pa.array(block)], ["shard", "slot", "source_no", "block"])

    return spark.range(0, shards, 1, max(1, -(-shards // TASK_SHARDS))).mapInArrow(fill, "shard long, slot long, source_no int, block long")


def planned(sources: DataFrame) -> list[tuple]:
    """(source_no, source, size, target, slots, blocks) of each source, by code point, null last."""
    rows = sorted(sources.collect(), key=lambda r: (r.source is None, r.source or ""))  # one row a source
    goal = targets([r.size for r in rows])
    n = [round(t * r.blocks / r.size) if r.size else 0 for t, r in zip(goal, rows, strict=True)]
    return [(k, r.source, r.size, t, s, r.blocks) for k, (r, t, s) in enumerate(zip(rows, goal, n, strict=True))]


PLAN = "source_no int, source string, source_size long, target double, slots long, blocks long"


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the mix takes.

    First: one row a document: doc_id, tie, size, source_no, source_size, target, taken, and parts: (from, to, times, block)
    in words for each of its stretches within a block. Second: the mix itself, (shard, slot, source_no, block).
    """
    spark = docs.sparkSession
    rows = store.written(sized(docs), "sized")
    placed, sources = laid(rows)
    chosen = planned(sources)
    picked = slots(spark, chosen)
    plan = spark.createDataFrame(chosen, PLAN)
    times = picked.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    same = placed["source"].eqNullSafe(plan["source"])
    # One row a source.
    own = placed.join(F.broadcast(plan) if len(chosen) <= FEW_SOURCES else plan.hint("merge"), same).select("doc_id", "tie", "size", "chunk", "start", "first_block", "source_no", "source_size", "target")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)))
    pieces_ = own.withColumn("k", F.explode_outer(span)).withColumn("block", F.col("first_block") + F.col("k"))
    # Slots grow with the corpus, but come from a plan of a few rows, by whose size the planner would broadcast them.
    met = pieces_.join(times.hint("merge"), ["source_no", "block"], "left")
    low = F.greatest(F.col("k") * BLOCK - F.col("start"), F.lit(0))
    high = F.least((F.col("k") + 1) * BLOCK - F.col("start"), F.col("size"))
    part = F.struct(low.alias("from"), high.alias("to"), F.coalesce("times", F.lit(0)).alias("times"), "block")
    key = ["doc_id", "tie", "size", "source_no", "chunk", "start", "source_size", "target"]
    taken = F.coalesce(F.sum((high - low) * F.coalesce("times", F.lit(0))), F.lit(0)).cast("long")
    # A document's stretches are as many as its blocks.
    done = met.groupBy(*key).agg(taken.alias("taken"), F.sort_array(F.collect_list(F.when(F.col("times") > 0, part))).alias("parts"), F.count("*").alias("rows"))
    return done, picked


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    done, _ = mix(docs)
    # Documents of no words share every column of the key if their ids and texts are equal: they are told apart by count.
    copies = F.when(F.col("size") == 0, F.sequence(F.lit(1), F.col("rows").cast("int"))).otherwise(F.array(F.lit(1)))
    return done.withColumn("copy", F.explode(copies)).select("doc_id", "size", "source_size", "target", "taken")


def parted(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, with mix_parts, mix_source and mix_start."""
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    # Copies of one row (same doc_id and text) differ in their place: the n-th copy gets the n-th place.
    copy = lambda order: F.row_number().over(Window.partitionBy("mix_key", "doc_id").orderBy(*order))
    source = F.col("source").cast("string")
    left = docs.withColumn("mix_key", key).repartition("mix_key").withColumn("mix_n", copy([source.asc_nulls_last()]))
    places = done.select("doc_id", F.xxhash64("doc_id", "tie").alias("mix_key"), "chunk", "source_no", "start", "taken", "parts")
    right = places.repartition("mix_key").withColumn("mix_m", copy(["source_no", "chunk", "start"]))
    right = right.where("taken > 0").select("mix_key", F.col("doc_id").alias("mix_id"), "mix_m", F.col("parts").alias("mix_parts"), F.col("source_no").alias("mix_source"), F.col("start").alias("mix_start"))
    # One key, so that texts are shuffled once; the rest of the condition is checked on the few rows of a key.
    return left.join(right, "mix_key").where("mix_n - mix_m = 0 and doc_id <=> mix_id").drop("mix_key", "mix_n", "mix_m", "mix_id")


def stretches(column: pa.Array, parts: pa.Array) -> Iterator[list[tuple[dict, bytes]]]:
    """Each text's parts with their bytes, from a part's first word to where the next word after it starts."""
    data, off = buffers(column)
    starts, _, rows = words(data, off)
    for k, parts_ in enumerate(parts.to_pylist()):
        cut = np.append(starts[rows[k] : rows[k + 1]], off[k + 1])
        cut[0] = off[k]
        yield [(p, bytes(data[cut[p["from"]] : cut[p["to"]]])) for p in parts_]


def mixed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (its columns) as the mix takes them: each text holds its stretches as often as the mix reads them; texts of which it reads nothing are gone."""
    names, at = docs.columns, docs.columns.index("text")
    joined = parted(docs, mix(docs)[0]).select(*names, "mix_parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces((b.set_column(at, "text", b.column(at).cast(pa.large_string())) for b in returned(batches))):
            out = []
            for own in stretches(piece.column(at), piece.column(len(names))):
                # Only a text's last stretch can end in a word.
                out.append(b"".join((b"" if SPACE[part[-1]] else b"\n").join([part] * p["times"]) for p, part in own).decode())
            new = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(piece.columns[: len(names)])], names)

    mixed = joined.mapInArrow(run, docs.schema)
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else mixed


def mixed_shards(docs: DataFrame) -> DataFrame:
    """(shard, slot, source_no, text): the output shards, each slot with its block's words. A block's stretches are joined by a newline."""
    done, picked = mix(docs)
    joined = parted(docs, done).select(F.col("text").cast("string").alias("text"), "mix_parts", "mix_source", "mix_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = [(source, p["block"], start + p["from"], part.decode().rstrip(" \t\n\v\f\r")) for own, source, start in zip(stretches(piece["text"], piece["mix_parts"]), piece["mix_source"].to_pylist(), piece["mix_start"].to_pylist(), strict=True) for p, part in own]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["source_no", "block", "start", "text"])

    parts = joined.mapInArrow(run, "source_no int, block long, start long, text string")
    # BLOCK words, so BLOCK stretches at most.
    blocks = parts.groupBy("source_no", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return picked.join(blocks.hint("merge"), ["source_no", "block"]).select("shard", "slot", "source_no", "text")
