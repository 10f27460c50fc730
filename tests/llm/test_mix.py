import math
import random

import numpy as np

from tremorframe.llm import mix as mx


def rows(n=300, seed=2):
    r = random.Random(seed)
    out = []
    for k in range(n):
        source = r.choice(["a", "a", "a", "a", "b", "c", "ä", None])
        out.append((k, " ".join(f"w{k}.{i}" for i in range(r.choice([0, 1, 40, 200, 900]))), source, 0))
    return out


def test_targets():
    assert mx.targets([100, 100, 100]) == [200.0, 2 * 250 / 3, 250 / 3]
    assert mx.targets([10, 0, 10]) == [20.0, 0.0, 10.0]
    assert mx.targets([]) == []
    assert sum(mx.targets([1000, 10, 5])) == 1.5 * 1015


def test_permutation():
    for n in (1, 2, 3, 64, 65, 1000):
        j = np.arange(n)
        p = mx.permuted(j, np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(p) == list(range(n))


def test_mix(spark):
    data = rows() + [(1000, None, "a", 0), (None, "x y z", "b", 0), (2007, "same text", "c", 0), (2007, "same text", "c", 0), (2008, "", "c", 0), (2008, "", "c", 0)]
    docs = spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, source string, n_chars long, chunk string")
    got = mx.mixed_sizes(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mx.mixed_sizes(docs.repartition(5)).collect()))
    size = lambda t: len((t or "").split())
    by = {}
    for d, t, s, _ in data:
        by[s] = by.get(s, 0) + size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mx.targets([by[s] for s in order])))
    assert sorted((str(g.doc_id), g.size) for g in got) == sorted((str(d), size(t)) for d, t, _, _ in data)
    for s in order:
        mine = [g for g in got if g.source_size == by[s] and g.target == goal[s]]
        assert sum(g.size for g in mine) == by[s]
        assert math.isclose(sum(g.taken for g in mine), goal[s], rel_tol=0.02, abs_tol=2 * mx.BLOCK)
    assert all(0 <= g.taken <= 2 * g.size for g in got)
    texts = mx.mixed_texts(docs).collect()
    assert sorted((str(t.doc_id), size(t.text)) for t in texts) == sorted((str(g.doc_id), g.taken) for g in got if g.taken)
    shards = mx.mixed_shards(docs).collect()
    assert sum(size(t.text) for t in shards) == sum(g.taken for g in got)
    assert sorted((t.shard, t.slot) for t in shards) == [(k // mx.SHARD_SLOTS, k % mx.SHARD_SLOTS) for k in range(len(shards))]
    assert sorted(w for t in shards for w in t.text.split()) == sorted(w for t in texts for w in t.text.split())
    source = {d: (t or "").split() for d, t, _, _ in data}
    assert all(set(t.text.split()) <= set(source[t.doc_id]) and t.n_chars == len(t.text) for t in texts)


def test_shards_are_multinomial_and_whole():
    total, size = np.array([70_000, 25_000, 5_000, 40]), 1000
    shards = -(-int(total.sum()) // size)
    every = list(mx.dealt(total, np.zeros_like(total), 0, shards, 0, shards, size))
    counts = np.array([n for _, n, _ in every])
    assert [s for s, _, _ in every] == list(range(shards)) and (counts.sum(0) == total).all() and (counts >= 0).all()
    assert (counts.sum(1)[:-1] == size).all()
    assert (np.array([f for _, _, f in every]) == np.cumsum(counts, 0) - counts).all()
    p = total / total.sum()
    # Shares spread as a multinomial's do.
    assert 0.6 < (counts[:-1, 0].std() / np.sqrt(size * p[0] * (1 - p[0]))) < 1.4
    # Any range is drawn alike without the others.
    part = list(mx.dealt(total, np.zeros_like(total), 0, shards, 37, 40, size))
    assert [tuple(n) for _, n, _ in part] == [tuple(n) for n in counts[37:40]]


def test_taken_equals_a_plain_version(spark):
    """Chunks laid end to end, cut into blocks, and read by the permuted slots, in plain Python."""
    data = rows(80, 5)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    ties = {r.doc_id: (r.tie, r.chunk) for r in docs.selectExpr("doc_id", "xxhash64(text) AS tie", f"pmod(xxhash64(doc_id, xxhash64(text)), {max(1, -(-len(data) // mx.CHUNK))}L) AS chunk").collect()}
    by = {}
    for d, t, s, _ in data:
        by.setdefault(s, []).append((ties[d][1], d, ties[d][0], len(t.split())))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = mx.targets([sum(x[3] for x in by[s]) for s in order])
    want = {}
    for k, s in enumerate(order):
        words, block, last, at = [], 0, None, 0
        for chunk, d, _, n in sorted(by[s]):
            if chunk != last and last is not None:
                block, at = block + -(-at // mx.BLOCK), 0
            last = chunk
            words += [(d, block + (at + i) // mx.BLOCK) for i in range(n)]
            at += n
        blocks = block + -(-at // mx.BLOCK)
        slots = round(goal[k] * blocks / max(len(words), 1))
        read = np.zeros(max(blocks, 1), int)
        for j in range(slots):
            key = mx.scramble(np.array([k], np.uint64) + np.uint64(mx.SEED))
            read[mx.permuted(np.array([j % blocks]), np.array([blocks]), key)[0]] += 1
        for d, b in words:
            want[d] = want.get(d, 0) + int(read[b])
    assert {g.doc_id: g.taken for g in mx.mixed_sizes(docs).collect()} == {d: want.get(d, 0) for d, _, _, _ in data}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mx.mixed_sizes(docs).collect() == [] and mx.mixed_texts(docs).collect() == []
