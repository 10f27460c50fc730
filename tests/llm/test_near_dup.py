import random
import re

import numpy as np
import pyarrow as pa

from tremorframe.llm import near_dup as nd


def brute(rows):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        for j in range(i):
            if rows[j][0] == d:
                parent[top(i)] = top(j)
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return {(d, len(sets[i]), low[top(i)], d == low[top(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts = ["", "   ", "one two", "One TWO", "a b c d", "é à ü ß ñ"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([5, 9, 30, 80, 400]))]
        for k in range(r.choice([1, 2, 3, 12])):
            c = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                c[r.randrange(len(c))] = word()
            texts.append(r.choice([" ", "\n", "  "]).join(c))
    base = [word() for _ in range(100)]
    for k in range(100):  # a chain: neighbours are linked, ends are not
        texts.append(" ".join([*base[k:], *(f"w{j}" for j in range(k))]))
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = nd.near_duplicates(spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, id int, key string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_large_buckets_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL_BUCKET", 2)
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = corpus(2)
    assert {tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    t = "a b c d e f g"
    rows = [(None, t), (4, None), (4, t), (4, t), (9, t), (2, None), (5, "x" * 100000), (None, None)]
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (4, 0, 4, True), (4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (2, 0, 2, True), (5, 1, 5, True), (None, 0, None, True)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_id_with_several_texts(spark):
    a, b, c = "one two three four five six seven", "all other words stand in this text", "a third one that nobody shares at all"
    rows = [(2, a), (4, a), (4, b), (9, b), (4, None), (7, c), (7, c), (8, c.upper())]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, tie string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect())
    assert got == [(2, 3, 2, True), (4, 0, 2, False), (4, 3, 2, False), (4, 3, 2, False), (7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (9, 3, 2, False)]
    stay = sorted((r.doc_id, r.text or "") for r in nd.one_of_each(docs).collect())
    assert stay == [(2, a), (4, ""), (4, b), (7, c)]
    assert nd.one_of_each(docs).columns == docs.columns


def test_registers_follow_jaccard_and_merge():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    ka, kb, kab = (nd.registers(np.unique(s), np.array([0, len(np.unique(s))]))[0] for s in (a, b, np.concatenate([a, b])))
    assert (np.maximum(ka, kb) == kab).all()
    j = nd.likely_jaccard(ka[None], kb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 0.6) < 0.15
    assert nd.registers(np.empty(0, np.uint64), np.array([0, 0])).tolist() == [[0] * nd.REGISTERS]


def test_short_and_long_words_hash_apart():
    h, off = nd.shingle_sets(pa.array(["ab c", "a bc", None, "abcdefgh ijklmnop", "abcdefgh ijklmnoq"]))
    assert np.diff(off).tolist() == [1, 1, 0, 1, 1] and len(set(h.tolist())) == 4
