import random
import re

from tremorframe.llm import decontaminate as dc


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).encode()


def brute(doc, item):
    """The best local alignment, match 1 and edit -Q, over the whole matrix."""
    a, b = norm(item), norm(doc)
    prev, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (1 if x == y else -dc.Q), prev[j + 1] - dc.Q, row[j] - dc.Q))
        prev, best = row, max(best, *row)
    return best


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("the of and er ing th on an re ha ti en ñé".split()) + r.choice(["", "er", "ing", "at", "on", "ü"])
    items = [(k, r.choice([" ", "\n"]).join(word() for _ in range(n))) for k, n in enumerate([1, 3, 6, 9, 20, 30, 60])]
    items += [(50, None), (51, ""), (6, items[6][1])]
    docs = []
    for k in range(60):
        text = [word() for _ in range(r.choice([0, 5, 40, 90]))]
        if k % 2:
            piece = list(r.choice(items[2:7])[1])
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                at = r.randrange(len(piece))
                piece[at : at + 1] = r.choice([[], ["x"], [piece[at], "y"], [piece[at].upper()]])
            cut = r.randrange(1 + len(piece) // 2) if k % 3 == 0 else 0
            text.insert(r.randrange(len(text) + 1), "".join(piece[cut:]))
        docs.append((k, r.choice([" ", "  ", " \n"]).join(text)))
    docs += [(100, None), (101, ""), (102, "z" * 200000), (3, docs[3][1]), (None, items[6][1])]
    got = dc.leaks(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((str(d), i, s) for d, t in docs for i, x in items if d != 102 if len(norm(x)) > dc.Q and (s := brute(t, x)) >= min(dc.LEAST, len(norm(x))))
    assert sorted((str(g.doc_id), g.item_id, g.score) for g in got) == want
    assert len(want) > 25
    for g in got:
        text = next(t for d, t in docs if d == g.doc_id)
        assert g.score <= g.doc_end - g.doc_start + 3 * dc.Q and 0 <= g.doc_start < g.doc_end <= len(text)


def test_repetitive_texts_stay_in_memory():
    """An item of 1,500 equal letters and a text of 20,000: 30 million shared q-grams."""
    import tracemalloc

    import pyarrow as pa

    index = dc.Index([1], ["z" * 1500])
    data, off, _ = dc.normal(pa.array(["z" * 20_000]))
    tracemalloc.start()
    (doc,), (item,), (score,), *_ = index.best(data, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (doc, item, score) == (0, 0, 1500) and peak < 600 << 20


def test_blocks_and_empty(spark):
    item = "a passage of the benchmark that is long enough to be found again"
    docs = spark.createDataFrame([(1, "before it " + item.upper() + " after it"), (2, "something else")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, item) for k in range(3)], "item_id long, text string")
    (g, *rest) = dc.leaks(docs, bench, block_bytes=50).collect()
    assert len(rest) == 2 and {r.doc_id for r in [g, *rest]} == {1} and (g.doc_start, g.doc_end) == (10, 10 + len(item))
    assert dc.leaks(docs, bench.limit(0)).collect() == [] and dc.leaks(docs.limit(0), bench).collect() == []
