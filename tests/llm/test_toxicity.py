import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tremorframe.llm import toxicity as tx

BAD = ["idiot", "moronic", "Scumbag"]


def rows(n=600, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "the", "on", "re", "sti", "lo"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        t = [word() for _ in range(r.randint(3, 60))]
        toxic = k % 4 == 0
        if toxic:
            t.insert(r.randrange(len(t)), r.choice(BAD) + r.choice(["", ".", ","]))
        docs.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows()
    more = [(None, "x"), (9001, None), (9002, ""), (9003, "i d i o t"), (9004, "z" * 200000), (9005, "I-D-I-O-T!")]
    d = spark.createDataFrame([(k, t, "en", 0.5) for k, t in docs + more], "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([*labels, (3, None), (77777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(d, lab).collect()}
    assert len(got) == len(docs) + len(more)
    truth = dict(labels)
    held = [k for k in truth if got[k].held_out]
    assert set(held) == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([got[k].predicted == truth[k] for k in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9001].score == got[9002].score < 0.5 and got[9003].predicted == got[9005].predicted == 1 and not got[None].held_out


def test_collapsed_weights_equal_the_kernel():
    """Explicit subsequence sums give the kernel's values, computed here pair by pair."""
    def phi(w):
        s, out = [0, *(tx.CLASS[c] for c in w.encode() if tx.CLASS[c] != tx.DROPPED)], {}
        for i in range(len(s)):
            for a, b, weight in tx.STEPS:
                if i + a + b < len(s):
                    u = (s[i], s[i + a], s[i + a + b])
                    out[u] = out.get(u, 0) + weight
        return out

    weights = np.zeros(tx.SYMBOLS**3, np.float32)
    for (a, b, c), w in phi("idiot").items():
        weights[(int(a) * 64 + int(b)) * 64 + int(c)] = w
    m = tx.Machine(weights, 0.0, 1.0, 0.0)
    for w in ["idiot", "idxiot", "toidi", "ü", "a", "1diot", "id-iot"]:
        data, off = tx.buffers(pa.array([w]))
        sym, woff = tx.symbols(data, off[:-1], np.diff(off))
        want = sum(v * phi("idiot").get(u, 0) for u, v in phi(w).items()) / tx.norms(woff)[0]
        assert abs(m.word_values(sym, woff)[0] - want) < 1e-4


def plain_value(m, text):
    """The value of the worst word, and of runs of single letters as one word, from the weights by definition."""
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    symbols = lambda w: [int(tx.CLASS[c]) for c in w.encode() if tx.CLASS[c] != tx.DROPPED]
    units = [symbols(w) for w in re.findall(r"[^\x20\x09-\x0d]+", low)]
    run = []
    for u in [*units, []]:
        if len(u) == 1 and u[0] != 27:
            run.append(u[0])
            continue
        if len(run) >= 3:
            units.append(run)
        run = []
    values = [m.bias]
    for s in ([0, *u] for u in units):
        norm = sum(w * w * max(len(s) - a - b, 0) for a, b, w in tx.STEPS)
        total = sum(w * m.weights[(s[i] * 64 + s[i + a]) * 64 + s[i + a + b]] for a, b, w in tx.STEPS for i in range(len(s) - a - b))
        values.append(total / math.sqrt(max(norm, 1e-9)) + m.bias)
    return max(values[1:]) if units else m.bias


def test_query_equals_a_plain_version(spark):
    """Scores of all texts are the logistic of the trained machine's worst word, computed here text by text."""
    docs, labels = rows(200, 8)
    docs += [(5000, None), (5001, ""), (5002, "i d i o t"), (5003, "Ü Ö ?! 7 8 9"), (5004, "a b"), (5005, "x y z " * 50)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = tx.train(d, lab)
    got = {r.doc_id: r.score for r in tx.toxicity(d, lab).collect()}
    for k, t in docs:
        assert math.isclose(got[k], 1 / (1 + math.exp(-(m.slope * plain_value(m, t) + m.shift))), abs_tol=1e-4), (k, t)


def test_machine_is_the_kernel_expansion():
    """Nyström features of a linear machine, collapsed to weights, give the kernel's expansion over the landmarks."""
    bags = [["idiot", "the"], ["and", "then"], ["idiots"], ["other"], ["idxiot", "on"], ["none", "so"]]
    m = tx.fit(bags, [1, 0, 1, 0, 1, 0])
    # A solution in the landmarks' span: every weight belongs to a subsequence of a word that was seen.
    seen = set()
    for w in {x for b in bags for x in b}:
        data, off = tx.buffers(pa.array([w]))
        sym, woff = tx.symbols(data, off[:-1], np.diff(off))
        seen |= {int(c) for _, code, _ in tx.occurrences(sym, woff) for c in code}
    assert set(np.flatnonzero(m.weights).tolist()) <= seen
    scores = m.scores(pa.array(["you idiot", "idi-ot", "the other", "idiiot"]))
    # Six texts give no sharp scores, but insults with a hyphen or a doubled letter rank over harmless words.
    assert min(scores[0], scores[1], scores[3]) > scores[2] + 0.1


def test_squared_hinge_reaches_the_optimum():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(80, 5)), np.sign(r.normal(size=80))
    weight = r.uniform(0.5, 2, 80)
    theta = tx.squared_hinge(x, y, weight)
    cost = lambda t: t[:-1] @ t[:-1] / 2 + 1e-6 * t[-1] ** 2 / 2 + 5 * (weight * np.maximum(0, 1 - y * (x @ t[:-1] + t[-1])) ** 2).sum()
    best = cost(theta)
    assert all(cost(theta + 1e-3 * r.normal(size=6)) >= best - 1e-9 for _ in range(200))


def test_one_class_and_empty(spark):
    docs, _ = rows(30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in tx.toxicity(d, none).collect()} == {0}
    ones = spark.createDataFrame([(k, 1) for k, _ in docs], "doc_id long, toxic int")
    assert {r.predicted for r in tx.toxicity(d, ones).collect()} == {1}
    assert tx.toxicity(d.limit(0), none).collect() == []
