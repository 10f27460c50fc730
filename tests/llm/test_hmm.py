import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tremorframe.llm import hmm, store


def paths(m, e, seq):
    """(probability, expected starts, moves and counts by word) by way of all paths of states."""
    total, start, move, g = 0.0, np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros_like(e)
    for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
        p = m.start[path[0]] * e[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * e[o, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for o, s in zip(seq, path):
            g[o, s] += p
    return total, start / total, move / total, g / total


def test_recursions_equal_all_paths(monkeypatch):
    r = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Model(norm(r.random(hmm.STATES)), norm(r.random((hmm.STATES, hmm.STATES))), np.ones(hmm.STATES), 1.0)
    e = 1 + 9 * r.random((10, hmm.STATES))
    seqs = [[3, 1, 4, 1, 5], [5, 9], [2], [1, 1, 3]]
    want = [paths(m, e, s) for s in seqs]
    for every in (1, 3, 8):
        monkeypatch.setattr(hmm, "EIGHTH", every)
        steps = hmm.Steps(np.concatenate(seqs), np.array([len(s) for s in seqs]))
        for limit in (1, 5, 100):
            assert np.allclose(steps.likelihood(m, e, limit), [math.log(w[0]) for w in want])
            total, g = hmm.Sums.zero(), np.zeros_like(e)
            steps.count(m, e, total, g, limit)
            for got, k in ((total.start, 1), (total.move, 2), (g, 3)):
                assert np.allclose(got, sum(w[k] for w in want))
            assert np.allclose(total.mass, g.sum(0)) and math.isclose(total.likely, sum(math.log(w[0]) for w in want))


def test_long_sequences_stay_finite():
    r = np.random.default_rng(2)
    m = hmm.Model.of_sums(hmm.Sums(0.0, r.random(hmm.STATES), r.random((hmm.STATES, hmm.STATES)), np.ones(hmm.STATES)))
    e = 1 + 1e12 * r.random((50, hmm.STATES)) ** 8
    steps = hmm.Steps(r.integers(0, 50, 20_000), np.array([15_000, 5_000]))
    g = np.zeros_like(e)
    steps.count(m, e, hmm.Sums.zero(), g)
    assert np.isfinite(steps.likelihood(m, e)).all() and math.isclose(g.sum(), 20_000)


def test_scores(spark):
    r = random.Random(4)
    texts = [None, "", " \n", "The the THE", "zq " * 3000]
    for _ in range(150):
        t = []
        for _ in range(r.choice([1, 5, 60])):
            t += ["the", r.choice(["cat", "dog", "Ü"]), r.choice(["runs", "sits"])]
        texts.append(" ".join(t) + r.choice(["", f" rare{r.randrange(30)}"]))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "the null"), (7, "twice"), (7, "twice")]
    got = hmm.hmm_scores(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, c int")).collect()
    tok = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for d, t in rows)
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 for g in got)
    out = [g for g in got if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def scores_by_hand(docs, held, steps):
    """Baum-Welch over all texts in one process, from the same start: log10 likelihoods."""
    start = hmm.started(hmm.sample(docs, 1))
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    keys, tokens, n = hmm.numbered(hmm.pa.array(texts))
    train = ~np.array(held)
    own = tokens[np.repeat(train, n)]
    e, model = start.emissions(keys), start.model
    for _ in range(steps):
        total, g = hmm.Sums.zero(), np.zeros((len(keys), hmm.STATES))
        hmm.Steps(own, n[train]).count(model, e, total, g)
        model = hmm.Model.of_sums(total)
        e = model.emissions(g)
    size = len(own) + len(set(own.tolist())) + 1
    return (hmm.Steps(tokens, n).likelihood(model, e) - n * math.log(size)) / math.log(10), e / size, 1 / size, sorted(set(own.tolist()))


def test_parts_and_buckets_equal_one_process(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BUCKET_BYTES", 500)
    monkeypatch.setattr(hmm, "LEAST_BYTES", 300)
    r = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"{'xy'[k % 2]}{r.randrange(20)}" for _ in range(r.randrange(12)))) for k in range(200)], "doc_id long, text string").repartition(5)
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(200)]
    before = -np.inf
    for steps in (1, 3):
        want, emit, unseen, trained = scores_by_hand(docs, held, steps)
        got = [x.score for x in hmm.hmm_scores(docs, steps).orderBy("doc_id").collect()]
        assert np.allclose(got, want, rtol=1e-4)  # 16-bit shares
        # The training tokens and one unseen token sum to 1 in every state.
        assert np.allclose(emit[trained].sum(0) + unseen, 1)
        now = sum(x for x, h in zip(got, held) if not h)
        assert now >= before - 1e-2
        before = now


def test_each_part_has_a_task_of_its_own(spark, monkeypatch):
    """A task's rows are in memory at once, so no task may get several parts."""
    monkeypatch.setattr(hmm, "LEAST_BYTES", 300)
    r, seen, by_part = random.Random(6), [], hmm.by_part
    monkeypatch.setattr(hmm, "by_part", lambda *a: seen.append(by_part(*a)) or seen[-1])
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randrange(50)}" for _ in range(10))) for k in range(300)], "doc_id long, text string").repartition(7)
    assert hmm.hmm_scores(docs, 2).count() == 300
    met = seen[-1].select("part", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(met) == len({m.part for m in met}) == len({m.task for m in met}) >= 7


def test_large_rows_are_not_written_a_file_at_a_time(spark, monkeypatch):
    """The tables of parts hold few rows of up to a MB or more, small ones first."""
    asked, written = [], store.written
    monkeypatch.setattr(store, "written", lambda *a: asked.append(a) or written(*a))
    assert hmm.hmm_scores(spark.createDataFrame([(1, "a b"), (3, "a")], "doc_id long, text string"), 2).count() == 2
    assert {a[1] for a in asked} == {"parts", "words", "step"}
    rows = spark.range(13).select("id", F.when(F.col("id") == 0, F.lit("x")).otherwise(F.repeat(F.md5(F.col("id").cast("string")), 40_000)).cast("binary").alias("data"))
    for _, name, *how in asked:
        (file,) = written(rows.coalesce(1), name, *how).inputFiles()
        found = pq.ParquetFile(file.removeprefix("file://")).metadata
        assert found.num_rows == 13 and max(found.row_group(k).total_byte_size for k in range(found.num_row_groups)) < 8 << 20


def test_training_runs_until_it_gains_little(spark):
    r = random.Random(5)
    sides = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    docs = spark.createDataFrame([(k, " ".join(r.choice(sides[k % 2]) for _ in range(30))) for k in range(300)], "doc_id long, text string")
    rows = [x for x in hmm.hmm_scores(docs).collect() if x.held_out]
    # The side of a text halves the words that may come: log10(2) a word at most.
    assert sum(x.score - x.base_score for x in rows) > 0.2 * sum(x.n_tokens for x in rows)


def test_nothing_to_learn(spark):
    assert hmm.hmm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    (r,) = hmm.hmm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def shuffle_mb(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        f = files.next()
        total += f.length() if f.getName().startswith("shuffle_") else 0
    return total / 1e6


def test_disk_holds_the_parts_and_one_round(spark, monkeypatch):
    """Neither shuffles of earlier rounds nor words that are summed stay, and after the first step words travel without keys and places."""
    monkeypatch.setattr(hmm, "LEAST_BYTES", 40_000)
    monkeypatch.setattr(hmm, "BUCKET_BYTES", 200_000)
    r, tables, written = np.random.default_rng(8), [], store.written
    vocabulary = np.array([f"w{k}" for k in range(4000)])
    rows = [(k, " ".join(vocabulary[r.integers(0, 4000, 1500)])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)

    def kept(*a):
        done = written(*a)
        size = {s.seq: s for s in done.groupBy("seq").agg(F.sum(F.octet_length("data")).alias("n"), F.countDistinct("part").alias("parts")).collect()} if "seq" in done.columns else {}
        tables.append((a[1], size))
        return done

    monkeypatch.setattr(store, "written", kept)
    before = shuffle_mb(spark)
    assert hmm.hmm_scores(docs, 3).count() == 300
    texts = sum(x.n for name, size in tables if name == "parts" for seq, x in size.items() if seq >= 0) / 1e6
    for _ in range(50):  # files go in the background
        if (left := shuffle_mb(spark) - before) < 0.5 * texts:
            break
        time.sleep(0.2)
    assert left < 0.5 * texts
    # What the buckets are told of a word (nearly all parts have all): count and shares, not its key and place, which take 9 bytes and more.
    asked = [size[hmm.WORDS] for name, size in tables if name == "step" and size]
    assert sum(x.n for x in asked) < 15 * 4000 * sum(x.parts for x in asked)


def test_rounds_take_every_part_once(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEAST_BYTES", 300)
    seen, by_part = [], hmm.by_part
    monkeypatch.setattr(hmm, "by_part", lambda rows, parts: seen.append(list(parts)) or by_part(rows, parts))
    r = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randrange(50)}" for _ in range(10))) for k in range(600)], "doc_id long, text string").repartition(40)
    assert hmm.hmm_scores(docs, 2).count() == 600
    one, two = seen[: len(seen) // 2], seen[len(seen) // 2 :]
    assert one == two and len(one) > 1
    assert [p for x in one for p in x] == sorted({p for x in one for p in x})
    assert [hmm.rounds(n, 6) for n in (1, 11, 12, 25, 50)] == [[(0, 1)], [(0, 11)], [(0, 6), (6, 12)], [(0, 6), (6, 12), (12, 18), (18, 25)], [(0, 12), (12, 25), (25, 37), (37, 50)]]


def test_a_column_named_folder_is_a_column(spark):
    rows = spark.createDataFrame([("007", 1), (None, 2)], "folder string, k int")
    done = store.written(rows, "t")
    assert done.columns == rows.columns and sorted(tuple(r) for r in done.where("k = 1").collect()) == [("007", 1)]
    assert all("=" not in f for f in done.inputFiles())
