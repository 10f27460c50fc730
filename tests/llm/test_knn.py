import math

import numpy as np
import pytest

from tremorframe.llm import knn


def brute(rows, k, every=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(ok, reverse=True)}.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def rows(kind, n=500):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8)) * 4
    out = []
    for i in range(n):
        v = r.normal(size=8) * 0.2 + (centres[i % 6] if kind == "clustered" else 0)
        out.append((i, [float(np.float32(x)) for x in v]))
    if kind == "copies":
        out = [(i, out[3][1] if i % 3 else v) for i, v in out]
    return out


@pytest.mark.parametrize("kind", ["plain", "clustered", "copies"])
def test_equals_brute_force(spark, kind):
    data = rows(kind) + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, [0.5, 2.0]), (None, [1.0] * 8), (1080, []), (1101, [3.0] * 8), (1101, [3.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rank int")
    got = knn.top_k(df, queries=9, rows=60).collect()
    assert {tuple(r) for r in got} == brute(data, 20) and len(got) == len(set(map(tuple, got)))


@pytest.mark.parametrize("n", [21, 22, 300])
def test_one_block_of_the_defaults(spark, n):
    data = rows("plain", n)
    got = knn.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert {tuple(r) for r in got} == brute(data, 20) and len(got) == 20 * len(range(0, n, 20))


def test_bounds_prune_clustered_data():
    p = np.array([[100, 0], [0, 100], [-100, 0]])
    use = knn.needed(p, np.array([1.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0]), [(c, 1.0, 50) for c in range(3)], 20)
    assert use.tolist() == [[True, False, False], [False, True, False], [False, False, True]]


def test_large_values_and_few_rows(spark):
    data = [(0, [1e12, -3.5]), (20, [2e12, 1.0]), (7, [1e12, 9.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    with pytest.raises(Exception):  # noqa: B017  scores beyond 64 bits are an error, not a wrong number
        assert {tuple(r) for r in knn.top_k(df).collect()} == brute(data, 20)
    small = [(i, [x / 1e6 for x in v]) for i, v in data]
    assert {tuple(r) for r in knn.top_k(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()} == brute(small, 20)
    assert knn.top_k(df.limit(0)).collect() == []
