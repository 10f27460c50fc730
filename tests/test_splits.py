import duckdb
import pytest

from tremorframe.operators import learning
from tremorframe.plans import registry


@pytest.mark.parametrize("name", ["stratified_split", "stratified_folds"])
def test_strata_of_all_sizes_equal_the_sql(spark, name):
    """Shares of a stratum that end in a half (31.5 of 45 rows) round up; rows without a key come last."""
    rows = [(1000 * n + i, n) for n in range(1, 101) for i in range(n)] + [(None, 7)] * 3 + [(i, None) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, label int")
    split = name == "stratified_split"
    got = learning.stratified_split(df, "vec_id", ["label"]) if split else learning.folds(df, "vec_id", "label")
    embeddings = got.select("vec_id", "label").toArrow()  # noqa: F841 (DuckDB reads it by name)
    want = duckdb.sql(registry.SQL[name]).fetchall()
    assert sorted(map(tuple, got.select("vec_id", "label", "split" if split else "fold").collect()), key=str) == sorted(want, key=str)
    if split:
        assert sum(r.label == 45 and r.split == "train" for r in got.collect()) == 32
