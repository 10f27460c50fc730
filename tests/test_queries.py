"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
import os

import pytest

from tremorframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__module__ == "decimal":
        return None if math.isnan(v) else round(float(v), 5)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        for a, b in zip(got, want_rows := rows(want.columns, want.fetchall())):
            assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)
        assert len(got) == len(want_rows)
    else:
        assert got
