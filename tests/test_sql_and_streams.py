import pytest

from tests.test_sources import HOLE, RING
from tremorframe.functions import geometry as g
from tremorframe.functions import sql
from tremorframe.streaming import replay


def footprints(spark, n=3):
    ring = lambda r, k: [{"x": p[0] + 10 * k, "y": p[1]} for p in r]
    return spark.createDataFrame([(k, {"exterior": ring(RING, k), "interiors": [ring(HOLE, k)] if k % 2 else []}) for k in range(n)], f"id long, geometry {g.POLYGON}")


def test_sql_functions(spark):
    sql.register(spark)
    footprints(spark).createOrReplaceTempView("b")
    rows = spark.sql("SELECT id, poly_area(geometry) a, ring_perimeter(geometry.exterior) p, position_class(1D, 0D, 1D, 0D) c FROM b ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(0, 12.0, 14.0, "corner"), (1, 11.0, 14.0, "corner"), (2, 12.0, 14.0, "corner")]


def test_stream_equals_table(spark, tmp_path):
    table = footprints(spark, 6)
    table.write.parquet(str(tmp_path / "in"))
    stream = replay.measured(replay.buildings(spark, str(tmp_path / "in"), f"id long, geometry {g.POLYGON}"))
    run = stream.writeStream.format("memory").queryName("measured").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("measured").collect())
    want = sorted(tuple(r) for r in replay.measured(table).collect())
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a == pytest.approx(b) for a, b in zip(got, want))


def test_exposure_by_window(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 3} 0{k}:00:00", "ab"[k % 2], float(k)) for k in range(6)]
    spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp) t", "k", "v").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("t timestamp, k string, v double").parquet(str(tmp_path / "e"))
    run = replay.exposure(stream, "t", "k", "v").writeStream.format("memory").outputMode("complete").queryName("exposure").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sum(r.n for r in spark.table("exposure").collect()) == 6
