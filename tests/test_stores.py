"""Sources and stores that the other tests leave out, and the small steps of data preparation."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import area
from tremorframe.functions import geometry as g
from tremorframe.operators import learning, raster, vision
from tremorframe.sources import readers, stores


def test_wkt_parts(spark, tmp_path):
    text = ["MULTIPOLYGON (((0 0, 4 0, 4 3, 0 3, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)), ((10 0, 11 0, 11 1, 10 1, 10 0)))", "multipolygon z(((0 0 7,4 0 7,4 3 7,0 3 7,0 0 7)))", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON EMPTY", "POINT (1 2)", None]
    df = spark.createDataFrame(list(enumerate(text)), "id long, geometry string")
    want = [(0, 1.0), (0, 11.0), (1, 12.0), (2, 1.0), (3, None), (4, None), (5, None)]
    assert area(readers.parts(df.withColumn("geometry", g.polygons_from_wkt(F.col("geometry"))))) == want
    df.write.parquet(str(tmp_path / "p"))
    assert area(readers.geoparquet(spark, str(tmp_path / "p"))) == want
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert area(readers.csv_wkt(spark, str(tmp_path / "c"), "id long, geometry string")) == want


def test_excel(spark, tmp_path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>area</t></is></c></row>
    <row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>2.5</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>"""
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>n/a</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "a.xlsx")).collect()), key=str) == [("7", "2.5"), (None, "n/a")]
    assert sorted(map(tuple, readers.excel(spark, str(tmp_path / "a.xlsx"), "id int, area double").collect()), key=str) == [(7, 2.5), (None, None)]


def png(values, filters):
    h, w = values.shape
    raw, up = b"", np.zeros(w, int)
    for r in range(h):
        x, a = values[r].astype(int), np.concatenate([[0], values[r, :-1]]).astype(int)
        c = np.concatenate([[0], up[:-1]])
        paeth = np.array([min(((abs(i + j - k - m), n, m) for n, m in enumerate((i, j, k))))[2] for i, j, k in zip(a, up, c)])
        guess = [0 * x, a, up, (a + up) // 2, paeth][filters[r]]
        raw += bytes([filters[r]]) + ((x - guess) % 256).astype(np.uint8).tobytes()
        up = x
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_png_masks(spark, tmp_path):
    values = np.random.default_rng(0).integers(0, 4, (5, 7)).astype(np.uint8)
    (tmp_path / "m.png").write_bytes(png(values, [0, 1, 2, 3, 4]))
    got = {(r.label, r.pixel) for r in readers.png_masks(spark, str(tmp_path)).collect()}
    assert got == {(int(values[r, c]), c * 5 + r) for r in range(5) for c in range(7) if values[r, c]}
    (tmp_path / "n.json").write_text('{"annotations": [{"id": 4, "segmentation": {"size": [5, 7], "counts": [1, 2, 32]}}]}')
    (n,) = readers.mask_notes(spark, str(tmp_path / "n.json")).collect()
    assert (n.note, n.height, n.width, n["counts"]) == (4, 5, 7, [1, 2, 32])


def test_stores(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    at = str(tmp_path / "clean")
    assert stores.cached(spark, at, make).count() == stores.cached(spark, at, make).count() == 5 and len(calls) == 1
    assert stores.cached(spark, at, make, again=True).count() == 5 and len(calls) == 2
    rows = spark.createDataFrame([(k, float(k % 2), k % 2) for k in range(40)], "id long, x double, label int")
    model = learning.fit(rows, "LogisticRegression", ["x"], "label", c=10.0)
    stores.save_model(model, str(tmp_path / "m"), classes=[0, 1])
    again, facts = stores.load_model(spark, str(tmp_path / "m"))
    assert facts == {"classes": [0, 1]} and learning.predict(again, rows, ["x"]).where("prediction <> id % 2").count() == 0
    runs = spark.createDataFrame([("A", "none", "{}", 0.5, 0.1), ("A", "smote", "{}", 0.7, 0.1), ("B", "none", "{}", 0.6, 0.0)], "model string, strategy string, params string, mean_f1 double, std_f1 double")
    stores.append_runs(runs.where("strategy = 'none'"), str(tmp_path / "r"), "one")
    stores.append_runs(runs.where("strategy = 'smote'"), str(tmp_path / "r"), "two")
    assert {(r.model, r.experiment, r.mean_f1) for r in stores.best_of(spark, str(tmp_path / "r")).collect()} == {("A", "two", 0.7), ("B", "one", 0.6)}
    stores.write_report(spark, str(tmp_path / "j"), {"seconds": 1.5, "models": ["A"]})
    assert stores.read_report(spark, str(tmp_path / "j")) == {"seconds": 1.5, "models": ["A"]}


def test_penalty_follows_the_rows(spark):
    """Twice the same rows at half the C give the same machine."""
    rows = spark.createDataFrame([(k, (k % 7) / 3 + (k % 2), k % 2) for k in range(60)], "id long, x double, label int")
    one = learning.fit(rows, "LogisticRegression", ["x"], "label", c=1.0)
    two = learning.fit(rows.union(rows), "LogisticRegression", ["x"], "label", c=0.5)
    assert one.coefficientMatrix.toArray() == pytest.approx(two.coefficientMatrix.toArray(), rel=1e-2)
    other = learning.fit(rows, "LogisticRegression", ["x"], "label", c=0.5)
    assert abs(one.coefficientMatrix.toArray() - other.coefficientMatrix.toArray()).max() > 0.01


def test_coercion_and_columns(spark):
    df = spark.createDataFrame([("1.5", "x"), ("n/a", "y"), (None, "z")], "a string, b string")
    out, lost = learning.numeric(df, ["a"])
    assert [r.a for r in out.orderBy("b").collect()] == [1.5, None, None] and lost.head().a == 1
    assert learning.only(df, ["b"]).columns == ["b"] and learning.only(df, ["b", "c"], required=False).columns == ["b"]
    with pytest.raises(ValueError):
        learning.only(df, ["c"])


def test_places_are_ranks(spark):
    df = spark.createDataFrame([(k, k % 3 if k % 5 else None) for k in range(300)], "id long, s int")
    got = learning.places(df, "id", ["s"]).collect()
    import hashlib

    for s in (0, 1, 2, None):
        own = sorted((r.id for r in got if r.s == s), key=lambda k: (hashlib.md5(f"{k}:0".encode()).hexdigest(), k))
        assert [r.id for r in sorted((r for r in got if r.s == s), key=lambda r: r._k)] == own and {r._n for r in got if r.s == s} == {len(own)}


def test_resampling_and_windows(spark):
    values = np.random.default_rng(1).random((6, 8))
    grid = spark.createDataFrame([(1, r, c, float(values[r, c]) if (r, c) != (0, 0) else None) for r in range(6) for c in range(8)], "raster_id int, row int, col int, value double")
    half = {(r.row, r.col): r.value for r in raster.resampled(grid, 2.0).collect()}
    assert len(half) == 12
    for r in range(3):
        for c in range(4):
            four = values[2 * r : 2 * r + 2, 2 * c : 2 * c + 2].ravel()
            assert half[r, c] == pytest.approx(four[1:].mean() if (r, c) == (0, 0) else four.mean())
    double = {(r.row, r.col): r.value for r in raster.resampled(grid, 0.5).collect()}
    assert len(double) == 12 * 16 and double[11, 15] == pytest.approx(values[5, 7])
    assert double[3, 5] == pytest.approx(0.75 * (0.75 * values[1, 2] + 0.25 * values[1, 3]) + 0.25 * (0.75 * values[2, 2] + 0.25 * values[2, 3]))
    px = grid.withColumnRenamed("raster_id", "id")
    (w,) = raster.by_window(px, lambda m: {"top": float(np.nanmax(m)), "n": int(np.isfinite(m).sum())}, "top double, n int").collect()
    assert (w.id, w.top, w.n) == (1, pytest.approx(max(values.ravel()[1:])), 47)
    e = raster.extent(grid, 100.0, 50.0, 2.0).head()
    assert (e.rows, e.cols, e.nodata, e.x_min, e.y_min, e.x_max, e.y_max) == (6, 8, 1, 100.0, 38.0, 116.0, 50.0)


def test_meters_and_chains(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(4)], "run string, step int, loss double")
    assert [r.loss_avg for r in vision.running(df, ["run"], "step", ["loss"]).orderBy("step").collect()] == [0.0, 0.5, 1.0, 1.5]
    out = vision.chained(df, [lambda d: d.withColumn("loss", F.col("loss") * 2), lambda d: d.withColumn("loss", F.lit(0.0))], only_if={1: F.col("step") > 1})
    assert [r.loss for r in out.orderBy("step").collect()] == [0.0, 2.0, 0.0, 0.0]
