import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tremorframe.functions import geometry as g
from tremorframe.sources import readers

RING = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0], [1.0, 1.0]]


def area(df):
    return sorted((r.id, r.a) for r in df.select("id", g.measures(F.col("geometry"))["area"].alias("a")).collect())


def test_wkt_and_wkb(spark, tmp_path):
    text = ["POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", " polygon z((0 0 7,4 0 7,4 3 7,0 3 7,0 0 7))", "POINT (1 2)", None]
    df = spark.createDataFrame(list(enumerate(text)), "id long, t string").select("id", g.from_wkt(F.col("t")).alias("geometry"))
    assert area(df) == [(0, 11.0), (1, 12.0), (2, None), (3, None)]
    readers.write(df, str(tmp_path / "p"))
    assert area(readers.geoparquet(spark, str(tmp_path / "p"))) == area(df)
    readers.write(df, str(tmp_path / "c"), "csv")
    assert area(readers.csv_wkt(spark, str(tmp_path / "c"), "id long, geometry string")) == area(df)
    big = struct.pack(">BII", 0, 0x20000003, 4326) + struct.pack(">I", 1) + struct.pack(">I", 5) + b"".join(struct.pack(">2d", *p) for p in RING)
    assert readers.wkb_parts(big) == [[RING]] and readers.wkb_parts(readers.wkb([RING, HOLE])) == [[RING, HOLE]] and readers.wkb_parts(None) == []


def test_geojson(spark, tmp_path):
    features = [({"id": 1}, {"type": "Polygon", "coordinates": [RING, HOLE]}), ({"id": 2}, {"type": "MultiPolygon", "coordinates": [[RING], [HOLE]]}), ({"id": 3}, {"type": "Point", "coordinates": [1, 2]})]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": q} for p, q in features]}))
    assert area(readers.read(spark, str(tmp_path / "a.geojson"))) == [(1, 11.0), (2, 1.0), (2, 12.0), (3, None)] or {x for x in area(readers.read(spark, str(tmp_path / "a.geojson")))} == {(1, 11.0), (2, 1.0), (2, 12.0), (3, None)}


def test_geopackage_and_shapefile(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('b', 'geom')")
    db.execute("create table b (id integer, geom blob)")
    db.execute("insert into b values (7, ?)", (b"GP\x00\x01" + struct.pack("<i", 4326) + readers.wkb([RING, HOLE]),))
    db.commit()
    db.close()
    assert area(readers.read(spark, str(tmp_path / "a.gpkg"))) == [(7, 11.0)]
    ring = [p for p in RING[::-1]] + HOLE[::-1]
    body = struct.pack("<i4d2i", 5, 0, 0, 4, 3, 2, 10) + struct.pack("<2i", 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    assert area(readers.read(spark, str(tmp_path / "a.shp"))) == [(0, 11.0)]


def test_folder_refuses_a_mix(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "u.parquet"))
    both = readers.folder(spark, [str(tmp_path / "t.parquet"), str(tmp_path / "u.parquet")])
    assert sorted((r.source, r["count"]) for r in both.groupBy("source").count().collect()) == [("t", 2), ("u", 3)]
    readers.write(spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "id long, w string").select("id", g.from_wkt(F.col("w")).alias("geometry")), str(tmp_path / "g.parquet"))
    with pytest.raises(ValueError):
        readers.folder(spark, [str(tmp_path / "t.parquet"), str(tmp_path / "g.parquet")])
    with pytest.raises(ValueError):
        readers.read(spark, "x.unknown")


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "height": 2, "width": 3}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "area": 2.0, "segmentation": {"size": [2, 3], "counts": [1, 2, 3]}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    (r,) = readers.coco(spark, str(tmp_path / "c.json")).collect()
    assert (r.id, r.height, r.width, list(r["counts"])) == (5, 2, 3, [1, 2, 3])
