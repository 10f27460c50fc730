"""Readers and writers of building tables: parquet (WKB or WKT), GeoJSON, CSV with WKT, spreadsheets, GeoPackage, Shapefile, COCO, masks.

Files are read by Spark, or as binary rows parsed in Arrow batches, so any Hadoop file system works and
files spread over executors. Every reader gives ``geometry`` as a polygon struct; other kinds of geometry are null.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

_RINGS = "array<array<array<double>>>"


def _as_polygon(rings: Column) -> Column:
    every = F.transform(rings, lambda r: F.transform(r, lambda p: g.point(p[0], p[1])))
    return F.when(F.size(rings) > 0, F.struct(F.try_element_at(every, F.lit(1)).alias("exterior"), F.slice(every, F.lit(2), F.size(every)).alias("interiors")))


# Well-known binary ---------------------------------------------------------------------------


def wkb_parts(raw: bytes | None) -> list[list[list[list[float]]]]:
    """The polygons of a (Multi)Polygon in WKB or EWKB as lists of rings; z and m are dropped; other kinds give none."""
    if not raw:
        return []

    def read(at: int) -> tuple[list, int]:
        order = "<" if raw[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5
        if kind & 0x20000000:  # an SRID follows
            at += 4
        extra = bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[min((kind & 0xFFFF) // 1000, 3)]
        kind = (kind & 0xFFFF) % 1000
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        if kind == 6:
            parts = []
            for _ in range(n):
                p, at = read(at)
                parts += p
            return parts, at
        if kind != 3:
            return [], at
        rings = []
        for _ in range(n):
            (k,) = struct.unpack_from(order + "I", raw, at)
            at += 4
            flat = struct.unpack_from(f"{order}{k * (2 + extra)}d", raw, at)
            at += 8 * k * (2 + extra)
            rings.append([[flat[i], flat[i + 1]] for i in range(0, len(flat), 2 + extra)])
        return [rings], at

    return read(0)[0]


def wkb(rings: list[list[list[float]]]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", p[0], p[1]) for p in r)
    return out


def from_wkb(column: Column) -> Column:
    """Array of polygons of a WKB column (one for a Polygon, more for a MultiPolygon)."""

    @F.pandas_udf(f"array<{_RINGS}>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(wkb_parts)

    return F.transform(run(column), _as_polygon)


def to_wkb(geometry: Column) -> Column:
    """WKB of a polygon; null stays null. Rings travel flat: nested lists of a batch of nulls crash some Arrow readers."""

    @F.pandas_udf("binary")
    def run(sizes: pd.Series, flat: pd.Series) -> pd.Series:
        def one(n: np.ndarray | None, xy: np.ndarray | None) -> bytes | None:
            if n is None:
                return None
            points = np.asarray(xy, float).reshape(-1, 2)
            return wkb([r.tolist() for r in np.split(points, np.cumsum(n)[:-1].astype(int))])

        return pd.Series([one(n, xy) for n, xy in zip(sizes, flat, strict=True)], dtype=object)

    rings = g.rings(geometry)
    return run(F.transform(rings, F.size), F.flatten(F.transform(F.flatten(rings), lambda p: F.array(p["x"], p["y"]))))


def parts(df: DataFrame, column: str = "geometry") -> DataFrame:
    """One row for each polygon of an array of polygons; rows without any keep a null."""
    return df.withColumn(column, F.explode_outer(column))


# Files ----------------------------------------------------------------------------------------------


def geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """Parquet with a WKB, WKT or polygon ``column``."""
    df = spark.read.parquet(path)
    kind = dict(df.dtypes)[column]
    if kind == "binary":
        return parts(df.withColumn(column, from_wkb(F.col(column))), column)
    return parts(df.withColumn(column, g.polygons_from_wkt(F.col(column))), column) if kind == "string" else df


def csv_wkt(spark: SparkSession, path: str, schema: str | None = None, column: str = "geometry") -> DataFrame:
    """CSV with a header; a WKT ``column`` (degrees) becomes polygons, each part of a MULTIPOLYGON a row."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return parts(df.withColumn(column, g.polygons_from_wkt(F.col(column))), column) if column in df.columns else df


def geojson(spark: SparkSession, path: str, properties: str = "id long") -> DataFrame:
    """A FeatureCollection: its properties by ``properties`` (a DDL schema), and polygons (each part of a MultiPolygon a row)."""
    schema = f"features array<struct<properties: struct<{', '.join(': '.join(c.strip().split(' ', 1)) for c in properties.split(','))}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    many = F.when(kind == "Polygon", F.array(F.from_json(text, _RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_RINGS}>"))
    return parts(rows.select("f.properties.*", F.transform(many, _as_polygon).alias("geometry")))


def _gpkg_rows(content: bytes, table: str | None) -> Iterator[dict]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # SQLite opens files only; it is read and gone within this task
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        db.row_factory = sqlite3.Row
        for t, column in db.execute("select table_name, column_name from gpkg_geometry_columns").fetchall():
            if table in (None, t):
                for r in db.execute(f'select * from "{t}"'):
                    row = dict(r)
                    raw = row.pop(column)
                    # Header: magic, version, flags (bits 1 to 3: size of the envelope), SRID.
                    head = 8 + (0, 32, 48, 48, 64)[(raw[3] >> 1) & 7] if raw else 0
                    yield {"properties": json.dumps(row, default=str), "wkb": bytes(raw[head:]) if raw else None}
        db.close()


def geopackage(spark: SparkSession, path: str, properties: str = "id long", table: str | None = None) -> DataFrame:
    """Feature tables of GeoPackage files, a file a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                rows = list(_gpkg_rows(content, table))
                for k in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[k : k + 5000])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "properties string, wkb binary")
    return parts(rows.select(F.from_json("properties", properties).alias("p"), from_wkb(F.col("wkb")).alias("geometry")).select("p.*", "geometry"))


def shapefile_polygons(content: bytes) -> Iterator[list[list[list[list[float]]]]]:
    """Polygons (5, 15, 25) of a .shp: each record's clockwise rings, every one with the counter-clockwise rings that follow it."""
    at = 100
    while at + 8 <= len(content):
        (length,) = struct.unpack_from(">i", content, at + 4)
        kind = struct.unpack_from("<i", content, at + 8)[0]
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<2i", content, at + 44)
            first = [*struct.unpack_from(f"<{n_parts}i", content, at + 52), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", content, at + 52 + 4 * n_parts)
            polygons: list = []
            for a, b in zip(first, first[1:], strict=False):
                ring = [[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)]
                turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))
                if turn <= 0 or not polygons:
                    polygons.append([ring])
                else:
                    polygons[-1].append(ring)
            yield polygons
        else:
            yield []
        at += 8 + 2 * length


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(id, geometry) of .shp files: id is the record's number in its file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                rows = list(enumerate(shapefile_polygons(content)))
                for k in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[k : k + 5000], columns=["id", "p"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"id long, p array<{_RINGS}>")
    return parts(rows.select("id", F.transform("p", _as_polygon).alias("geometry")))


#: Parts of the name space of spreadsheets (fixed value).
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Rows of a sheet of an .xlsx workbook as texts; empty cells are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
            out: list[str | None] = []
            for k, cell in enumerate(row.iter(f"{_SHEET}c")):
                letters = "".join(c for c in cell.get("r", "") if c.isalpha())
                at = k
                if letters:
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    at -= 1
                out += [None] * (at + 1 - len(out))
                value = cell.find(f"{_SHEET}v")
                if cell.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif value is not None and value.text is not None:
                    out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield out


def excel(spark: SparkSession, path: str, schema: str | None = None, sheet: int = 1) -> DataFrame:
    """A sheet of .xlsx workbooks, a file a task; the first row names the columns (those of the first file). Values are texts, or as a DDL ``schema`` of the same names says."""
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").limit(1).select("content").head()
    names = next(sheet_rows(bytes(first.content), sheet), []) if first else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                rows = sheet_rows(content, sheet)
                own = next(rows, [])
                found = [dict(zip(own, r, strict=False)) for r in rows]
                for k in range(0, len(found), 5000):
                    yield pd.DataFrame([[r.get(c) for c in names] for r in found[k : k + 5000]], columns=names)

    rows = files.select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in names))
    if schema is None:
        return rows
    wanted = spark.createDataFrame([], schema).schema
    return rows.select(*(F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in wanted))


def png_pixels(content: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit PNG without interlacing: grey or palette numbers (rows x columns), else rows x columns x channels."""
    at, data, head = 8, b"", None
    while at < len(content):
        (size,) = struct.unpack_from(">I", content, at)
        kind = content[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", content, at + 8)
        elif kind == b"IDAT":
            data += content[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width * n), np.uint8)
    for r in range(height):
        kind, line, up = raw[r, 0], raw[r, 1:].copy(), out[r]
        if kind == 0:
            out[r + 1] = line
        elif kind == 2:
            out[r + 1] = line + up
        elif kind == 1:
            out[r + 1] = np.cumsum(line.reshape(-1, n), 0, dtype=np.uint64).astype(np.uint8).ravel()
        else:
            # Average and Paeth need the byte before.
            done = [0] * n
            above = [0] * n + up.tolist()
            for k, x in enumerate(line.tolist()):
                a, b, c = done[k], above[k + n], above[k]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                done.append((x + guess) & 255)
            out[r + 1] = done[n:]
    return out[1:].reshape(height, width, n).squeeze(-1) if n == 1 else out[1:].reshape(height, width, n)


def png_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, pixel): the labelled pixels (other than 0) of mask PNGs, positions column by column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame.path, frame.content, strict=True):
                values = png_pixels(content)
                rows, cols = np.nonzero(values)
                yield pd.DataFrame({"path": name, "label": values[rows, cols].astype("int32"), "pixel": cols.astype("int64") * len(values) + rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, label int, pixel long")


def mask_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, note, height, width, counts): run lengths of JSON files with ``annotations``, each with a ``segmentation`` of size and counts (as a list)."""
    schema = "annotations array<struct<id: long, segmentation: struct<size: array<int>, counts: array<int>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.posexplode("annotations").alias("k", "a"))
    return doc.select("file", F.coalesce("a.id", "k").alias("note"), F.col("a.segmentation.size")[0].alias("height"), F.col("a.segmentation.size")[1].alias("width"), F.col("a.segmentation.counts").alias("counts"))


def kind_of(path: str) -> str:
    """geo or table, by suffix (parquet may be either: see ``folder``)."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kinds = {".geojson": "geo", ".json": "geo", ".gpkg": "geo", ".shp": "geo", ".csv": "table", ".xlsx": "table", ".parquet": "parquet"}
    if suffix not in kinds:
        raise ValueError(f"{path}: unknown kind of file")
    return kinds[suffix]


def read(spark: SparkSession, path: str, properties: str = "id long") -> DataFrame:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind_of(path)
    if suffix in (".geojson", ".json"):
        return geojson(spark, path, properties)
    if suffix == ".gpkg":
        return geopackage(spark, path, properties)
    if suffix == ".shp":
        return shapefile(spark, path)
    if suffix == ".csv":
        return csv_wkt(spark, path)
    if suffix == ".xlsx":
        return excel(spark, path)
    df = spark.read.parquet(path)
    return geoparquet(spark, path) if "geometry" in df.columns else df


def folder(spark: SparkSession, paths: list[str], properties: str = "id long") -> DataFrame:
    """All files together, with ``source``; kinds are checked before anything is read, and tables and geometries don't mix."""
    kinds = {p: kind_of(p) for p in paths}
    frames = {p: read(spark, p, properties) for p in sorted(paths)}
    found = {("geo" if k == "geo" or "geometry" in frames[p].columns else "table") for p, k in kinds.items()}
    if len(found) > 1:
        raise ValueError("geometries and plain tables in one folder")
    out = None
    for p, df in frames.items():
        df = df.withColumn("source", F.lit(os.path.splitext(os.path.basename(p.rstrip("/")))[0]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of COCO files beside their image's size: polygons as text, run lengths as an array."""
    schema = "images array<struct<id: long, file_name: string, height: int, width: int>>, annotations array<struct<id: long, image_id: long, category_id: int, area: double, uncertain_iou: double, segmentation: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.height", "i.width")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    run = F.from_json("segmentation", "struct<size: array<int>, counts: array<int>>")
    return notes.join(images, "image_id").withColumn("counts", run["counts"])


def write(df: DataFrame, path: str, form: str = "parquet", column: str = "geometry") -> None:
    """``parquet`` with WKB, or ``csv`` with WKT."""
    if form == "csv":
        (df.withColumn(column, g.to_wkt(F.col(column))) if column in df.columns else df).write.option("header", True).csv(path)
    else:
        (df.withColumn(column, to_wkb(F.col(column))) if column in df.columns else df).write.parquet(path)
