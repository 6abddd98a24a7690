"""Zipped polygon shapefiles: a row per shape with its attributes and its rings as GeoJSON."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_POLYGON = 5


def _attributes(raw: bytes, encoding: str) -> Iterator[dict[str, str]]:
    """Rows of a dBASE table; deleted rows are given too, since shapes keep their places."""
    n, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("ascii"), raw[at + 16]))
        at += 32
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = raw[at : at + width].decode(encoding, "replace").strip()
            at += width
        yield row


def _signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _geometry(rings: list[list[tuple[float, float]]]) -> dict:
    """Clockwise rings open a polygon each; the others are holes of the one before."""
    polygons: list[list] = []
    for ring in rings:
        if _signed_area(ring) <= 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons}


def _shapes(raw: bytes) -> Iterator[dict | None]:
    at = 100
    while at + 8 <= len(raw):
        (words,) = struct.unpack(">i", raw[at + 4 : at + 8])
        body, at = raw[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        (kind,) = struct.unpack("<i", body[:4])
        if kind != _POLYGON:
            yield None
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        firsts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        yield _geometry([xy[a:b] for a, b in zip(firsts, firsts[1:], strict=False)])


def read_shapes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, number from 0, attributes map, geometry GeoJSON text) of every shape in ZIP archives of .shp and .dbf; null geometry for other kinds.

    One archive a task; its shapes leave in batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".shp")):
                        rows = []
                        for i, (shape, row) in enumerate(zip(_shapes(z.read(name)), _attributes(z.read(name[:-4] + ".dbf"), encoding), strict=False)):
                            rows.append((name[:-4], i, row, None if shape is None else json.dumps(shape)))
                            if len(rows) == 1000:
                                yield pd.DataFrame(rows, columns=["file", "number", "attributes", "geometry"])
                                rows = []
                        yield pd.DataFrame(rows, columns=["file", "number", "attributes", "geometry"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, number long, attributes map<string,string>, geometry string")
