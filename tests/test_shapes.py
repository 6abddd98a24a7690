"""A shapefile made by hand: an island with a lake, two islands, and a point."""

import json
import struct
import zipfile

from strandline.sources import shapes


def record(i, rings):
    points = [p for r in rings for p in r]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    firsts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
    body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *firsts) + b"".join(struct.pack("<2d", *p) for p in points)
    return struct.pack(">ii", i, len(body) // 2) + body


def test_shapes_become_geojson(spark, tmp_path):
    outer = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    lake = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    other = [(9.0, 0.0), (9.0, 1.0), (10.0, 1.0), (9.0, 0.0)]
    point = struct.pack("<i2d", 1, 3.0, 3.0)
    shp = bytes(100) + record(1, [outer, lake]) + record(2, [outer, other]) + struct.pack(">ii", 3, len(point) // 2) + point
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15)
    head = field("NAME", 6) + field("ID", 2)
    rows = b"".join(b" " + n.encode().ljust(6) + k.encode().ljust(2) for n, k in (("Oy", "1"), ("Two", "2"), ("Pt", "")))
    dbf = struct.pack("<4xIHH20x", 3, 32 + len(head) + 1, 9) + head + b"\r" + rows
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m/a.shp", shp)
        z.writestr("m/a.dbf", dbf)
    got = shapes.read_shapes(spark, f"file://{tmp_path}/*.zip").orderBy("number").collect()
    assert [(r["file"], r["attributes"]["ID"]) for r in got] == [("m/a", "1"), ("m/a", "2"), ("m/a", "")] and got[1]["attributes"]["NAME"] == "Two"
    one, two = json.loads(got[0]["geometry"]), json.loads(got[1]["geometry"])
    assert one["type"] == "Polygon" and len(one["coordinates"]) == 2 and two["type"] == "MultiPolygon" and len(two["coordinates"]) == 2 and got[2]["geometry"] is None
