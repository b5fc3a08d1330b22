import random
import struct
import zlib

import numpy as np
import pytest

from wayframe.operators import raster as R


def decoded(data):
    """The pixels of a PNG without filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, size = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    w, h = size[:2]
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, 1 + 3 * w)
    assert size[2:] == (8, 2, 0, 0, 0) and not rows[:, 0].any()
    v = rows[:, 1:].reshape(h, w, 3).astype(int)
    return v[:, :, 0] << 16 | v[:, :, 1] << 8 | v[:, :, 2]


def plain(points, lanes, width, height, ahead, behind, lateral):
    """The image of one scene, painted in order on an array."""
    image = np.full((height, width), R.BACKGROUND)
    lat = [*lanes, *(p[5] for p in points)]
    lon = [-behind, ahead, *(p[6] for p in points)]
    lat0, lat1, lon0, lon1 = min(lat) - lateral, max(lat) + lateral, min(lon), max(lon)
    m = R.MARGIN
    place = lambda a, b: (round(m + (a - lat0) / max(lat1 - lat0, 1e-6) * (width - 2 * m)), round(height - m - (b - lon0) / max(lon1 - lon0, 1e-6) * (height - 2 * m)))

    def square(x, y, half, color):
        image[max(0, y - half) : max(0, y + half + 1), max(0, x - half) : max(0, x + half + 1)] = color

    def line(a, b, color, pen):
        n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
        for i in range(n + 1):
            square(round(a[0] + i * (b[0] - a[0]) / n), round(a[1] + i * (b[1] - a[1]) / n), pen // 2, color)

    for v in lanes:
        k = 0
        while lon0 + k * 10 < lon1:
            line(place(v, lon0 + k * 10), place(v, min(lon0 + k * 10 + 5, lon1)), R.LANE, R.LANE_PEN)
            k += 1
    for layer in sorted({p[2] for p in points}):
        trace = sorted((p for p in points if p[2] == layer), key=lambda p: p[4])
        role, rank = trace[0][1], trace[0][3]
        color = R.EGO if role == "ego" else R.HIGHLIGHTS[rank] if rank is not None and rank < 3 else R.OTHER
        at = [place(p[5], p[6]) for p in trace]
        for a, b in zip(at, at[1:]):
            line(a, b, color, R.TRACE_PEN)
        square(*at[-1], R.EGO_MARK if role == "ego" else R.MARK, color)
    return image


@pytest.mark.parametrize("size", [(64, 80), (200, 160)])
def test_images_by_painting_in_order(spark, size):
    r, points, lanes = random.Random(3), [], []
    for scene in range(6):
        lanes += [(scene, float(v)) for v in (-5, -1, 3)]
        for layer, (role, rank) in enumerate([("a", None), ("ego", None), ("b", 0), ("c", 2), ("d", 9)][: r.randint(1, 5)]):
            x, y = r.uniform(-4, 4), r.uniform(-10, 50)
            for t in range(r.randint(1, 12)):
                x, y = x + r.uniform(-1, 1), y + r.uniform(-1, 9)
                points.append((scene, role, layer, rank, t, x, y))
    p = spark.createDataFrame(points, "scene int, role string, layer int, rank int, t int, lat double, lon double").repartition(3)
    pixels = R.scene_pixels(p, spark.createDataFrame(lanes, "scene int, lat double"), *size, ahead=60.0, behind=20.0, lateral_margin=2.0)
    got = {x["scene"]: decoded(bytes(x["png"])) for x in R.images(pixels, *size).collect()}
    for scene in range(6):
        want = plain([q for q in points if q[0] == scene], [v for s, v in lanes if s == scene], *size, 60.0, 20.0, 2.0)
        assert (got[scene] == want).all()
    with pytest.raises(ValueError, match="64"):
        R.scene_pixels(p, p, 63, 100)


def test_a_scene_of_lanes_only(spark):
    p = spark.createDataFrame([], "scene int, role string, layer int, rank int, t int, lat double, lon double")
    lanes = spark.createDataFrame([(1, 0.0)], "scene int, lat double")
    (row,) = R.images(R.scene_pixels(p, lanes, 64, 64), 64, 64).collect()
    assert (decoded(bytes(row["png"])) == plain([], [0.0], 64, 64, 60.0, 20.0, 2.0)).all()
