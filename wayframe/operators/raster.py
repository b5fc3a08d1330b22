"""Scene rasters: lanes and traces in metres to pixel rows, the colour painted last at each pixel, and PNG bytes per scene.

Pixels are rows until the end, so any number of scenes is drawn by one plan: segments are exploded to their points, points to the squares of the pen, and of the
layers that meet at a pixel the highest gives its colour. Only the bytes of a scene are put together in one place, width x height pixels at most.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours as 0xRRGGBB, empty margin, pens and halves of marks in pixels, dashes in metres.
BACKGROUND, LANE, EGO, OTHER, HIGHLIGHTS = 0xEEF0F2, 0x969BA0, 0xD22D2D, 0x5F666E, (0xF18A18, 0x269B5B, 0x2469B4)
MARGIN, LANE_PEN, TRACE_PEN, EGO_MARK, MARK = 28, 2, 3, 5, 4
DASH = 5.0


def extents(points: DataFrame, lanes: DataFrame, ahead: float, behind: float, margin: float) -> DataFrame:
    """(scene, lat0, lat1, lon0, lon1): the smallest and largest places of valid points (scene, lat, lon) and lanes (scene, lat), lateral ones with a
    margin, and at least the window from behind to ahead. A scene needs lanes."""
    p = points.select("scene", "lat", "lon").unionByName(lanes.select("scene", "lat", F.lit(None).cast("double").alias("lon")))
    e = p.groupBy("scene").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    return e.select("scene", F.col("lat0") - margin, F.col("lat1") + margin, F.least("lon0", F.lit(-behind)), F.greatest("lon1", F.lit(ahead))).toDF("scene", "lat0", "lat1", "lon0", "lon1")


def pixel(lat: Column, lon: Column, width: int, height: int, margin: int = MARGIN) -> tuple[Column, Column]:
    """Column and row of a place between the extents lat0 to lon1 of its row; halves go to even numbers, and lon runs upwards."""
    share = lambda v, low, high: (v - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-6))
    x = margin + share(lat, "lat0", "lat1") * (width - 2 * margin)
    y = height - margin - share(lon, "lon0", "lon1") * (height - 2 * margin)
    return F.rint(x).cast("int"), F.rint(y).cast("int")


def dashes(lanes: DataFrame, width: int, height: int, margin: int = MARGIN) -> DataFrame:
    """(scene, x0, y0, x1, y1) of the dashes of lanes (scene, lat, lat0 ...): every other stretch of DASH metres from lon0 on, cut at lon1."""
    n = F.greatest(F.ceil((F.col("lon1") - F.col("lon0")) / (2 * DASH)), F.lit(0)).cast("int")
    d = lanes.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_from", F.col("lon0") + F.col("_k") * (2 * DASH)).where("_from < lon1")
    a, b = pixel(F.col("lat"), F.col("_from"), width, height, margin), pixel(F.col("lat"), F.least(F.col("_from") + DASH, F.col("lon1")), width, height, margin)
    return d.select("scene", a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))


def line_pixels(segments: DataFrame, pen: int, width: int, height: int) -> DataFrame:
    """segments (x0, y0, x1, y1, ...) as rows of their pixels x and y within the image: evenly spaced points, as many as the longer side has, each with the
    square of the pen."""
    count = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1))
    at = lambda a, b: F.rint(F.col(a) + F.col("_i") * (F.col(b) - F.col(a)) / F.col("_n")).cast("int")
    points = segments.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    points = points.withColumn("x", at("x0", "x1")).withColumn("y", at("y0", "y1")).drop("_n", "_i", "x0", "y0", "x1", "y1")
    return squares(points, max(0, pen // 2), width, height)


def squares(points: DataFrame, half: int | Column, width: int, height: int) -> DataFrame:
    """points (x, y, ...) as the pixels of squares around them, within the image."""
    h = F.lit(half) if isinstance(half, int) else half
    wide = points.withColumn("_h", h).withColumn("_dx", F.explode(F.sequence(-F.col("_h"), F.col("_h")))).withColumn("_dy", F.explode(F.sequence(-F.col("_h"), F.col("_h"))))
    moved = wide.withColumn("x", F.col("x") + F.col("_dx")).withColumn("y", F.col("y") + F.col("_dy")).drop("_h", "_dx", "_dy")
    return moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def trace_color(role: Column, rank: Column) -> Column:
    known = F.element_at(F.array(*map(F.lit, HIGHLIGHTS)), F.when(rank.between(0, len(HIGHLIGHTS) - 1), rank + 1).otherwise(1).cast("int"))
    return F.when(role == "ego", EGO).when(rank.between(0, len(HIGHLIGHTS) - 1), known).otherwise(OTHER)


def scene_pixels(points: DataFrame, lanes: DataFrame, width: int = 640, height: int = 640, ahead: float = 60.0, behind: float = 20.0, lateral_margin: float = 2.0, margin: int = MARGIN) -> DataFrame:
    """(scene, x, y, color) of every painted pixel.

    points: (scene, role, layer, rank, t, lat, lon), the valid points of traces, drawn in the order of layer, a whole number from 0 on; ego is the role of the own
    vehicle, rank that of a highlighted one. lanes: (scene, lat). Lanes come first, then each trace with a mark at its last point.
    """
    from pyspark.sql import Window

    if min(width, height) < 64:
        raise ValueError("an image of less than 64 pixels")
    size = extents(points, lanes, ahead, behind, lateral_margin)
    lane = line_pixels(dashes(lanes.join(size, "scene"), width, height, margin), LANE_PEN, width, height).select("scene", "x", "y", F.lit(-1).cast("long").alias("layer"), F.lit(LANE).alias("color"))
    p = points.join(size, "scene")
    x, y = pixel(F.col("lat"), F.col("lon"), width, height, margin)
    p = p.select("scene", "role", "t", x.alias("x1"), y.alias("y1"), (F.col("layer") * 2).cast("long").alias("layer"), trace_color(F.col("role"), F.col("rank")).alias("color"))
    w = Window.partitionBy("scene", "layer").orderBy("t")
    p = p.withColumns({"x0": F.lag("x1").over(w), "y0": F.lag("y1").over(w), "_last": F.lead("x1").over(w).isNull()})
    lines = line_pixels(p.where("x0 is not null").select("scene", "layer", "color", "x0", "y0", "x1", "y1"), TRACE_PEN, width, height)
    ends = p.where("_last").select("scene", (F.col("layer") + 1).alias("layer"), "color", F.col("x1").alias("x"), F.col("y1").alias("y"), F.when(F.col("role") == "ego", EGO_MARK).otherwise(MARK).alias("half"))
    marks = squares(ends, F.col("half"), width, height).drop("half")
    drawn = lane.unionByName(lines).unionByName(marks)
    return drawn.groupBy("scene", "x", "y").agg(F.max_by("color", "layer").alias("color"))


def png(image: np.ndarray) -> bytes:
    """An image [row, column, 3] of bytes as PNG."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((image.shape[0], 1 + 3 * image.shape[1]), dtype=np.uint8)  # each row after a filter of none
    rows[:, 1:] = image.reshape(image.shape[0], -1)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def images(pixels: DataFrame, width: int = 640, height: int = 640, background: int = BACKGROUND) -> DataFrame:
    """(scene, png): an image of each scene of pixels (scene, x, y, color)."""
    rgb = lambda c: np.stack([c >> 16 & 255, c >> 8 & 255, c & 255], axis=-1).astype(np.uint8)

    def run(t: pa.Table) -> pa.Table:
        image = np.empty((height, width, 3), dtype=np.uint8)
        image[:] = rgb(np.array(background))
        x, y, c = (t[k].to_numpy() for k in ("x", "y", "color"))
        image[y, x] = rgb(c)
        return pa.table({"scene": t["scene"].slice(0, 1), "png": pa.array([png(image)], pa.binary())})

    kind = pixels.schema["scene"].dataType.simpleString()
    return pixels.select("scene", "x", "y", F.col("color").cast("int").alias("color")).groupBy("scene").applyInArrow(run, f"scene {kind}, png binary")
