"""Frames of vehicles: windows of a history, masks, target-centred features, neighbour ranks and lane geometry.

A history is an array of structs (x, y, vx, vy, ...) in order of time. Column functions work on one row's arrays; those that rank
or pair neighbours work on the long form, one row per sample and role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinematics import finite, rotated


def head_window(a: Column, n: int, zero: Column) -> Column:
    """The first n frames, padded at the end."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(zero, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def tail_window(a: Column, n: int) -> Column:
    """The last n frames, early ones null where there are fewer."""
    k = F.least(F.size(a), F.lit(n))
    return F.concat(F.array_repeat(F.try_element_at(F.slice(a, 1, 0), F.lit(1)), F.lit(n) - k), F.slice(a, F.size(a) - k + 1, k))


def mask(a: Column) -> Column:
    """Per frame: a known vehicle at a finite place."""
    return F.transform(a, lambda r: F.coalesce((r["id"] > 0) & finite(r["x"]) & finite(r["y"]), F.lit(False)))


def present_strict(a: Column, eps: float = 1e-6) -> Column:
    """All places finite and any off the origin."""
    return F.forall(a, lambda r: finite(r["x"]) & finite(r["y"])) & F.exists(a, lambda r: (F.abs(r["x"]) > eps) | (F.abs(r["y"]) > eps))


def present_loose(a: Column, eps: float = 1e-6) -> Column:
    """Any place off the origin; NaN is nowhere."""
    off = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) > eps), F.lit(False))
    return F.exists(a, lambda r: off(r["x"]) | off(r["y"]))


def aligned(a: Column, b: Column, atol: float = 1e-3) -> Column:
    """Whether two histories agree in every place."""
    near = F.zip_with(a, b, lambda p, q: (F.abs(p["x"] - q["x"]) <= atol) & (F.abs(p["y"] - q["y"]) <= atol))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def in_target_frame(points: Column, origin: Column, yaw: Column) -> Column:
    """Points (x, y) seen from origin, rotated by its heading."""

    def move(p: Column) -> Column:
        fwd, left = rotated(p["x"] - origin["x"], p["y"] - origin["y"], yaw)
        return F.struct(fwd.alias("fwd"), left.alias("left"))

    return F.transform(points, move)


def strided(a: Column, stride: int) -> Column:
    """Every stride-th frame and always the last."""
    return F.filter(a, lambda _, i: (i % stride == 0) | (i == F.size(a) - 1))


def time_offsets(n: int, hz: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i - F.lit(n - 1)) / F.lit(hz))


def linear_path(anchor_x: Column, anchor_y: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda t: F.struct((anchor_x * t / F.lit(n)).alias("x"), (anchor_y * t / F.lit(n)).alias("y")))


def ends(frames: DataFrame, by: tuple[str, ...], t: str, fields: tuple[str, ...]) -> DataFrame:
    """First and last frame per group as structs; partial on the map side."""
    row = F.struct(*fields)
    return frames.groupBy(*by).agg(F.min_by(row, t).alias("first"), F.max_by(row, t).alias("last"), F.count("*").alias("frames"))


def nearest_neighbors(rows: DataFrame, sample: str, dist: Column, ties: tuple, keep: int = 3) -> DataFrame:
    """rows with rank from 0 by distance, null from `keep` on."""
    rank = F.row_number().over(Window.partitionBy(sample).orderBy(dist, *ties)) - 1
    return rows.withColumn("rank", F.when(rank < keep, rank))


def lettered_neighbors(rows: DataFrame, sample: str, fwd: str, left: str, source: str, keep: int = 6) -> DataFrame:
    """The nearest rows with letters A, B, ...; keys are rounded half to even, so tiny differences do not decide."""
    r = lambda c: F.bround(c, 6)
    order = Window.partitionBy(sample).orderBy(r(F.sqrt(F.col(fwd) ** 2 + F.col(left) ** 2)), r(F.col(fwd)), r(F.col(left)), source)
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= keep).withColumn("letter", F.char(F.lit(64) + F.col("_rn"))).drop("_rn")


def lane_width(frames: DataFrame, by: str, upper: str, lower: str, default: float = 3.9) -> DataFrame:
    """(by, width, boundaries): median of plausible widths, else the default, and four boundaries around the ego lane, sorted."""
    w = F.col(upper) + F.col(lower)
    width = F.coalesce(F.median(F.when(finite(w) & (w > 1.5) & (w < 8.0), w)), F.lit(default))
    g = frames.groupBy(by).agg(width.alias("width"), F.max_by(upper, "t").alias("_u"))
    return g.select(by, "width", F.array_sort(F.array(F.col("_u"), F.col("_u") - F.col("width"), F.col("_u") + F.col("width"), F.col("_u") - 2 * F.col("width"))).alias("boundaries"))


def cyclic(valid: Column, n: int) -> Column:
    """Query i takes the i-th valid entry, over and over; -1 where none is valid."""
    places = F.filter(F.transform(valid, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(places, F.try_mod(i, F.size(places))), F.lit(-1)))


def top_modes(scores: Column, m: int) -> Column:
    """Places of the m highest scores, best first, the smaller place on ties."""
    order = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(order, 1, m), lambda x: x["i"])
