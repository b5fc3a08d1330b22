"""Column expressions for gaps, closing times, risk and trend classes of vehicles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No closing, metres of dead band in gaps, m/s^2 in accelerations, km/h in a m/s.
NEVER, GAP_BAND, ACC_BAND, KMH = 99.0, 0.3, 0.3, 3.6


def gap_clear(front_x: Column, rear_x: Column, length: float) -> Column:
    return front_x - rear_x - F.lit(length)


def interaction(ego: Column, other: Column, role: Column, length: float = 4.8, width: float = 1.9, leader: str = "phys_tl") -> Column:
    """Struct of gap, position, dy, dv, ttc, side_by_side and risk of an ego and a neighbour, structs with x, y, v; null for none.

    The overlap class of a target-lane leader overrides the ladder of risks.
    """
    ahead = other["x"] > ego["x"]
    gap = F.when(ahead, gap_clear(other["x"], ego["x"], length)).otherwise(gap_clear(ego["x"], other["x"], length))
    dy, dv = F.abs(other["y"] - ego["y"]), other["v"] - ego["v"]
    ttc = F.when(~ahead & (dv > 0.01), (gap + length) / dv).when(ahead & (dv < -0.01), (gap + length) / F.abs(dv)).otherwise(NEVER)
    risk = (
        F.when(ahead & (role == leader) & (gap < -0.5 * length), "leader_overlap")
        .when((gap < 0) & (dy < width + 0.5), "critical")
        .when((ttc < 2.0) | (dy < width), "high")
        .when((ttc < 4.0) | (dy < width + 0.8), "medium")
        .otherwise("low")
    )
    position = F.when(ahead, "ahead").otherwise("behind")
    made = F.struct(gap.alias("gap"), position.alias("position"), dy.alias("dy"), dv.alias("dv"), ttc.alias("ttc"), (gap < 0).alias("side_by_side"), risk.alias("risk"))
    return F.when(ego.isNotNull() & other.isNotNull(), made)


def pair(a: Column, b: Column, length: float = 4.8) -> Column:
    """Struct of gap, ttc and trend of two vehicles in a lane, whichever is in front; null for none."""
    swap = b["x"] > a["x"]
    front, rear = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    gap, dv = gap_clear(front["x"], rear["x"], length), rear["v"] - front["v"]
    ttc = F.when((dv > 0.01) & (gap > 0), gap / dv).otherwise(NEVER)
    trend = F.when(dv > GAP_BAND, "closing").when(dv < -GAP_BAND, "opening").otherwise("steady")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(gap.alias("gap"), ttc.alias("ttc"), trend.alias("trend")))


def gap_between(front: Column, rear: Column, length: float = 4.8) -> Column:
    """pair() of a leader and its follower, only where the leader is ahead; null otherwise."""
    return F.when(front["x"] > rear["x"], pair(front, rear, length))


def style(acc: Column, speed: Column) -> Column:
    """Driving style; the first rule that holds decides."""
    return F.when(acc > 0.5, "assertive").when(acc < -0.5, "cautious").when(speed > 12, "fast").otherwise("steady")


def banded(change: Column, band: float, up: str, down: str, same: str) -> Column:
    return F.when(change > band, up).when(change < -band, down).otherwise(same)


def side_class(gap: Column, ahead: Column) -> Column:
    """Side by side from one metre of overlap on."""
    return F.when(gap < -1.0, "side_by_side").when(ahead, "ahead").otherwise("behind")


def side_flags(gap: Column, ahead: Column) -> Column:
    """Struct of the place of a target-lane neighbour (null for none) and whether the ego is in front of it or beside it."""
    side = F.when(gap.isNotNull(), side_class(gap, ahead))
    return F.struct(side.alias("position"), F.coalesce(side != "ahead", F.lit(False)).alias("advantage"))


def drift(lane_u: Column, lat_v: Column) -> Column:
    """Sideways progress: by the distance to the lane's boundary where it is known, else by the lateral speed."""
    by_u = F.when(lane_u < 0.5, "at_boundary").when(lane_u < 1.0, "nearing").otherwise("centered")
    return F.when(lane_u.isNotNull(), by_u).otherwise(F.when(lat_v > 0.2, "toward").when(lat_v < -0.2, "away").otherwise("steady"))


def pointing(yaw: Column) -> Column:
    """Where the heading points."""
    return F.when(yaw > 0.03, "toward").when(yaw < -0.03, "away").otherwise("aligned")


def progress(phase: Column, lane_u: Column, lat_v: Column) -> Column:
    """Lane-change progress in the first phase, from the distance to the boundary or else the lateral speed."""
    by_u = F.when(lane_u <= 0.3, 0.9).when(lane_u <= 0.5, 0.7).when(lane_u <= 0.8, 0.4).when(lane_u <= 1.2, 0.2).otherwise(0.1)
    return F.when(phase == 0, F.when(lane_u.isNotNull(), by_u).otherwise(F.when(lat_v > 0.3, 0.3).otherwise(0.1)))


def following(gap: Column, speed: Column) -> Column:
    safe = 1.5 * speed
    return F.when(gap > safe, "safe").when(gap > 0.5 * safe, "short").otherwise("too_close")


def settling(lat_v: Column, yaw: Column) -> Column:
    """Struct of whether a vehicle still moves sideways and whether its heading is not along the lane yet; unknown values are neither."""
    over = lambda v, most: F.coalesce(finite(v) & (F.abs(v) > most), F.lit(False))
    return F.struct(over(lat_v, 0.1).alias("moving"), over(yaw, 0.03).alias("turned"))


def reach(gap: Column, has_follower: Column) -> Column:
    """What it takes to enter the gap; gap: to the target-lane follower, positive when it is behind."""
    return F.when(~has_follower, "free").when(gap < 0, "position_change").otherwise("direct")


def lateral_intention(y: Column, limit: float = 1.5) -> Column:
    return F.when(y > limit, "left").when(y < -limit, "right").otherwise("keep")


def heading(yaw: Column) -> Column:
    """Yaw in radians; beyond a full turn it can only be degrees."""
    return F.when(F.abs(yaw) > 2 * math.pi + 1e-3, F.radians(yaw)).otherwise(yaw)


def wrapped(angle: Column) -> Column:
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def turned(dx: Column, dy: Column, c: Column, s: Column) -> tuple[Column, Column]:
    """Forward and left components in a frame whose heading has cosine c and sine s."""
    return c * dx + s * dy, c * dy - s * dx


def rotated(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """Forward and left components in a frame of the given heading."""
    return turned(dx, dy, F.cos(yaw), F.sin(yaw))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; NaN compares as the largest number in Spark."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))
