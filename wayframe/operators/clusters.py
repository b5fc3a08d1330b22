"""K-means over points in the plane, all starts at once: a round is one pass over the points and one job, whatever the number of starts.

Centroids of all starts travel as one small array to the tasks. Each task sums its points per start and centroid, with the cost and the farthest
point of each; a shuffle adds these up, and starts x k rows reach the driver. Starts are seeded by k-means|| : in each of a few passes every
start draws many points at once, with chances by their squared distance to what it has, and a weighted k-means++ on the driver picks k of these.

Points are (id, x, y); those with a null or a coordinate that is not finite take no part. Repeated points count as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinematics import finite
from .lineage import train_only

SUMS = "start int, cluster int, n long, x double, y double, cost double, far double, far_key long, far_x double, far_y double"
SUMS_ARROW = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t]) for c, t in (f.split() for f in SUMS.split(", "))])
DRAWS = "start int, salt int, key double, h long, x double, y double"
CENTROIDS = "cluster int, x double, y double"


def usable(points: DataFrame) -> DataFrame:
    """(h, x, y): points that take part, with a hash of their id."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return points.where(finite(x) & finite(y)).select(F.xxhash64("id").alias("h"), x.alias("x"), y.alias("y"))


def uniform(h: np.ndarray, start: int, turn: int) -> np.ndarray:
    """Numbers above 0 and up to 1 that a hash, a start and a turn decide."""
    z = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + start * 1009 + turn * 7919)) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


#: Points of a tile, and points that are cut into tiles at a time.
TILE, POOL = 64, 65536


def tiles(points: np.ndarray) -> np.ndarray:
    """[tiles, TILE]: places of points in strips by x and in each strip by y, so that those of a tile are near each other; the last place fills up."""
    n = -(-len(points) // TILE)
    strips = max(1, round(n**0.5))
    strip = np.empty(len(points), dtype=np.int64)
    strip[np.argsort(points[:, 0], kind="stable")] = np.arange(len(points)) * strips // max(1, len(points))
    order = np.lexsort((points[:, 1], strip))
    return np.r_[order, order[-1:].repeat(n * TILE - len(order))].reshape(n, TILE)


def nearest(points: np.ndarray, centres: np.ndarray, tiled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The centre of each point, the first one on ties, and the squared distance; as sums of squares, so equal points give equal results.

    A tile's points are compared with those centres only that are no farther from its box than the box is, at most, from the nearest one. Rounding keeps order in
    differences, squares and sums, so what is left out is farther than what is found. tiled: of tiles(), where several sets of centres share them.
    """
    at, d2 = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    if not len(points):
        return at, d2
    tiled = tiles(points) if tiled is None else tiled
    step = max(1, 1_000_000 // max(1, len(centres)))
    for a in range(0, len(tiled), step):
        places = tiled[a : a + step]
        x, y = points[places, 0], points[places, 1]
        inner, outer = 0.0, 0.0
        for v, c in ((x, centres[:, 0]), (y, centres[:, 1])):
            lo, hi = v.min(1)[:, None] - c, v.max(1)[:, None] - c
            inner = inner + np.maximum(np.maximum(lo, -hi), 0) ** 2
            outer = outer + np.maximum(np.abs(lo), np.abs(hi)) ** 2
        near = inner <= outer.min(1)[:, None]
        many = near.sum(1)
        # centres of a tile in their order, those left out last
        of = np.argsort(~near, axis=1, kind="stable")
        for rows in np.array_split(np.argsort(many, kind="stable"), 8):
            if len(rows):
                px, py, best = x[rows], y[rows], np.full((len(rows), TILE), np.inf)
                found = np.broadcast_to(of[rows, :1], best.shape).copy()
                for j in range(many[rows].max()):
                    c = of[rows, j][:, None]
                    d = (px - centres[c, 0]) ** 2 + (py - centres[c, 1]) ** 2
                    less = d < best
                    np.copyto(best, d, where=less)
                    np.copyto(found, c, where=less)
                at[places[rows]], d2[places[rows]] = found, best
    return at, d2


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and points of some POOL rows at a time, and none that are empty: more points make closer tiles."""
    held, n = [], 0

    def taken() -> tuple[np.ndarray, np.ndarray]:
        h, x, y = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("h", "x", "y"))
        return h, np.column_stack([x, y])

    for b in batches:
        if b.num_rows:
            held, n = [*held, b], n + b.num_rows
        if n >= POOL:
            yield taken()
            held, n = [], 0
    if n:
        yield taken()


def assigned(points: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """SUMS, summed: of each start and centroid that has points, their number and sums, their cost, and the farthest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for h, p in arrays(batches):
            tiled = tiles(p)
            for s, c in enumerate(centres):
                at, d2 = nearest(p, c, tiled)
                n, k = np.bincount(at, minlength=len(c)), len(c)
                x, y, cost = (np.bincount(at, v, k) for v in (p[:, 0], p[:, 1], d2))
                most = np.full(k, -1.0)
                np.maximum.at(most, at, d2)
                far = np.flatnonzero(d2 == most[at])
                order = far[np.lexsort((-h[far], at[far]))]
                last = order[np.r_[at[order][1:] != at[order][:-1], True]]
                for i in last.tolist():
                    j = int(at[i])
                    new, old = (d2[i], -h[i], *p[i]), held.get((s, j))
                    held[s, j] = [n[j], x[j], y[j], cost[j], new] if old is None else [old[0] + n[j], old[1] + x[j], old[2] + y[j], old[3] + cost[j], max(old[4], new)]
        rows = [{"start": s, "cluster": j, "n": int(n), "x": float(x), "y": float(y), "cost": float(cost), "far": float(f[0]), "far_key": int(f[1]), "far_x": float(f[2]), "far_y": float(f[3])} for (s, j), (n, x, y, cost, f) in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=SUMS_ARROW)

    each = points.mapInArrow(run, SUMS)
    return each.groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "cost")], F.max(F.struct("far", "far_key", "far_x", "far_y")).alias("far"))


def drawn(points: DataFrame, centres: list[np.ndarray | None], many: int, turn: int, seed: int) -> list[np.ndarray]:
    """For each start `many` points, drawn without return with chances by squared distance to its centres (alike without centres); fewer if no more differ from these.

    Exponential races: the points of the smallest -ln(u) / weight are such a sample, and the smallest of all are among the smallest of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, best = TaskContext.get().partitionId() % 256, [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros((0, 2)))] * len(centres)
        for h, p in arrays(batches):
            tiled = tiles(p)
            for s, c in enumerate(centres):
                weight = np.ones(len(p)) if c is None else nearest(p, c, tiled)[1]
                with np.errstate(divide="ignore"):
                    key = -np.log(uniform(h, seed + s, turn)) / weight
                some = weight > 0
                if many < len(p):
                    some &= key <= np.partition(key, many - 1)[many - 1]
                key, hs, ps = (np.concatenate(v) for v in zip(best[s], (key[some], h[some], p[some])))
                order = np.lexsort((hs, key))[:many]
                best[s] = key[order], hs[order], ps[order]
        for s, (key, h, p) in enumerate(best):
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), v, dtype=np.int32)) for v in (s, salt)] + [pa.array(key), pa.array(h), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["start", "salt", "key", "h", "x", "y"])

    found = points.mapInArrow(run, DRAWS)
    for keys in (("start", "salt"), ("start",)):
        order = Window.partitionBy(*keys).orderBy("key", "h", "x", "y")
        found = found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= many).drop("turn")
    rows = found.orderBy("start", "key", "h").select("start", "x", "y").collect()
    return [np.array([(r["x"], r["y"]) for r in rows if r["start"] == s]).reshape(-1, 2) for s in range(len(centres))]


def plus_plus(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of weighted candidates, each next one with chance by weight and squared distance; as many as differ, if fewer."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    d2 = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (d2 * weights).sum() > 0:
        chosen.append(int(rng.choice(len(candidates), p=d2 * weights / (d2 * weights).sum())))
        d2 = np.minimum(d2, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen]


def seeded(points: DataFrame, k: int, starts: int, seed: int = 0, passes: int = 5, many: int | None = None) -> list[np.ndarray]:
    """k first centroids for each start by k-means||, from `many` draws a pass (2 k). points: of usable()."""
    centres = drawn(points, [None] * starts, 1, 0, seed)
    for turn in range(1, passes + 1):
        more = drawn(points, centres, many or 2 * k, turn, seed)
        centres = [np.concatenate(pair) for pair in zip(centres, more)]
    weights = [np.zeros(len(c)) for c in centres]
    for r in assigned(points, centres).select("start", "cluster", "n").collect():
        weights[r["start"]][r["cluster"]] = r["n"]
    rng = lambda s: np.random.default_rng([seed, s])
    return [plus_plus(c, w, k, rng(s)) if len(c) and w.sum() else c for s, (c, w) in enumerate(zip(centres, weights))]


def moved(points: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """One Lloyd step of all starts in one job: the means of the centroids' points, and the cost before.

    The farthest of all points takes the place of a centroid without points; of several such, the next takes the farthest of another centroid.
    """
    sums: list[dict] = [{} for _ in centres]
    for r in assigned(points, centres).collect():
        sums[r["start"]][r["cluster"]] = r
    new, cost = [], []
    for c, rows in zip(centres, sums):
        means = c.copy()
        for j, r in rows.items():
            means[j] = r["x"] / r["n"], r["y"] / r["n"]
        far = sorted((tuple(r["far"]) for r in rows.values()), reverse=True)
        for j, f in zip([j for j in range(len(c)) if j not in rows], far):
            means[j] = f[2:]
        new.append(means)
        cost.append(sum(r["cost"] for r in rows.values()))
    return new, cost


def lloyd_starts(points: DataFrame, centres: list[np.ndarray], rounds: int = 300, tolerance: float = 1e-4) -> tuple[list[np.ndarray], list[float], int]:
    """Centroids and costs of all starts after Lloyd rounds, and the number of jobs: at most one a round and one for the costs.

    A start whose centroids move by at most the tolerance takes no further part. points: of usable().
    """
    centres, jobs, open_ = [c.copy() for c in centres], 0, list(range(len(centres)))
    while open_ and jobs < rounds:
        new, _ = moved(points, [centres[s] for s in open_])
        jobs += 1
        still = [s for s, c in zip(open_, new) if len(c) and np.sqrt(((c - centres[s]) ** 2).sum(1)).max() > tolerance]
        for s, c in zip(open_, new):
            centres[s] = c
        open_ = still
    return centres, moved(points, centres)[1], jobs + 1


def frame(points: DataFrame, centres: np.ndarray) -> DataFrame:
    return points.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(centres)], CENTROIDS)


def matrix(centroids: DataFrame) -> np.ndarray:
    """Centroids (cluster, x, y) in the order of cluster; there are as many as anchors are wanted."""
    return np.array([(r["x"], r["y"]) for r in centroids.orderBy("cluster").collect()]).reshape(-1, 2)


def seeds(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """First centroids (cluster, x, y) of one start; fewer where fewer points differ."""
    p = usable(points)
    return frame(points, seeded(p, k, 1, seed)[0])


def lloyd(points: DataFrame, start: DataFrame, rounds: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """Centroids (cluster, x, y) after Lloyd rounds from start; clusters are numbered from 0 in the order of start."""
    p = usable(points).persist()
    try:
        return frame(points, lloyd_starts(p, [matrix(start)], rounds, tolerance)[0][0])
    finally:
        p.unpersist()


def lloyd_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, n, x, y, cost) of the centroids that have points: the means that a Lloyd step moves them to, and their cost before."""
    at = assigned(usable(points), [matrix(centroids)])
    return at.select("cluster", "n", (F.col("x") / F.col("n")).alias("x"), (F.col("y") / F.col("n")).alias("y"), "cost")


def inertia(points: DataFrame, centroids: DataFrame) -> float:
    """Sum of the squared distances of points to their nearest centroids."""
    return moved(usable(points), [matrix(centroids)])[1][0]


def anchors(points: DataFrame, k: int = 64, starts: int = 10, rounds: int = 300, seed: int = 0, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """The centroids of the smallest inertia of several starts, the earlier start on ties, and that inertia. Fewer than k distinct points, and points with a
    source_split other than train, are an error."""
    p = usable(train_only(points)).persist()
    try:
        if p.select("x", "y").distinct().limit(k).count() < k:
            raise ValueError(f"fewer than {k} distinct points")
        centres, costs, _ = lloyd_starts(p, seeded(p, k, starts, seed), rounds, tolerance)
    finally:
        p.unpersist()
    best = min(range(starts), key=lambda s: (len(centres[s]) < k, costs[s], s))
    return frame(points, centres[best]), costs[best]
