"""Scalers, exact nearest neighbours with exclusions, weighted contexts, and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clusters import anchors, inertia, lloyd, lloyd_step, seeds  # noqa: F401
from .lineage import train_only


def moments(rows: DataFrame, vector: str, eps: float = 1e-6, two_moment: bool = False) -> DataFrame:
    """(pos, mean, std) of the components of arrays. Partial sums per task, so what is shuffled does not grow with the rows.

    Rows with a source_split other than train are an error.

    two_moment: E[x^2] - mean^2 with the mean as a float, both it and std at least eps; else the population std, 1 where below eps.
    """
    x = train_only(rows).select(F.posexplode(vector).alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))
    if two_moment:
        m = x.groupBy("pos").agg(F.avg("x").cast("float").cast("double").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("sq"))
        return m.select("pos", "mean", F.greatest(F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(eps))), F.lit(eps)).alias("std"))
    m = x.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return m.select("pos", "mean", F.when(F.col("std") < eps, 1.0).otherwise(F.col("std")).alias("std"))


def scaled(rows: DataFrame, vector: str, scaler: DataFrame) -> DataFrame:
    """rows with the vector standardised. The scaler has a row per component, so it fits in one."""
    one = scaler.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_s"))
    joined = rows.crossJoin(F.broadcast(one))  # one row
    return joined.withColumn(vector, F.zip_with(vector, "_s", lambda v, s: (v - s["mean"]) / s["std"])).drop("_s")


def checked_matrix(x: np.ndarray, nonzero: bool = False) -> np.ndarray:
    """x, or an error where it is no matrix, has no columns, a number that is not finite or, if nonzero, a row of zeros, which has no direction."""
    if x.ndim != 2 or not x.shape[1]:
        raise ValueError(f"vectors of shape {x.shape}: one width, and not empty")
    if not np.isfinite(x).all():
        raise ValueError("vectors with numbers that are not finite")
    if nonzero and not (x != 0).any(1).all():
        raise ValueError("a zero vector has no cosine")
    return x


def knn(
    queries: DataFrame, index: DataFrame, k: int = 4, metric: str = "euclidean", exclude_self: bool = True, exclude_group: bool = True, block: int = 4096, pad: bool = False
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest of (id, grp, v), exact, ties to the smaller id. A null group is in no group.

    Ids are whole numbers or texts, of one kind on both sides; rows without an id take no part. Vectors must have one width, finite numbers and, under cosine, a
    length above zero: others are an error. Queries with fewer than k neighbours have fewer rows, or, with pad, rows up to k without neighbour at an infinite distance.

    Both sides are packed into blocks of rows; a pair of blocks is one matrix product. A task that meets a block of queries with several blocks of the index, one after
    the other, keeps k rows a query of all of them, so what is shuffled does not grow with the pairs.
    Neither side is broadcast or held whole. Products only choose candidates, within a bound of their rounding of the k-th; the
    distances of these are sums over components in double precision, so equal vectors are equally far.
    """
    if metric not in ("euclidean", "cosine") or k < 1:
        raise ValueError(f"{metric}, k {k}")
    kind = "long" if all(isinstance(d.schema["id"].dataType, T.IntegralType) for d in (queries, index)) else "string"
    queries, index = (d.where(F.col("id").isNotNull()) for d in (queries, train_only(index)))
    n = queries.select(F.lit(1).alias("q")).unionByName(index.select(F.lit(0).alias("q"))).agg(F.sum("q"), F.count("*")).first()
    nq, ni = (-(-m // block) or 1 for m in (n[0] or 0, n[1] - (n[0] or 0)))

    def vectors(v: pd.Series) -> np.ndarray:
        if len({len(x) if x is not None else -1 for x in v}) > 1:
            raise ValueError("vectors of several widths")
        return checked_matrix(np.array([[np.nan if y is None else y for y in x] for x in v], dtype="<f8"), metric == "cosine")

    def packed(rows: DataFrame, n: int, name: str) -> DataFrame:
        def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("id", kind="stable")
            grp = [g if isinstance(g, str) else None for g in b["grp"]]
            return pd.DataFrame({name: [key[0]], f"{name}_ids": [b["id"].tolist()], f"{name}_grp": [grp], f"{name}_v": [vectors(b["v"]).tobytes()]})

        numbered = rows.select(F.col("id").cast(kind), F.col("grp").cast("string").alias("grp"), "v").withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)))
        return numbered.groupBy(name).applyInPandas(run, f"{name} long, {name}_ids array<{kind}>, {name}_grp array<string>, {name}_v binary")

    pairs = packed(index, ni, "i").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long")))).join(packed(queries, nq, "q"), "q")

    def least(row: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k of each row, by distance, then id."""
        order = np.lexsort((ids, d, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        return np.sort(row[np.arange(len(row)) - np.searchsorted(row, row) < k]), ids[order], d[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # what is found so far for the block of queries at hand: a pair of blocks adds only what may be nearer
        block_of, mine, best = None, np.zeros(0), []

        def held() -> Iterator[pd.DataFrame]:
            for at, (row, near, far) in zip(range(0, len(mine), 256), best):
                yield pd.DataFrame({"query_id": mine[at + row], "neighbor_id": near, "distance": far})

        for b in batches:
            for r in b.itertuples():
                ids = np.array(r.i_ids)
                if r.q != block_of:
                    yield from held()
                    block_of, mine = r.q, np.array(r.q_ids)
                    best = [(np.zeros(0, dtype=np.int64), ids[:0], np.zeros(0)) for _ in range(0, len(mine), 256)]
                x, q = np.frombuffer(r.i_v).reshape(len(ids), -1), np.frombuffer(r.q_v).reshape(len(mine), -1)
                names, both = np.unique([g or "" for g in (*r.i_grp, *r.q_grp)], return_inverse=True)
                both[[g is None for g in (*r.i_grp, *r.q_grp)]] = -1  # rows without a group exclude none
                groups, own = both[: len(ids)], both[len(ids) :]
                same = np.isin(mine, ids)
                if metric == "cosine":
                    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
                    x, q = unit(x), unit(q)
                xx = (x * x).sum(1)
                # of a sum of n products, rounding is at most about n eps |a| |b|, and a square's terms are at most (|a| + |b|)^2
                eps = (8 * x.shape[1] + 64) * np.finfo(float).eps
                for turn, at in enumerate(range(0, len(mine), 256)):
                    part = q[at : at + 256]
                    pp = (part * part).sum(1)
                    d = part @ x.T
                    if metric == "cosine":
                        np.subtract(1, d, out=d)
                        slack = np.full(len(part), eps)
                    else:
                        d *= -2
                        d += pp[:, None] + xx
                        slack = eps * (np.sqrt(pp) + np.sqrt(xx[np.isfinite(xx)].max(initial=0))) ** 2
                    if exclude_self and same[at : at + 256].any():
                        again = np.flatnonzero(same[at : at + 256])
                        d[again] = np.where(mine[at + again, None] == ids, np.inf, d[again])
                    if exclude_group:
                        d[(own[at : at + 256, None] == groups) & (groups >= 0)] = np.inf
                    # the k-th of the least of pieces is not below the k-th of all
                    cuts = np.arange(0, len(ids), max(1, min(64, len(ids) // k)))
                    pieces = np.minimum.reduceat(d, cuts, axis=1)
                    m = min(k, len(cuts))
                    kth = np.partition(pieces, m - 1, axis=1)[:, m - 1] if len(cuts) >= k else np.full(len(part), np.inf)
                    kth[np.isnan(kth)] = np.inf
                    row, near, far = best[turn]
                    full = np.flatnonzero(np.bincount(row, minlength=len(part)) == k)
                    last = far[np.searchsorted(row, full, "right") - 1]
                    kth[full] = np.minimum(kth[full], last if metric == "cosine" else last**2)
                    at_row, at_id = np.divmod(np.flatnonzero((d <= (kth + 2 * slack)[:, None]) & (d < np.inf)), len(ids))
                    # in pieces, as many may be as near
                    for a in range(0, len(at_row), 65536):
                        i, j = at_row[a : a + 65536], at_id[a : a + 65536]
                        exact = np.maximum(1 - (x[j] * part[i]).sum(1), 0) if metric == "cosine" else np.sqrt(((x[j] - part[i]) ** 2).sum(1))
                        row, near, far = least(np.r_[row, i], np.concatenate([near, ids[j]]), np.r_[far, exact])
                    best[turn] = row, near, far
        yield from held()

    hits = pairs.mapInPandas(run, f"query_id {kind}, neighbor_id {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    near = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
    if not pad:
        return near
    held = queries.select(F.col("id").cast(kind).alias("query_id")).distinct().join(near.groupBy("query_id").agg(F.count("*").cast("int").alias("n")), "query_id", "left")
    few = held.withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    more = few.select("query_id", F.explode(F.sequence(F.col("n") + 1, F.lit(k))).alias("rank"), F.lit(None).cast(kind).alias("neighbor_id"), F.lit(float("inf")).alias("distance"))
    return near.unionByName(more)


def mean_context(neighbors: DataFrame, contexts: DataFrame, inverse_distance: bool = True, eps: float = 1e-6, queries: DataFrame | None = None, width: int = 17) -> DataFrame:
    """(query_id, pos, value): mean context of a query's neighbours, by 1 / distance or evenly. contexts: (id, context).

    queries: (query_id); those of them without neighbours have a context of `width` zeros, and without it none.
    """
    weight = 1.0 / F.greatest("distance", F.lit(eps)) if inverse_distance else F.lit(1.0)
    j = neighbors.join(contexts.withColumnRenamed("id", "neighbor_id"), "neighbor_id").select("query_id", weight.alias("w"), F.posexplode("context").alias("pos", "x"))
    means = j.groupBy("query_id", "pos").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("value"))
    if queries is None:
        return means
    alone = queries.select("query_id").join(neighbors.select("query_id"), "query_id", "left_anti")
    return means.unionByName(alone.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("pos"), F.lit(0.0).alias("value")))


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points (id, x, y) with cluster and d2; the smaller cluster on ties. centroids: (cluster, x, y), as many as anchors are wanted."""
    all_ = centroids.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster", "x", "y"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(((F.col("x") - c["x"]) ** 2 + (F.col("y") - c["y"]) ** 2).alias("d2"), c["cluster"].alias("cluster"))))
    return points.crossJoin(F.broadcast(all_)).withColumn("_b", best).select("id", "x", "y", "_b.cluster", "_b.d2")


def endpoint(points: Column, mask: Column) -> Column:
    """Last valid, finite point of an array of (x, y), or null."""
    ok = lambda p, m: m & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    kept = F.filter(F.zip_with(points, mask, lambda p, m: F.when(ok(p, m), p)), lambda p: p.isNotNull())
    return F.try_element_at(kept, F.lit(-1))
