"""Nearest neighbours by largest inner product, from a forest of sorted arrays of hash strings.

A tree's hash string of a vector is the signs of its products with random directions, as a whole number whose first bit is the first
sign; vectors with a long common prefix point to much the same direction. Vectors first get one more component, with which all
have the length of the longest, so the largest inner product is the smallest angle; a query's is zero.

1. Candidates are dealt into blocks by the first bits of their string in the first tree, large ones in parts by a hash of the id, and so
   are queries. A block knows its mean direction and the largest angle to it.
2. Each query finds its place in the sorted arrays of a block of its own prefix, and ascends there, from the longest prefixes that
   it shares with entries, through all trees together until twice k entries are found. The k-th best of these bounds how far
   neighbours can be. A block of queries then meets only blocks that can hold anything within its queries' bounds, ascends in
   them alike, and so tightens the bounds before the blocks that remain are searched.
3. In such a block the ascent of each query goes on to the level `d`: all entries that share at least `d` signs with it in some tree. An entry at angle
   x shares d signs in one of t trees with chance 1 - (1 - (1 - x / pi)^d)^t, so d follows from the query's bound and `sure`, the least such
   chance at the bound. What is found is scored exactly on the original vectors; a window picks the k best.

Strings are made once, when a block is, and lie sorted beside its vectors. In a block the queries of a part are one matrix of entries, marked by ranges of
the sorted strings, and one product of matrices scores them.

So work follows the data: where neighbours stand out, strings are long, blocks few and entries few. Where they hardly do, as in
isotropic data of many dimensions, prefixes tell little and a larger part of the entries has to be scored.

Queries are a stated set, dealt in blocks against blocks of rows. Null vectors, vectors with null or non-finite components, zero
vectors and vectors of another than the most common length take no part, nor do rows with a null id. Equal vectors have equal
strings and are found together; ties go to the smaller id; repeated ids are separate candidates, and of queries that repeat an id
the one with the smallest vector, component by component, counts. An empty table gives an empty one. Only the columns of id and
vector are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Signs of a hash string, the bits of one whole number.
BITS = 60
#: Blocks of candidates whose means one row holds.
MEANS = 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that can take part, components as double."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    d = d.where(finite & F.exists("v", lambda x: x != 0))
    size = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    # one row: the most common length
    return d.join(F.broadcast(size), F.size("v") == F.col("n"), "left_semi")


def directions(trees: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS))


def lengthened(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more component. longest: the length that all are brought to; nothing is added to queries."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.column_stack([x, more])


def strings(y: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings [row, tree] of lengthened vectors."""
    signs = (y @ planes > 0).reshape(len(y), -1, BITS)
    whole = np.concatenate([np.zeros((*signs.shape[:2], 64 - BITS), dtype=bool), signs], axis=2)
    return np.packbits(whole, axis=2).view(">u8")[:, :, 0].astype(np.int64)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def depth_for(bound: np.ndarray, trees: int, sure: float) -> np.ndarray:
    """[query, tree]: the longest prefixes with which an entry at the angle `bound` is found with a chance of at least `sure`.

    As lengths are whole, some trees take a sign less than the others.
    """
    agree = np.clip(1 - bound / np.pi, 1e-9, 1 - 1e-12)
    d = np.clip(np.log(1 - (1 - sure) ** (1 / trees)) / np.log(agree), 0, BITS - 1).astype(np.int64)
    miss, more = np.log1p(-np.minimum(agree**d, 1 - 1e-12)), np.log1p(-np.minimum(agree ** (d + 1), 1 - 1e-12))
    shorter = np.ceil((np.log(1 - sure) - trees * more) / np.minimum(miss - more, -1e-300))
    return d[:, None] + (np.arange(trees) >= np.clip(shorter, 0, trees)[:, None])


class Forest:
    """A block of candidates and their sorted hash strings, tree by tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, order: np.ndarray):
        """codes: [row, tree], each tree's strings sorted; order: whose they are."""
        self.ids, self.x, self.sorted, self.order = ids, x, codes, order
        self.longest = float(np.sqrt((x * x).sum(1).max(initial=0)))

    def ranges(self, codes: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, tree]: where entries that share the first d signs, d by query or by query and tree, start and end."""
        shift = BITS - (d if d.ndim == 2 else np.repeat(d[:, None], codes.shape[1], axis=1))
        first = codes >> shift << shift
        low, high = np.empty_like(codes), np.empty_like(codes)
        for t in range(codes.shape[1]):
            low[:, t] = np.searchsorted(self.sorted[:, t], first[:, t])
            high[:, t] = np.searchsorted(self.sorted[:, t], first[:, t] + (1 << shift[:, t]))
        return low, high

    def entries(self, codes: np.ndarray, d: np.ndarray) -> np.ndarray:
        """[query, candidate]: which candidates share the first d signs in some tree.

        Where the ranges of a tree are few or short their entries are marked one by one; where they are long, queries have them in
        common, so each range becomes a set of bits once, and the sets of the trees are joined.
        """
        (m, trees), n = codes.shape, len(self.ids)
        low, high = self.ranges(codes, d)
        out, bits = np.zeros((m, n), dtype=bool), np.zeros((m, -(-n // 8)), dtype=np.uint8)
        for t in range(trees):
            if (high[:, t] - low[:, t]).sum() * 16 <= m * n:
                row, place = spread(low[:, t], high[:, t])
                out[row, self.order[place, t]] = True
                continue
            both, of = np.unique(low[:, t] * (n + 1) + high[:, t], return_inverse=True)
            sets = np.zeros((len(both), n), dtype=bool)
            row, place = spread(both // (n + 1), both % (n + 1))
            sets[row, self.order[place, t]] = True
            bits |= np.packbits(sets, axis=1)[of]
        return out | np.unpackbits(bits, axis=1, count=n).astype(bool)

    def ascended(self, codes: np.ndarray, own: np.ndarray, enough: int) -> np.ndarray:
        """[query, candidate]: the entries of the deepest level at which the trees together hold enough, all where none does."""
        d, top = np.zeros(len(codes), dtype=np.int64), np.full(len(codes), BITS)
        while (d < top).any():  # halving, as prefixes of fewer signs hold more
            mid = (d + top + 1) // 2
            low, high = self.ranges(codes, mid)
            held = (high - low).sum(1) >= enough
            d, top = np.where(held, mid, d), np.where(held, top, mid - 1)
        out = np.zeros((len(codes), len(self.ids)), dtype=bool)
        todo = np.arange(len(codes))
        while len(todo):  # entries of several trees are often the same ones
            out[todo] = self.entries(codes[todo], d[todo]) & (own[todo, None] != self.ids)
            todo = todo[(d[todo] > 0) & (out[todo].sum(1) < enough)]
            d[todo] -= 1
        return out

    def search(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int, bound: np.ndarray | None, sure: float, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, place of the candidate, score, number scored) of the k best found for each query. bound: angles; without them, from twice k entries.

        One product of matrices scores a part of the queries. It only chooses: what lies within its rounding of the k-th is scored again, row by row,
        so that equal vectors have equal scores.
        """
        eps = (8 * x.shape[1] + 64) * np.finfo(float).eps if len(x) else 0.0
        for a in range(0, len(ids), at_once):
            own, q, c = ids[a : a + at_once], x[a : a + at_once], codes[a : a + at_once]
            if bound is None:
                held = self.ascended(c, own, 2 * k)
            else:
                held = self.entries(c, depth_for(bound[a : a + at_once], c.shape[1], sure)) & (own[:, None] != self.ids)
            score = np.where(held, q @ self.x.T, -np.inf)
            some = min(k, len(self.ids))
            kth = np.partition(score, len(self.ids) - some, axis=1)[:, len(self.ids) - some]
            slack = 2 * eps * np.sqrt((q * q).sum(1)) * self.longest
            row, at = np.nonzero(held & (score >= (kth - slack)[:, None]))
            exact = (self.x[at] * q[row]).sum(1)
            order = np.lexsort((self.ids[at], -exact, row))
            row, at, exact = row[order], at[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at, exact = row[best], at[best], exact[best]
            yield row + a, at, exact, held.sum(1)[row]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places in ranges."""
    size = high - low
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


BLOCK = "p long, part long, ids binary, v binary, codes binary, placed binary, mean array<double>, wide double"


def blocks(rows: DataFrame, planes: np.ndarray, longest: float, query: bool, bits: int, size: int) -> DataFrame:
    """Rows of BLOCK: of vectors whose first strings begin with p, parts of about `size`, with the hash strings of all trees, sorted by tree unless
    they are queries; mean direction, and largest angle to it. Strings are made here, once."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = lengthened(np.array(b["v"].tolist(), dtype=np.float64).reshape(len(b), -1), longest, query) if len(b) else np.zeros((0, len(planes)))
            yield b.assign(p=strings(y, planes[:, :BITS])[:, 0] >> (BITS - bits))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id", kind="stable")
        x = np.array(b["v"].tolist(), dtype=np.float64)
        y = lengthened(x, longest, query)
        codes, order = np.concatenate([strings(y[a : a + 1024], planes) for a in range(0, len(y), 1024)]), None
        if not query:
            order = np.argsort(codes, axis=0, kind="stable")
            codes = np.take_along_axis(codes, order, 0)
        y /= np.sqrt((y * y).sum(1, keepdims=True))
        mean = y.mean(0)
        mean = mean / max(float(np.sqrt(mean @ mean)), 1e-300)
        return pd.DataFrame({
            "p": [key[0]], "part": [key[1]], "ids": [b["vec_id"].to_numpy(dtype="<i8").tobytes()], "v": [x.astype("<f8").tobytes()], "codes": [codes.astype("<i8").tobytes()],
            "placed": [None if order is None else order.astype("<i4").tobytes()], "mean": [mean], "wide": [float(angle(y @ mean).max())],
        })

    placed = common.in_batches(rows).mapInPandas(locate, "vec_id long, v array<double>, p long")
    sizes = placed.groupBy("p").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = placed.join(sizes, "p").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")))
    return dealt.groupBy("p", "part").applyInPandas(run, BLOCK)


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, trees: int = 48, sure: float = 0.92, block: int = 8192, query_block: int = 1024, seed: int = 11, count_scored: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found among the candidates other than itself.

    candidates and queries: (vec_id, v) of usable(). count_scored: instead, (query_id, scored), how many candidates each query was scored against.
    """
    facts = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    spark = candidates.sparkSession
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    planes, longest = directions(trees, facts["dim"], seed), float(facts["most"]) ** 0.5
    bits = min(BITS, max(0, int(np.ceil(np.log2(facts["n"] / block)))))
    c = common.checkpointed(blocks(candidates, planes, longest, False, bits, block))
    q = common.checkpointed(blocks(queries, planes, longest, True, bits, query_block))
    place = lambda name: F.struct("p", "part").alias(name)
    q_rows = q.select(place("q"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.col("codes").alias("q_codes"))

    kind = "struct<p: long, part: long>"
    hit = f"q {kind}, c {kind}, place long, query_id long, vec_id long, score double, cosine double, scored long"

    def search(bounded: bool):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name = forest = None
            for b in batches:
                for row in b.itertuples():
                    if row.ids is not None:  # a block of candidates comes before the blocks of queries that meet it
                        ids = np.frombuffer(row.ids, dtype="<i8")
                        codes, order = (np.frombuffer(v, dtype=t).reshape(len(ids), -1) for v, t in ((row.codes, "<i8"), (row.placed, "<i4")))
                        name, forest = (row.c["p"], row.c["part"]), Forest(ids, np.frombuffer(row.v, dtype="<f8").reshape(len(ids), -1), codes, order)
                        continue
                    assert name == (row.c["p"], row.c["part"])
                    mine = np.frombuffer(row.q_ids, dtype="<i8")
                    x, codes = (np.frombuffer(v, dtype=t).reshape(len(mine), -1) for v, t in ((row.q_v, "<f8"), (row.q_codes, "<i8")))
                    bound = None
                    if bounded:
                        bound = np.full(len(mine), np.pi)
                        bound[np.searchsorted(mine, np.frombuffer(row.b_ids, dtype="<i8"))] = np.frombuffer(row.b_angle, dtype="<f8")
                    at, found, score, scored = (np.concatenate(c) for c in zip(*forest.search(mine, x, codes, k, bound, sure)))
                    if len(at):
                        size = np.sqrt((x * x).sum(1))[at] * longest
                        scored = scored // np.bincount(at)[at]  # in all, about what was scored
                        yield pd.DataFrame({"q": [row.q] * len(at), "c": [row.c] * len(at), "place": found, "query_id": mine[at], "vec_id": forest.ids[found], "score": score, "cosine": score / size, "scored": scored})

        return each

    c_rows = c.select(place("c"), "ids", "v", "codes", "placed")

    def met(pairs: DataFrame, bounded: bool) -> DataFrame:
        """What the blocks of queries of pairs (q, c, ...) find in the blocks of candidates; a block of candidates is one task's, and built once."""
        needed = c_rows.join(pairs.select("c").distinct(), "c", "left_semi")
        both = needed.unionByName(pairs.join(q_rows, "q"), allowMissingColumns=True)
        both = both.repartition(F.col("c")).sortWithinPartitions("c", F.col("ids").isNull())
        return common.in_batches(both).mapInPandas(search(bounded), hit)

    def widest(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("query_id")
        return pd.DataFrame({"q": [dict(zip(("p", "part"), key))], "b_ids": [b["query_id"].to_numpy(dtype="<i8").tobytes()], "b_angle": [angle(b["cosine"].to_numpy()).astype("<f8").tobytes()], "held": [len(b)], "most": [float(angle(b["cosine"].to_numpy()).max())]})

    by_query = Window.partitionBy("q", "query_id").orderBy(F.desc("cosine"))
    # means of blocks in pieces of about MEANS, of which each of the queries' meets each of the rows'
    def in_pieces(b: DataFrame, name: str, n: int, *more: str) -> DataFrame:
        held = b.withColumn(f"{name}_piece", F.pmod(F.xxhash64(name), F.lit(n)))
        return held.groupBy(f"{name}_piece").agg(*[F.collect_list(c).alias(f"{name}_{c}") for c in (name, "mean", "wide", *more)])

    c_pieces, q_pieces = (max(1, -(-facts["n"] // (size * MEANS))) for size in (block, query_block))
    means = in_pieces(c.select(place("c"), "mean", "wide"), "c", c_pieces)

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(q, c): the blocks whose members can be within `far` of those of a block of queries."""
        for b in batches:
            for r in b.itertuples():
                apart = angle(np.array([list(m) for m in r.q_mean]) @ np.array([list(m) for m in r.c_mean]).T) - np.array(r.q_wide)[:, None] - np.array(r.c_wide)
                for i in range(len(apart)):
                    near = np.flatnonzero(apart[i] <= r.q_far[i] + 1e-6).tolist()
                    yield pd.DataFrame({"q": [r.q_q[i]] * len(near), "c": [r.c_c[j] for j in near]})

    def within(hits: DataFrame) -> DataFrame:
        """(q, c, b_ids, b_angle): the blocks that can hold anything as near as the k-th of the hits, which bounds each query."""
        kth = hits.withColumn("turn", F.row_number().over(by_query)).where(F.col("turn") == k).select("q.p", "q.part", "query_id", "cosine")
        known = kth.groupBy("p", "part").applyInPandas(widest, f"q {kind}, b_ids binary, b_angle binary, held long, most double")
        mine = q.select(place("q"), F.col("mean").alias("q_mean"), F.col("wide").alias("q_wide"), (F.length("ids") / 8).alias("n")).join(known, "q", "left")
        mine = mine.withColumn("far", F.when(F.col("held") == F.col("n"), F.col("most")).otherwise(float(np.pi)))
        # of the stated queries, blocks against blocks of rows: only their means meet, a piece at a time
        mine = common.checkpointed(mine)
        pairs = in_pieces(mine.select("q", F.col("q_mean").alias("mean"), F.col("q_wide").alias("wide"), "far"), "q", q_pieces, "far")
        pairs = pairs.withColumn("c_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_pieces - 1).cast("long")))).join(means, "c_piece")
        near = common.in_batches(pairs).mapInPandas(reached, f"q {kind}, c {kind}").join(mine, "q")
        none = F.lit(b"")
        return common.checkpointed(near.select("q", "c", F.coalesce("b_ids", none).alias("b_ids"), F.coalesce("b_angle", none).alias("b_angle")))

    # a query block's own prefix, or else some block
    own = c.groupBy("p").agg(F.min(F.struct("p", "part")).alias("own"))
    some = c.agg(F.min(F.struct("p", "part")).alias("any"))  # one row
    home = q.select("p", place("q")).join(own, "p", "left").crossJoin(F.broadcast(some)).select("q", F.coalesce("own", "any").alias("c"))
    first = common.checkpointed(met(home, False))
    # with one block the second step would only repeat the first
    again = first if facts["n"] <= block else common.checkpointed(met(within(first).select("q", "c"), False))
    hits = met(within(again), True)
    if count_scored:
        return (first if again is first else first.unionByName(again)).unionByName(hits).groupBy("query_id").agg(F.sum("scored").alias("scored"))
    # a level is deep enough for an entry at the bound with the chance `sure`, so what an earlier step found counts too
    for step in [first] if again is first else [first, again]:
        hits = hits.unionByName(step)
    hits = hits.groupBy("query_id", "c", "place").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(common.table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
