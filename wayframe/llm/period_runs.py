"""Runs of words in texts: stretches that repeat a period four times or more, found in all texts of a batch at once.

The words of a batch stand in one array of numbers, each text between separators that occur nowhere else, so nothing matches across texts.

1. Longest common extensions (LCE). Of the suffixes only those at places of a difference cover modulo 31 are sorted, by their first 31 words
   and then by doubling. Whichever two places are compared, a few words further on, 30 at most, both are in the cover; so an extension is those few words,
   compared one by one, and then the least of the common prefixes between two ranks, which a sparse table answers. The same on the reversed array gives
   extensions to the left.
2. Harmonic grid. A run of period q and at least e q words has (e - 1) q neighbouring places whose word returns q words on, so one of them is a multiple of
   (e - 1) q. All such places, of which there are about N ln N / (e - 1) over all periods, are tried; where the word returns, the extensions to both sides give the whole stretch.
   A stretch that several periods give has the smallest of them.

Null, empty and blank texts have no words and no runs. Texts of any length are taken whole, at some 60 bytes a word. Repeated rows
give repeated results, and an empty table an empty one. Only doc_id and text are read, so other columns cannot clash. Of runs of equal
length the first is the longest, then the one of the smaller period; a null doc_id is given back, and op12_period_runs plants nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A perfect difference cover, each remainder but 0 being the difference of just one pair.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
RESULT = ("n_words", "runs", "collapsed")


def next_in_cover() -> np.ndarray:
    """At [a, b]: how far two places of remainders a and b are from two places of the cover."""
    inside = np.zeros(MODULUS, dtype=bool)
    inside[list(COVER)] = True
    a, b, s = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(inside[(a + s) % MODULUS] & inside[(b + s) % MODULUS], axis=2)


SHIFT = next_in_cover()


class Extensions:
    """Lengths of the longest common prefixes of pairs of suffixes of `words`, an array of numbers from 1 on."""

    def __init__(self, words: np.ndarray, longest: int):
        """longest: no two suffixes have more words in common."""
        self.n = n = len(words)
        self.words = np.r_[words, np.zeros(2 * MODULUS, dtype=words.dtype)]
        self.place = np.full(MODULUS, -1, dtype=np.int64)
        self.place[list(COVER)] = np.arange(len(COVER))
        at = (np.arange(0, n, MODULUS)[:, None] + np.array(COVER)).ravel()
        self.at = at[at < n]
        self._sort(longest)

    def sample(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the samples at places of the cover."""
        return at // MODULUS * len(COVER) + self.place[at % MODULUS]

    def _sort(self, longest: int) -> None:
        m, c = len(self.at), len(COVER)
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        per = 63 // bits
        rank = np.zeros(m, dtype=np.int64)
        for k in range(0, MODULUS, per):
            key = np.zeros(m, dtype=np.int64)
            for step in range(k, min(k + per, MODULUS)):
                key = key << bits | self.words[self.at + step]
            rank = _ranks(rank, key)
        levels, step = [rank], 1
        while len(rank) and rank.max() < m and step * MODULUS <= longest:
            ahead = np.zeros(m, dtype=np.int64)
            ahead[: max(0, m - c * step)] = rank[c * step :]
            rank = _ranks(rank, ahead)
            levels.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.rank = np.empty(m, dtype=np.int64)
        self.rank[self.order] = np.arange(m)
        self.table = self._table(levels)

    def _table(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Least common prefixes of neighbouring ranks over stretches of 1, 2, 4 ... ranks."""
        m, c = len(self.at), len(COVER)
        if not m:
            return [np.zeros(1, dtype=np.int64)]
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common_words = np.zeros(m - 1, dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            # two samples of one rank here have so many words in common
            inside = (a < m) & (b < m)
            same = np.zeros(m - 1, dtype=bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common_words += np.where(same, MODULUS << k, 0)
            a, b = a + same * (c << k), b + same * (c << k)
        common_words += self._short(self.at[self.order[:-1]] + common_words, self.at[self.order[1:]] + common_words, np.full(m - 1, MODULUS))
        table = [np.r_[0, common_words]]
        while 2 << len(table) - 1 <= m:
            half, last = 1 << len(table) - 1, table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        return table

    def _short(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words in common from i and j on, `most` at most."""
        out = np.zeros(len(i), dtype=np.int64)
        open_ = np.flatnonzero((np.maximum(i, j) < self.n) & (most > 0))
        for step in range(MODULUS):
            open_ = open_[(self.words[np.minimum(i[open_] + step, self.n)] == self.words[np.minimum(j[open_] + step, self.n)]) & (np.maximum(i[open_], j[open_]) + step < self.n)]
            out[open_] = step + 1
            open_ = open_[most[open_] > step + 1]
            if not len(open_):
                break
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from i and j on; i and j differ."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._short(i, j, shift)
        far = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        a, b = self.rank[self.sample(i[far] + shift[far])], self.rank[self.sample(j[far] + shift[far])]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp(high - low + 1.0)[1] - 1
        for level in np.unique(k):
            of = k == level
            t = self.table[level]
            out[far[of]] += np.minimum(t[low[of]], t[high[of] + 1 - (1 << level)])
        return out


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of pairs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else 0
    return out


def candidates(words: np.ndarray, longest: int, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grid, and periods, that a run may have: where a word returns, and with it its neighbours, as many as the shortest run has at least."""
    places, periods = [], []
    n = len(words)
    for q in range(1, longest // exponent + 1):
        grid = (exponent - 1) * q
        hit = np.flatnonzero(words[: n - q : grid] == words[q::grid]) * grid
        if len(hit):
            places.append(hit)
            periods.append(np.full(len(hit), q))
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, q = np.concatenate(places), np.concatenate(periods)
    if (exponent - 1) >= 3 or least >= 4:
        # a run of period q returns max((exponent - 1) q, least - q) neighbouring words, three or more here, of which i is one
        returns = lambda k: (i + k >= 0) & (i + k + q < n) & (words[np.clip(i + k, 0, n - 1)] == words[np.clip(i + k + q, 0, n - 1)])
        three = np.maximum((exponent - 1) * q, least - q) >= 3
        before2, before, after, after2 = (returns(k) for k in (-2, -1, 1, 2))
        some = ~three | (before & before2) | (before & after) | (after & after2)
        i, q = i[some], q[some]
    return i, q


def find_runs(words: np.ndarray, longest: int, i: np.ndarray, q: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs that candidates (i, q) lie in; words: texts of at most `longest` words, each between separators that occur once."""
    n = len(words)
    ahead = Extensions(words, longest)(i, i + q)
    back = Extensions(words[::-1], longest)(n - i, n - i - q)
    start, end = i - back, i + q + ahead
    held = end - start >= np.maximum(least, exponent * q)
    start, end, q = start[held], end[held], q[held]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, dtype=bool)
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def batch_runs(texts: list[str | None], exponent: int = 4, least: int = 6) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """RESULT of each text."""
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    if not sizes.sum():
        return [(0, [], "") for _ in texts]
    codes, known = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    # one separator before each text and one at the end
    starts = np.r_[0, np.cumsum(sizes)[:-1]] + np.arange(1, len(texts) + 1)
    separators = np.r_[starts - 1, sizes.sum() + len(texts)]
    array = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    inside = np.ones(len(array), dtype=bool)
    inside[separators] = False
    array[inside] = codes + 1
    array[separators] = len(known) + 1 + np.arange(len(separators))
    i, q = candidates(array, int(sizes.max()), exponent, least)
    owner = np.searchsorted(starts, i, side="right")
    inside = owner == np.searchsorted(starts, i + q, side="right")
    i, q, owner = i[inside], q[inside], owner[inside]
    if not len(i):
        return [(len(ws), [], b" ".join(ws).decode("utf-8")) for ws in split]
    # only texts with candidates are sorted
    held = np.unique(owner) - 1
    part = np.r_[np.concatenate([np.arange(starts[d] - 1, starts[d] + sizes[d]) for d in held]), separators[-1]]
    place = np.full(len(array), -1, dtype=np.int64)
    place[part] = np.arange(len(part))
    begin, end, period = find_runs(array[part], int(sizes[held].max()), place[i], q, exponent, least)
    begin, end = part[begin], part[end - 1] + 1
    step = np.zeros(len(array) + 1, dtype=np.int64)
    np.add.at(step, begin + period, 1)
    np.add.at(step, end, -1)
    gone = np.cumsum(step) > 0
    owner = np.searchsorted(starts, begin, side="right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, s, e, q in zip(owner.tolist(), (begin - starts[owner]).tolist(), (end - starts[owner]).tolist(), period.tolist()):
        runs[d].append((s, e - s, q))
    out = []
    for d, ws in enumerate(split):
        kept = [w for w, g in zip(ws, gone[starts[d] : starts[d] + len(ws)].tolist()) if not g] if runs[d] else ws
        out.append((len(ws), runs[d], b" ".join(kept).decode("utf-8")))
    return out


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed: the words that no run holds after
    its first period, joined by a space. A run has `exponent` periods, at least 2, and `least` words or more."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, kept = zip(*batch_runs(b.column("text").to_pylist(), exponent, least)) if b.num_rows else ([], [], [])
            rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())], names=["doc_id", *RESULT])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return common.in_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """docs, with a period put into the words of one text in ten: from a word on, as its doc_id says, the next words come again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return common.let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))), " "))

    text = F.when(F.col("h") % 10 == 0, common.let(common.words(F.col("text")), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(""))).otherwise(F.col("text"))
    return docs.select("doc_id", "text").withColumn("h", h).select("doc_id", text.alias("text"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(common.table(spark, sf_dir, "documents")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * -b.l div b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
