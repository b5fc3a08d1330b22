"""Exact n-gram Jaccard join of a corpus with itself, and its classes of linked documents.

A document's set holds its distinct shingles of five words, letters A-Z in lower case; with fewer words, the whole sequence.
Any two sets of Jaccard similarity t share a shingle among the first |x| - ceil(t |x|) + 1 of each in one order of all shingles.
The order here is by document frequency over the whole corpus, rare first, so a shingle of one document alone uses up a place
but can match nothing and is not dealt out at all. What is left of the prefixes is small.

1. Frequencies: numpy packs the shingle hashes of many documents into one row per range of hashes, those of equal sets once; a
   range's rows meet in one task, which counts its shingles, and finds equal sets by digest. Rows are dealt back by document.
   The most frequent shingles, by a bounded sample, come last in the order whatever their counts, so they go straight back.
2. Documents of equal sets are one class from here on, represented by their smallest doc_id.
3. Candidates share a prefix shingle and pass the length and position bounds. In every shingle's group they first meet a few
   pivots, the same in all groups where they occur, and only documents that links do not yet join meet further ones; what rounds of
   pivots leave is paired within bands of length, in pieces. A pair passes the suffix bound or is intersected, once.

Linked classes are thus found without all pairs of a large group of near copies, and no link between classes is lost.
Every row has a row of the result. A doc_id that repeats is one document, linked with whatever one of its texts links with, and each
of its rows has its own n_shingles. Rows without doc_id link with nothing and have a null component_id. Null and blank texts have
the empty set and link with nothing. An empty table gives an empty one. Texts of any length are taken whole, one text at a time
at least. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
#: Fixed odd multipliers of the hashes.
P1, P2, P3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: df of shingles that come last in the order.
LAST = np.iinfo(np.int32).max
#: Rows of a shingle in a piece of the final pairing.
PIECE = 1024
#: Digests that a task remembers from batch to batch, some 30 MB; copies of others meet in their range.
REMEMBERED = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(P2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(P3)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, sorted by both."""
    raw = b" ".join(t.encode("utf-8", "replace") for t in texts).lower()  # of bytes: A-Z only
    b = np.frombuffer(raw, dtype=np.uint8)
    first = np.cumsum([0, *(len(t.encode("utf-8", "replace")) + 1 for t in texts)])[:-1]
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if not len(start):
        return none
    size = end - start
    powers = np.cumprod(np.full(int(size.max()), P1, dtype=np.uint64))
    at = np.flatnonzero(inside)
    cut = np.cumsum(size) - size
    word = mixed(np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(at)) - np.repeat(cut, size)], cut) + size.astype(np.uint64))
    doc = np.searchsorted(first, start, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    head = np.cumsum(count) - count
    # one shingle from each word that has four more after it in its document, or that begins a shorter document
    left = head[doc] + count[doc] - np.arange(len(word))
    begins = np.flatnonzero((left >= WORDS) | ((count[doc] < WORDS) & (left == count[doc])))
    h = np.zeros(len(begins), dtype=np.uint64)
    for k in range(WORDS):
        more = left[begins] > k
        h[more] += mixed(word[begins[more] + k] * np.uint64(2 * k + 1) + np.uint64(k))
        h *= np.uint64(P1)
    h, doc = mixed(h + np.minimum(left[begins], WORDS).astype(np.uint64)), doc[begins]
    order = np.argsort(h, kind="quicksort")
    order = order[np.argsort(doc[order].astype(np.uint16) if len(texts) < 1 << 16 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    return doc[new], h[new]


def in_parts(texts: list[str], size: int = 3_000_000, most: int = 20_000) -> Iterator[slice]:
    """Slices of about `size` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i - start >= most or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, total = i + 1, 0


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values starts in columns sorted by them."""
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def dealt(keys: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> dict[int, dict[str, bytes]]:
    """The columns as bytes for each key below n, rows in their order."""
    order = np.argsort(keys.astype(np.uint16) if n < 1 << 16 else keys, kind="stable")
    cuts = np.searchsorted(keys[order], np.arange(n + 1))
    moved = {c: v[order] for c, v in columns.items()}
    return {k: {c: v[cuts[k] : cuts[k + 1]].tobytes() for c, v in moved.items()} for k in range(n) if cuts[k] < cuts[k + 1]}


ELEMENTS = {"low": np.uint32, "of": np.int64, "times": np.uint32}
DOCS = {"id": np.int64, "n": np.int64, "d1": np.uint64, "d2": np.uint64}
#: What goes straight back by document: frequent shingles, and documents whose set another one of the task has, or that have none.
BACK = {"e_id": np.int64, "gram": np.int64, "df": np.int32, "b_id": np.int64, "b_n": np.int64, "rep": np.int64}
DIRECT = {f"x_{c}": kind for c, kind in BACK.items()}


def binary(columns) -> str:
    return ", ".join(f"`{c}` binary" for c in columns)


def joined(values, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in values if v is not None), dtype=kind)


def bucket(ids: np.ndarray, ranges: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)


def sample_of(docs: DataFrame) -> tuple[int, float]:
    """(rows, share) for frequent(): one document in a thousand, at least 4,000 and at most 1,000,000, and 40 of them. So a shingle that is not found
    frequent is in some 40,000 documents, or, beyond 10^9 documents, in some 40 in a million."""
    rows = min(1_000_000, max(4_000, docs.count() // 1000))
    return rows, 40 / rows


def frequent(docs: DataFrame, rows: int, share: float) -> np.ndarray:
    """Sorted hashes of the shingles of at least `share` of some `rows` documents: at most the mean size of a set / share.

    The sample decides only the order in which shingles are compared, not which links are found.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for part in in_parts(texts):
                h, n = np.unique(shingle_sets(texts[part])[1], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    each = common.in_batches(docs.select("text").limit(rows)).mapInPandas(run, "h long, n long")
    found = each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, int(share * rows))).select("h").collect()
    return np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))


def equal_sets(ids: np.ndarray, n: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns sorted by digest, and for each row the smallest id of its digest; its own for the empty set."""
    order = np.lexsort((ids, d2, d1))
    ids, n, d1, d2 = ids[order], n[order], d1[order], d2[order]
    at = starts_of(d1, d2)
    return ids, n, d1, d2, np.where(n > 0, np.repeat(ids[at], np.diff(np.r_[at, len(ids)])), ids) if len(ids) else ids


def packed(docs: DataFrame, ranges: int, last: np.ndarray) -> DataFrame:
    """Rows (r, bytes): of a range of hashes r, the low 32 bits of shingles and their documents; of documents, n and digest.

    From r = ranges on, rows for the buckets of documents: what need not pass through a range. last: sorted hashes of frequent shingles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(dtype=np.int64), [t if isinstance(t, str) else "" for t in b["text"]]
            for part in in_parts(texts, max(3_000_000, 400 * ranges)):
                doc, h = shingle_sets(texts[part])
                mine = ids[part]
                n = np.bincount(doc, minlength=len(mine))
                d1, d2 = np.zeros(len(mine), dtype=np.uint64), np.zeros(len(mine), dtype=np.uint64)
                if len(h):
                    at = starts_of(doc)
                    d1[doc[at]] = np.add.reduceat(mixed(h + np.uint64(1)), at)
                    d2[doc[at]] = np.add.reduceat(mixed(h ^ np.uint64(P1)), at)
                i, n_, one, two, rep = equal_sets(mine, n, d1, d2)
                rep = met_before(seen, i, n_, one, two, rep)
                whole = (rep == i) & (n_ > 0)
                rows = dealt((one[whole] % np.uint64(ranges)).astype(np.int64), ranges, dict(zip(DOCS, (i[whole], n_[whole], one[whole], two[whole]))))
                back = dealt(bucket(i[~whole], ranges), ranges, {"x_b_id": i[~whole], "x_b_n": n_[~whole], "x_rep": rep[~whole]})
                keep = np.isin(mine, i[whole])[doc] & (n[doc] > 0)
                doc, h = doc[keep], h[keep]
                r = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
                if len(last):
                    hot = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                    gram = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) | (r << 32)
                    for k, v in dealt(bucket(mine[doc[hot]], ranges), ranges, {"x_e_id": mine[doc[hot]], "x_gram": gram[hot], "x_df": np.full(int(hot.sum()), LAST, dtype=np.int32)}).items():
                        back.setdefault(k, {}).update(v)
                    doc, h, r = doc[~hot], h[~hot], r[~hot]
                order = np.argsort(r.astype(np.uint16) if ranges < 1 << 16 else r, kind="stable")
                r, low, owner = r[order], h[order].astype(np.uint32), doc[order]
                runs = starts_of(r, owner)
                times = np.diff(np.r_[runs, len(r)]).astype(np.uint32) if len(r) else np.zeros(0, dtype=np.uint32)
                cuts, ends = np.searchsorted(r, np.arange(ranges + 1)), np.searchsorted(r[runs], np.arange(ranges + 1))
                whose = mine[owner[runs]]
                for k in range(ranges):
                    if cuts[k] < cuts[k + 1]:
                        e = slice(ends[k], ends[k + 1])
                        rows.setdefault(k, {}).update(low=low[cuts[k] : cuts[k + 1]].tobytes(), of=whose[e].tobytes(), times=times[e].tobytes())
                rows |= {ranges + k: v for k, v in back.items()}
                yield pd.DataFrame([{"r": k, **dict.fromkeys((*ELEMENTS, *DOCS, *DIRECT)), **v} for k, v in rows.items()], columns=["r", *ELEMENTS, *DOCS, *DIRECT])

    return common.in_batches(docs).mapInPandas(run, f"r long, {binary((*ELEMENTS, *DOCS, *DIRECT))}")


def met_before(seen: dict[tuple[int, int], int], ids: np.ndarray, n: np.ndarray, d1: np.ndarray, d2: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """rep of a batch, as equal_sets gives it, where a smaller id of the same digest that the task met before stands for its copies; seen learns the batch's digests.

    So a text that many have leaves one entry a task in its range, and not one a batch. An id below the remembered one stands for itself and is remembered
    instead, which keeps the smallest id of a class among those that reach the range.
    """
    first = np.flatnonzero((rep == ids) & (n > 0))
    stands = ids[first].copy()
    for k, (key, i) in enumerate(zip(zip(d1[first].tolist(), d2[first].tolist()), stands.tolist())):
        known = seen.get(key)
        if known is not None and known < i:
            stands[k] = known
        elif known is not None or len(seen) < REMEMBERED:
            seen[key] = i
    out, mine = rep.copy(), n > 0
    out[mine] = np.repeat(stands, np.diff(np.r_[np.searchsorted(np.flatnonzero(mine), first), mine.sum()]))
    return out


def counted(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows (b, bytes), dealt by document: shingles of two documents or more with their frequency; n and class of documents."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= ranges:
            return pd.DataFrame([{"b": key[0] - ranges, **{c: b"".join(v for v in b[f"x_{c}"] if v is not None) for c in BACK}}], columns=["b", *BACK])
        low, of = joined(b["low"], np.uint32), np.repeat(joined(b["of"], np.int64), joined(b["times"], np.uint32))
        order = np.argsort(low, kind="quicksort")
        low, of = low[order], of[order]
        at = starts_of(low)
        df = np.repeat(np.diff(np.r_[at, len(low)]), np.diff(np.r_[at, len(low)])) if len(low) else np.zeros(0, dtype=np.int64)
        keep = df > 1
        low, of, df = low[keep], of[keep], df[keep]
        ids, n, _, _, rep = equal_sets(*(joined(b[c], kind) for c, kind in DOCS.items()))
        out = dealt(bucket(of, ranges), ranges, {"e_id": of, "gram": low.astype(np.int64) | np.int64(int(key[0]) << 32), "df": np.minimum(df, LAST - 1).astype(np.int32)})
        for k, v in dealt(bucket(ids, ranges), ranges, {"b_id": ids, "b_n": n, "rep": rep}).items():
            out.setdefault(k, {}).update(v)
        return pd.DataFrame([{"b": k, **dict.fromkeys(BACK), **v} for k, v in out.items()], columns=["b", *BACK])

    return rows.groupBy("r").applyInPandas(run, f"b long, {binary(BACK)}")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, u, rep, grams): of each document its size, how many of its shingles no other has, its class and, of a class's
    representative, the shingles of its prefix that others have too, rare first: they come after the u others in the order."""

    def run(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        e, gram, df, ids, n, rep = (joined(b[c], kind) for c, kind in BACK.items())
        order = np.argsort(ids, kind="stable")
        ids, n, rep = ids[order], n[order], rep[order]
        at = np.searchsorted(ids, e)
        order = np.lexsort((gram, df, at))
        at, gram = at[order], gram[order]
        count = np.bincount(at, minlength=len(ids))
        place = np.arange(len(at)) - (np.cumsum(count) - count)[at] + np.maximum(n - count, 0)[at]
        keep = (place < (n - -(-n * percent // 100) + 1)[at]) & (rep == ids)[at]
        at, gram, place = at[keep], gram[keep], place[keep]
        cuts = np.searchsorted(at, np.arange(len(ids) + 1))
        return pd.DataFrame({"doc_id": ids, "n": n, "u": np.maximum(n - count, 0), "rep": rep, "grams": [gram[cuts[i] : cuts[i + 1]] for i in range(len(ids))]})

    return rows.groupBy("b").applyInPandas(run, "doc_id long, n long, u long, rep long, grams array<long>")


def suffix_bound(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Whether sorted arrays can share `need` values: halves on either side of a probe can share no more than the shorter."""
    if min(len(x), len(y)) < need:
        return False
    if depth == 0 or not len(y):
        return True
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    hit = at < len(x) and x[at] == y[mid]
    below, above = min(at, mid), min(len(x) - at - hit, len(y) - mid - 1)
    if below + hit + above < need:
        return False
    return suffix_bound(x[:at], y[:mid], need - hit - above, depth - 1) and suffix_bound(x[at + hit :], y[mid + 1 :], need - hit - below, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x & y| >= percent |x | y|, for sorted arrays of distinct hashes."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if not suffix_bound(x, y, need):
        return False
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum()) >= need


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(p["x"], p["y"])]
            yield p.loc[ok, ["a", "b"]]

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return common.in_batches(full.select("a", "b", "x", "y")).mapInPandas(run, "a long, b long")


def need(percent: int) -> str:
    """How many shingles a pair has to share."""
    return f"(({percent} * (n1 + n2) + {99 + percent}) div {100 + percent})"


def bounds(percent: int) -> str:
    """Condition on a pair at the first prefix shingle that it shares, of ranks r1 and r2 among those that are not unique.

    Length; and position: of either document, what comes before that shingle matches nothing, and the rest has to suffice.
    """
    rest = " and ".join(f"n{i} - u{i} - r{i} >= {need(percent)}" for i in (1, 2))
    return f"100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {rest}"


def text_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): the sorted shingle hashes of the documents in ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(dtype=np.int64), [t if isinstance(t, str) else "" for t in b["text"]]
            for part in in_parts(texts):
                doc, h = shingle_sets(texts[part])
                cuts = np.searchsorted(doc, np.arange(len(ids[part]) + 1))
                yield pd.DataFrame({"id": ids[part], "set": [h[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(ids[part]))]})

    mine = docs.join(ids.select(F.col("d").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return common.in_batches(mine).mapInPandas(run, "id long, set binary")


def links_of(found: DataFrame, docs: DataFrame, percent: int, rounds: int, pivots: int, enough: int) -> DataFrame | None:
    """(id, label) of the classes that links join, or None without candidates."""
    grams = found.where(F.size("grams") > 0).select(F.col("doc_id").alias("d"), "n", "u", F.posexplode("grams").alias("r", "gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    grams = common.checkpointed(grams.join(shared, "gram"))
    if grams.isEmpty():
        return None
    sets = common.checkpointed(text_sets(docs, grams))
    done = labels = None
    for k in range(rounds + 1):
        open_ = grams.withColumn("label", F.col("d"))
        if labels is not None:
            open_ = grams.join(labels.select(F.col("id").alias("d"), F.col("label").alias("l")), "d", "left").withColumn("label", F.coalesce("l", "d")).drop("l")
            # groups that links have not joined into one class
            mixed_ = open_.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
            open_ = common.checkpointed(open_.join(mixed_, "gram"))
        by_label = open_.groupBy("gram", "label").agg(F.count("*").cast("double").alias("c")).groupBy("gram").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
        left = by_label.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        if left == 0:
            break
        last = left <= enough or k == rounds
        close = F.expr(bounds(percent))
        if last:
            pairs = paired(open_, close, percent)
        else:
            one, two = sides(open_)
            turn = F.xxhash64("d1", F.lit(k))
            # as many salts as leave both steps equally few rows of a shingle: c / salts, then salts * pivots
            some = one.withColumn("salt", F.pmod(F.xxhash64("d1"), F.ceil(F.sqrt(F.col("c1") / pivots))))
            for keys in (("g1", "salt"), ("g1",)):
                some = some.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(turn, "d1"))).where(F.col("turn") <= pivots)
            # pivots go to every piece of their shingle's rows, so none of its tasks grows with its count
            pieces = lambda c: F.ceil(F.col(c) / (8 * pivots)).cast("int")
            some = some.drop("turn", "salt").withColumn("at", F.explode(F.sequence(F.lit(0), pieces("c1") - 1)))
            two = two.withColumn("piece", F.pmod(F.xxhash64("d2"), pieces("c2")).cast("int"))
            pairs = two.join(some, F.expr("g1 = g2 and piece = at and d1 <> d2 and l1 <> l2") & close)
        pairs = pairs.select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = common.checkpointed(pairs, *([open_] if labels is not None else []))
        new = common.checkpointed(verified(pairs, sets, percent))
        done = pairs if done is None else done.union(pairs)
        labels = components(new, labels)
        if last:
            break
    return labels


def sides(rows: DataFrame) -> list[DataFrame]:
    """rows twice, with columns named g1, d1, n1, u1, r1, l1 and so on."""
    names = [c for c in ("d", "n", "u", "r", "label", "band", "c") if c in rows.columns]
    return [rows.select(F.col("gram").alias(f"g{i}"), *[F.col(c).alias(f"{c[0]}{i}") for c in names]) for i in (1, 2)]


def paired(rows: DataFrame, close: Column, percent: int) -> DataFrame:
    """All pairs of a shingle's rows whose lengths are near; a frequent shingle's rows are dealt in pieces, each against all rows.

    Lengths of a pair differ by a factor of at most 100 / percent, the width of a band, so only neighbouring bands meet.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent * 1.0001))) if percent < 100 else F.col("n")
    pieces = lambda c: F.ceil(F.col(c) / PIECE).cast("int")  # noqa: E731  c: rows of the shingle, of any length
    one, two = sides(rows.withColumn("band", band.cast("long")))
    one = one.withColumn("piece", F.pmod(F.xxhash64("d1"), pieces("c1")).cast("int"))
    two = two.withColumn("at", F.explode(F.expr("array(b2 - 1, b2, b2 + 1)"))).withColumn("part", F.explode(F.sequence(F.lit(0), pieces("c2") - 1)))
    return one.join(two, F.expr("g1 = g2 and b1 = at and piece = part and d1 < d2 and l1 <> l2") & close)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row per key, named doc_id; and, where doc_ids repeat, (key, doc, times): the doc_id and number of equal rows of a key.

    The key is the doc_id. Further texts of a repeated doc_id get keys from a hash, drawn anew until they differ from all others.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = common.checkpointed(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs, None
    more = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    order = Window.partitionBy("doc_id").orderBy(F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull())
    more = common.checkpointed(more.withColumn("turn", F.row_number().over(order)))
    ids, seed = docs.select("doc_id").distinct(), 0
    while True:
        key = F.when(F.col("turn") == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "turn", F.lit(seed)))
        given = common.checkpointed(more.select("doc_id", "text", "times", key.alias("key"), "turn"))
        taken = given.where("turn > 1").select(F.col("key").alias("doc_id")).join(ids, "doc_id", "left_semi")
        if taken.isEmpty() and given.groupBy("key").count().where("count > 1").isEmpty():
            break
        seed += 1
    texts = docs.join(again, "doc_id", "left_anti").unionByName(given.select(F.col("key").alias("doc_id"), "text"))
    return texts, given.select("key", F.col("doc_id").alias("doc"), "times")


def nameless(docs: DataFrame) -> DataFrame:
    """Rows of the result for rows without doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for part in in_parts(texts):
                yield pd.DataFrame({"n_shingles": np.bincount(shingle_sets(texts[part])[0], minlength=len(texts[part]))})

    sizes = common.in_batches(docs.where(F.col("doc_id").isNull()).select("text")).mapInPandas(run, "n_shingles long")
    return sizes.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))


def join_classes(docs: DataFrame, percent: int = 80, rounds: int = 3, pivots: int = 32, enough: int = 20_000, ranges: int | None = None, sample: int | None = None, share: float | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id: the smallest doc_id that links reach, itself included.

    rounds, pivots and enough say how long and how many pivots are tried before all pairs that are still open are formed; they lose no link.
    ranges: into how many ranges hashes and documents are dealt; unless given, twice the partitions of the shuffle or of docs, whichever are more,
    so that what a task holds does not grow with the corpus. sample, share: see frequent(); where they are not given, as sample_of() says.
    """
    ranges = ranges or 2 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    texts, names = keyed(docs)
    rows, least = (sample, 40 / sample) if sample else sample_of(texts)
    last = frequent(texts, rows, share or least)
    found = common.checkpointed(prefixes(counted(packed(texts, ranges, last), ranges), percent))
    labels = links_of(found.where("rep = doc_id"), texts, percent, rounds, pivots, enough)
    # the document that stands for a class within a task does so until here; it may itself have another one
    moved = found.where("rep <> doc_id").select(F.col("doc_id").alias("rep"), F.col("rep").alias("top"))
    out = found.select("doc_id", "n", "rep").join(moved, "rep", "left").select("doc_id", "n", F.coalesce("top", "rep").alias("id"))
    out = out.withColumn("label", F.col("id")) if labels is None else out.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    if names is not None:
        out = named(common.checkpointed(out), names)
    return out.unionByName(nameless(docs))


def named(out: DataFrame, names: DataFrame) -> DataFrame:
    """The result for keys as that for rows: keys of one doc_id are linked, and the smallest doc_id of a class names it."""
    mine = out.withColumnRenamed("doc_id", "key").join(names, "key", "left").withColumn("doc", F.coalesce("doc", "key")).withColumn("times", F.coalesce("times", F.lit(1)))
    mine = common.checkpointed(mine)
    # a doc_id of several classes joins them; each class has a label that is one of its keys
    hub = mine.groupBy("doc").agg(F.min("component_id").alias("b"))
    joins = mine.join(hub, "doc").where("component_id <> b").select(F.col("component_id").alias("a"), "b")
    merged = components(joins)
    mine = mine.join(merged.withColumnRenamed("label", "l"), mine["component_id"] == merged["id"], "left").withColumn("component_id", F.coalesce("l", "component_id"))
    first = mine.groupBy("component_id").agg(F.min("doc").alias("first"))
    mine = mine.join(first, "component_id")
    return mine.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy")).drop("copy")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
