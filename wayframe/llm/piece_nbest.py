"""SentencePiece encoding with n-best segmentations, and decoding.

The lattice of a text has an edge for each vocabulary piece it holds, and byte pieces for characters without one. Forward Viterbi
scores are the exact cost of the best way to each place, so backward A-star search with them as heuristic never leaves the
n best paths: popped nodes follow their best edge at once, and only its siblings wait in the heap.

No piece reaches over the start of a run of blanks, over a line feed or from marks to other characters or back (checked when a
vocabulary is loaded), so a lattice falls apart into units there: units are solved once and remembered, and the n best of a text
take their changes from the units that lose least.

Scores are those stored in the file; those of a BPE vocabulary are ranks of merges and no log probabilities, so there `zipf` may be
wanted, which takes ln P of a piece of rank r as -ln(r + 1). Scores are kept as integers of a millionth, so sums and ties are exact.
Of equal ways to a place the longest last piece wins. The best segmentation is whole; the others come as what they change in it,
which is a few pieces, and `segmentation` makes them whole again.

Null and empty texts have no pieces, one segmentation and score 0. Repeated rows are separate rows, an empty table gives an empty
one. Texts have no largest length: time is linear in it, and about a million characters of units are in work at once, or one unit.
Input columns named as result columns are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANK = "▁"
UNIT = 1_000_000
#: Units of text that a worker remembers; the memory is emptied beyond that.
REMEMBERED = 200_000

Edge = tuple[int, int, tuple[int, ...]]  # best score of a path that ends with it, start, ids
#: Below any score, and above any loss.
FAR = 1 << 62
#: Units of up to so many characters are solved together.
SHORT = 64


def arrays_of(trie: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A trie as arrays: sorted keys (node, character) and the nodes they lead to; by node its piece or -1, its score and its depth. Node 0 is the root."""
    steps, piece, score, depth, todo = [], [-1], [0], [0], [(0, trie)]
    for at, kids in todo:  # grows as it goes
        for c, (more, ids, value) in kids.items():
            steps.append((at << 21 | ord(c), len(piece)))
            todo.append((len(piece), more))
            piece.append(-1 if ids is None else ids[0])
            score.append(value)
            depth.append(depth[at] + 1)
    key, to = (np.array(x, dtype=np.int64) for x in zip(*sorted(steps)))
    return key, to, *(np.array(x, dtype=np.int64) for x in (piece, score, depth))


class Pieces:
    """A vocabulary as a trie of characters; a node is (children, ids, score) with ids None where no piece ends."""

    def __init__(self, path: str, scores: str = "stored"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(len(self.text)) if model.is_byte(i)}
        plain = [i for i in range(len(self.text)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        stored = {i: model.get_score(i) for i in plain}
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-stored[i], i)), 1)}
        self.score = {i: round(UNIT * (-math.log(rank[i] + 1) if scores == "zipf" else stored[i])) for i in plain}
        self.trie: dict = {}
        for i in sorted(plain, key=lambda i: self.text[i]):  # a prefix comes before what it begins
            node = self.trie
            for c in self.text[i][:-1]:
                node = node.setdefault(c, ({}, None, 0))[0]
            node[self.text[i][-1]] = ({}, (i,), self.score[i])
        self.key, self.to, self.piece, self.worth, depth = arrays_of(self.trie)
        self.deepest = int(depth.max())
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.lost = min(self.score.values()) - 10 * UNIT  # of each byte piece
        marks = self.marks([self.text[i].lstrip(BLANK) for i in plain])
        unit = re.compile(f"\n|{BLANK}*(?:[{marks}]+|[^{BLANK}\n{marks}]+)|{BLANK}+")
        apart = all(unit.fullmatch(self.text[i]) and self.text[i] != "\n" for i in plain)
        self.units = (unit if apart else re.compile("(?s:.+)")).findall
        self.forget()

    def forget(self) -> None:
        """Start the memory of units: a number for each, and by number its place and count in one array of ids, score, loss and whether it decodes."""
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(0, dtype="<i4")
        self.start, self.count, self.score_of, self.loss_of, self.ok = (np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, np.int64, np.int64, bool))
        self.ways: dict[tuple[str, int], list] = {}

    @staticmethod
    def marks(cores: list[str]) -> str:
        """A character class: ASCII marks, and what else some piece joins with marks, unless it is a letter or decimal digit."""
        found = set(string.punctuation)
        while more := {c for core in cores if not found.isdisjoint(core) for c in core if c not in found and c != BLANK and not c.isalpha() and not c.isdecimal()}:
            found |= more
        return "".join(re.escape(c) for c in sorted(found))

    def lattice(self, s: str) -> tuple[list[int], list[list[Edge]]]:
        """Best score of the ways to each place, and the edges that end there, longest first."""
        n, root = len(s), self.trie
        best = [0] + [-FAR] * n
        ends: list[list[Edge]] = [[] for _ in best]
        for i, c in enumerate(s):
            here, node, j = best[i], root.get(c), i + 1
            if node is None or node[1] is None:
                ids = tuple([self.of_byte[b] for b in c.encode("utf-8", "replace")])
                total = here + len(ids) * self.lost
                ends[j].append((total, i, ids))
                if total > best[j]:
                    best[j] = total
            while node is not None:
                kids, ids, score = node
                if ids is not None:
                    total = here + score
                    ends[j].append((total, i, ids))
                    if total > best[j]:
                        best[j] = total
                if j == n:
                    break
                node = kids.get(s[j])
                j += 1
        return best, ends

    def n_best(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids) of a string of pieces, best first.

        Each node in the heap stands for a path of its cost, so a sibling that n paths are no dearer than never waits.
        """
        best, ends = self.lattice(s)
        heap = [(-best[-1], 0, len(s), 0, None)]  # cost, order of arrival, place, score behind it, ids behind it
        costs = [-best[-1]]  # the n least of all that arrived
        found: list[tuple[int, tuple[int, ...]]] = []
        arrived = 0
        while heap and len(found) < n:
            cost, _, at, behind, ids = heapq.heappop(heap)
            while at:
                follow = None
                for edge in ends[at]:
                    total, start, piece = edge
                    if follow is None and total + behind == -cost:
                        follow = edge
                    elif len(costs) < n or -total - behind < costs[-1]:
                        arrived += 1
                        bisect.insort(costs, -total - behind)
                        del costs[n:]
                        heapq.heappush(heap, (-total - behind, arrived, start, behind + total - best[start], (piece, ids)))
                total, start, piece = follow
                at, behind, ids = start, behind + total - best[start], (piece, ids)
            path: list[int] = []
            while ids is not None:
                path += ids[0]
                ids = ids[1]
            found.append((-cost, tuple(path)))
        return found

    def unit(self, s: str) -> tuple[tuple[int, ...], int, int]:
        """Ids and score of the best way through a unit, and what the second best loses, FAR without one.

        The second best is the first of A-star's waiting siblings once the best path is followed.
        """
        best, ends = self.lattice(s)
        at, behind, second = len(s), 0, -FAR
        back: list[tuple[int, ...]] = []
        while at:
            aim, follow = best[at], None
            edges = ends[at]
            if len(edges) == 1:
                follow = edges[0]
            else:
                for edge in edges:
                    if edge[0] == aim and follow is None:
                        follow = edge
                    elif edge[0] + behind > second:
                        second = edge[0] + behind
            at = follow[1]
            behind += aim - best[at]
            back.append(follow[2])
        back.reverse()
        return tuple(chain.from_iterable(back)), behind, behind - second if second > -FAR else FAR

    def child(self, node: np.ndarray | int, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to from nodes; 0 where there is none."""
        key = np.int64(node) << 21 | char if isinstance(node, int) else node << 21 | char
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], 0)

    def together(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units of up to SHORT characters: places of those that hold a character without a piece, and of the others, in order,
        what unit() gives: count of ids, all ids, score and loss.

        All units go through their places together: first along the trie, then forward from place to place, then back.
        """
        char = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        size = np.array(list(map(len, units)), dtype=np.int64)
        owner = np.repeat(np.arange(len(units)), size)
        known, which = np.unique(char, return_inverse=True)
        node = self.child(0, known)[which]
        if (strange := self.piece[node] < 0).any():
            bad = np.zeros(len(units), dtype=bool)
            bad[owner[strange]] = True
            return np.flatnonzero(bad).tolist(), *self.together([u for u, b in zip(units, bad.tolist()) if not b])[1:]
        first = np.cumsum(size) - size
        end = (first + size)[owner]
        live, starts, nodes, length = np.arange(len(char)), [], [], 1
        while len(live):
            whole = self.piece[node] >= 0
            starts.append(live[whole])
            nodes.append(node[whole])
            more = live + length < end[live]
            live, node = live[more], node[more]
            node = self.child(node, char[live + length])
            live, node = live[node > 0], node[node > 0]
            length += 1
        held = np.repeat(np.arange(1, len(starts) + 1), [len(x) for x in starts])
        start, node = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (starts, nodes))
        # edges by the place in the unit where they end, longest first: of one place and length each unit has one at most
        turn = (start - first[owner[start]] + held) * (self.deepest + 1) + self.deepest - held
        order = np.argsort(turn.astype(np.uint16) if (SHORT + 1) * (self.deepest + 1) < 1 << 16 else turn, kind="stable")
        turn, held, node = turn[order], held[order], node[order]
        come = start[order] + owner[start[order]]  # a unit has a place more than characters
        go = come + held
        worth, cuts = self.worth[node], np.r_[np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]), len(turn)] if len(turn) else np.zeros(1, dtype=np.int64)
        best, second, back = np.full(len(char) + len(units), -FAR), np.full(len(char) + len(units), -FAR), np.zeros(len(char) + len(units), dtype=np.int64)
        zero = first + np.arange(len(units))
        best[zero] = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            to = go[a:b]
            total, now = best[come[a:b]] + worth[a:b], best[to]
            up = total > now
            second[to] = np.where(up, now, np.maximum(second[to], total))
            best[to] = np.where(up, total, now)
            back[to] = np.where(up, np.arange(a, b), back[to])
        gap = np.where(second > -FAR, best - second, FAR)
        at, loss, who, path = zero + size, np.full(len(units), FAR), np.arange(len(units)), []
        score = best[at]
        while len(who):
            loss[who] = np.minimum(loss[who], gap[at])
            path.append((who, self.piece[node[back[at]]]))
            at = come[back[at]]
            on = at > zero[who]
            who, at = who[on], at[on]
        count = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *[w for w, _ in path]]), minlength=len(units))
        ids, last = np.zeros(int(count.sum()), dtype="<i4"), np.cumsum(count) - 1
        for k, (w, i) in enumerate(path):
            ids[last[w] - k] = i
        return [], count, ids, score, loss

    def split(self, text: str) -> list[str]:
        return self.units(BLANK + text.replace(" ", BLANK)) if text else []

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of units, which are solved if they are new."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        if new := list(set(units).difference(self.seen)):
            short, long = [u for u in new if len(u) <= SHORT], [u for u in new if len(u) > SHORT]
            strange, count, ids, score, loss = self.together(short)
            for k in reversed(strange):
                long.append(short.pop(k))
            solved = list(map(self.unit, long))
            new = short + long
            count = np.r_[count, np.array([len(x) for x, _, _ in solved], dtype=np.int64)]
            ids = np.r_[ids, np.fromiter(chain.from_iterable(map(itemgetter(0), solved)), dtype="<i4")]
            cuts = np.cumsum(count)
            whole = ids.tolist()
            ok = [self.spelled(whole[b - n : b]) == u for u, b, n in zip(new, cuts.tolist(), count.tolist())]
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.start = np.r_[self.start, len(self.flat) + cuts - count]
            self.count, self.flat, self.ok = np.r_[self.count, count], np.r_[self.flat, ids], np.r_[self.ok, np.array(ok, dtype=bool)]
            self.score_of = np.r_[self.score_of, score, np.array([x for _, x, _ in solved], dtype=np.int64)]
            self.loss_of = np.r_[self.loss_of, loss, np.array([x for _, _, x in solved], dtype=np.int64)]
        return np.fromiter(map(self.seen.__getitem__, units), dtype=np.int64, count=len(units))

    def others(self, unit: str, number: int, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(loss, ids) of the n best ways through a unit but the one that the best segmentation takes, least loss first."""
        if (found := self.ways.get((unit, n))) is None:
            first = tuple(self.flat[self.start[number] : self.start[number] + self.count[number]].tolist())
            found = self.ways[unit, n] = [(int(self.score_of[number]) - s, way) for s, way in self.n_best(unit, n) if way != first]
        return found

    def losses(self, units: list[str], numbers: np.ndarray, n: int) -> list[tuple[int, tuple]]:
        """What the n best segmentations lose against the best, from 0 up, with the (unit, ids) in which they differ from it.

        These are the n least sums of losses of units; only the n - 1 units that lose least can take part.
        """
        sums: list[tuple[int, tuple]] = [(0, ())]
        if n <= 1 or not len(numbers):
            return sums
        each = self.loss_of[numbers]
        most = np.partition(each, n - 2)[n - 2] if len(each) >= n else FAR - 1
        held = np.flatnonzero(each <= min(int(most), FAR - 1))
        for k in held[np.argsort(each[held], kind="stable")][: n - 1].tolist():
            # of equal scores, the way that the best segmentation takes counts as the first
            options = [(0, ()), *[(loss, ((k, way),)) for loss, way in self.others(units[k], int(numbers[k]), n)]][:n]
            sums = heapq.nsmallest(n, ((a + b, p + q) for a, p in sums for b, q in options), key=itemgetter(0))
        return sums

    def bulk(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, int, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]], bool]]:
        """Of each text: ids of the best segmentation, its score, (score, edits) of the n best, and whether the ids decode to it.

        An edit (at, drop, ids) puts ids in place of drop ids of the best segmentation from the place at on.
        """
        split = list(map(self.split, texts))
        units = list(chain.from_iterable(split))
        numbers = self.numbers(units)
        count = self.count[numbers]
        ends = np.cumsum(count)
        flat = self.flat[np.repeat(self.start[numbers] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.cumsum([0, *map(len, split)])
        scores = np.r_[0, np.cumsum(self.score_of[numbers])]
        faults = np.r_[0, np.cumsum(~self.ok[numbers])]
        places = np.r_[0, ends]
        for i, mine in enumerate(split):
            a, b = cuts[i], cuts[i + 1]
            start, total = places[a], int(scores[b] - scores[a])
            ranked = []
            for loss, ways in self.losses(mine, numbers[a:b], n):
                ranked.append((total - loss, [(int(places[a + k] - start), int(count[a + k]), way) for k, way in sorted(ways)]))
            yield flat[start : places[b]], total, ranked, bool(faults[b] == faults[a])

    def encode(self, text: str, n: int = 1) -> tuple[list[int], list[int]]:
        """Ids of the best segmentation of a text, and the scores of its n best ones."""
        ids, _, ranked, _ = next(self.bulk([text], n))
        return ids.tolist(), [score for score, _ in ranked]

    def nbest(self, text: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best (score, ids) of a text, the best first."""
        ids, _, ranked, _ = next(self.bulk([text], n))
        out = []
        for score, edits in ranked:
            way = ids.tolist()
            for at, drop, other in reversed(edits):
                way[at : at + drop] = other
            out.append((score, way))
        return out

    def segmentations(self, text: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best (score, ids) of a whole text."""
        units = self.split(text)
        ways: list[tuple[int, tuple]] = [(0, ())]
        for s in units:
            ways = heapq.nlargest(n, ((a + score, (kept, ids)) for a, kept in ways for score, ids in self.n_best(s, n)), key=lambda x: x[0])
        out = []
        for score, kept in ways:
            path: list[tuple[int, ...]] = []
            while kept:
                path.append(kept[1])
                kept = kept[0]
            out.append((score, [i for p in reversed(path) for i in p]))
        return out

    def spelled(self, ids) -> str:
        """What ids stand for: pieces and bytes in order."""
        text, byte = self.text, self.byte
        if byte.keys().isdisjoint(ids):
            return "".join(map(text.__getitem__, ids))
        return b"".join([bytes((byte[i],)) if i in byte else text[i].encode() for i in ids]).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """Text of ids, blanks as spaces, without the space put before a text."""
        return self.spelled(ids).replace(BLANK, " ")[1:]


@lru_cache(maxsize=2)
def pieces(path: str, scores: str) -> Pieces:
    return Pieces(path, scores)


def vocabulary(path: str | None) -> str:
    """The vocabulary file on every machine; that of the installed public tokenizers unless given."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


EDIT = "array<struct<at: int, drop: int, ids: array<int>>>"
RESULT = {"ids": "array<int>", "n_pieces": "long", "score": "double", "nbest": f"array<struct<score: double, edits: {EDIT}>>", "ids_sha256": "string", "decoded_ok": "boolean"}


def listed(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def encode(docs: DataFrame, n: int = 4, path: str | None = None, scores: str = "stored", keep: tuple[str, ...] = ("doc_id",), size: int = 1_000_000) -> DataFrame:
    """keep, ids (best segmentation), n_pieces, score, nbest, ids_sha256 and decoded_ok of each row; columns of keep named so are replaced.

    nbest: of up to n segmentations, best first, the score and the edits that make it of ids, none for the first; see segmentation().
    ids_sha256: of the ids as little-endian 32-bit integers. decoded_ok: whether the ids decode to the text, in which the
    character that stands for a blank counts as a space.
    """
    file = vocabulary(path)

    def table(model: Pieces, texts: list[str]) -> list[pa.Array]:
        ids, total, ranked, ok = zip(*model.bulk(texts, n))
        ways = list(chain.from_iterable(ranked))
        edits = list(chain.from_iterable(map(itemgetter(1), ways)))
        new = listed([len(x[2]) for x in edits], pa.array(np.fromiter(chain.from_iterable(map(itemgetter(2), edits)), dtype="<i4")))
        at, drop = (pa.array(np.array([x[k] for x in edits], dtype=np.int32)) for k in (0, 1))
        way = pa.StructArray.from_arrays([at, drop, new], ["at", "drop", "ids"])
        way = pa.StructArray.from_arrays([pa.array(np.array([x[0] for x in ways], dtype=np.float64) / UNIT), listed([len(x[1]) for x in ways], way)], ["score", "edits"])
        pieces = list(map(len, ids))
        return [
            listed(pieces, pa.array(np.concatenate(ids))), pa.array(pieces, pa.int64()), pa.array(np.array(total, dtype=np.float64) / UNIT), listed([len(x) for x in ranked], way),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array(ok),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(file, scores)
        for b in batches:
            texts, kept, start, held = [t or "" for t in b.column("__text").to_pylist()], b.drop_columns(["__text"]), 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= size or i == len(texts) - 1:  # little is in work at once, however large the batch
                    yield pa.RecordBatch.from_arrays([*kept.slice(start, i + 1 - start).columns, *table(model, texts[start : i + 1])], [*kept.schema.names, *RESULT])
                    start, held = i + 1, 0

    kept = [c for c in keep if c.lower() not in RESULT]
    d = common.in_batches(docs.select(*kept, F.col("text").alias("__text")))
    schema = [f"`{c}` {kind}" for c, kind in d.drop("__text").dtypes]
    return d.mapInArrow(run, ", ".join([*schema, *[f"{c} {kind}" for c, kind in RESULT.items()]]))


def segmentation(ids: Column, edits: Column) -> Column:
    """The ids of another segmentation: those of the best one with the edits made."""

    def part(e: Column, i: Column) -> Column:
        before = F.get(edits, i - 1)
        start = F.when(i > 0, before["at"] + before["drop"]).otherwise(0)
        return F.concat(F.slice(ids, start + 1, e["at"] - start), e["ids"])

    last = F.get(edits, F.size(edits) - 1)
    start = F.when(F.size(edits) > 0, last["at"] + last["drop"]).otherwise(0)
    return F.concat(F.flatten(F.transform(edits, part)), F.slice(ids, start + 1, F.size(ids)))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with text: what the array ids decodes to; null for null. A column text of the input is replaced."""
    file = vocabulary(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(file, "stored")
        for b in batches:
            yield b.assign(text=[None if ids is None else model.decode(list(ids)) for ids in b["ids"]])

    kept = common.without(rows, "text")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes)
    return common.in_batches(kept).mapInPandas(run, f"{schema}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best segmentation, and the others of its four best as edits of that."""
    return encode(common.table(spark, sf_dir, "documents"))
