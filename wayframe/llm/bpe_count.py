"""Exact token counts of a byte-level BPE vocabulary, by rank-synchronous merging in numpy.

Pre-tokens of a batch lie one after another in one array of symbols. Each round finds, for every pre-token at once, the pair of
lowest rank and merges all its places in that pre-token, left to right; a pre-token without a known pair is done, and its
surviving symbols are its tokens. Null and empty texts have no tokens, and long ones are taken whole, about a million characters or one text at a time.
Repeated rows give repeated results, an empty table an empty one, there are no ties, and only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

RESULT = ("n_bytes", "n_tokens", "over_limit")
#: Fixed value: the pre-token pattern of this vocabulary; \s is spelt out as the Unicode White_Space property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pre-tokens that a worker remembers; the memory is emptied beyond that.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Counter:
    """Counts tokens of texts with the vocabulary of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.first = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.found = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.seen: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merged_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        n = np.array([len(t) for t in tokens], dtype=np.int64)
        counts = n.copy()
        sym = self.first[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), n)
        none = len(self.keys)
        rank = None
        while len(sym):
            if rank is None:
                rank = np.full(len(sym), none, dtype=np.int64)
                rank[:-1] = np.where(seq[:-1] == seq[1:], self.rank(sym[:-1], sym[1:]), none)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            counts[seq[starts]] = size
            alive = np.repeat(best < none, size)
            if not alive.all():
                sym, seq, rank = sym[alive], seq[alive], rank[alive]
                best, size = best[best < none], size[best < none]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, size)
            # in a run of overlapping places, as in "aaa", every other one is taken, from the left
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new = np.zeros(len(sym), dtype=bool)
            new[at] = True
            sym, seq, rank, new = sym[keep], seq[keep], rank[keep], new[keep]
            # ranks change only beside a new symbol
            touch = np.flatnonzero(new | np.r_[new[1:], False])
            inner = touch[touch < len(sym) - 1]
            rank[touch] = none
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        return counts

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special tokens in it."""
        if self.special is None or not (parts := self.special.split(text))[1:]:
            return self.found(text), 0
        return [t for p in parts for t in self.found(p)], len(parts) - 1

    def __call__(self, texts: list[str | None], bulk: int = 1_000_000) -> list[int]:
        """Tokens of each text; about `bulk` characters are held as pre-tokens at once."""
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(self.split(text or ""))
            size += len(text or "")
            if size >= bulk or i == len(texts) - 1:
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                seen = self.seen
                if new := list({t for ts, _ in held for t in ts if t not in seen}):
                    seen.update(zip(new, self.merged_counts([t.encode("utf-8", "replace") for t in new]).tolist()))
                out += [sum(map(seen.__getitem__, ts)) + more for ts, more in held]
                held, size = [], 0
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of (doc_id, text). path: the vocabulary file, on every machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            n = np.array(count(texts), dtype=np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": np.array([len(t.encode("utf-8", "replace")) for t in texts], dtype=np.int64), "n_tokens": n, "over_limit": n > limit})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_batches(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
