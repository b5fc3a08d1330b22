"""Secrets in texts: fixed patterns, and credential-context values that are hard to guess.

A value after a credential word is priced by the cheapest way to guess it: dynamic programming over its prefixes takes the
minimum, over words of a ranked list, dates, repeats, keyboard walks and brute-force spans, of the product of their guesses.
Values of at least `min_log10` guesses become spans of kind `guess`; the pattern spans stay whatever they cost.

Null and empty texts have no spans. Texts and values of any length are read whole; pricing a value ends once no way to guess it can
be cheaper than the limit. Repeated rows are separate rows, an empty table gives an empty one, and of the input only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The look-behind keeps a run shorter than 24 from being tried again from each of its characters.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Wider contexts than ASSIGN: more names, and values in quotes with any printable characters, of any length.
CONTEXT = re.compile(
    r"""(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|bearer|credentials?))"""
    r"""["']?(?:\x20*+(?::=|=>|[:=])\x20*+|\x20is\x20)(?:"([^"\s]{6,}+)"|'([^'\s]{6,}+)'|([^\s"',;()<>]{6,}+))"""
)
#: Keyboard rows, for walks along a row in either direction.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4301$5!7", "aaeoissit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
LONGEST_DATE = 10


@lru_cache(maxsize=2)
def ranked_words(path: str) -> dict[str, int]:
    """Whole words of three or more letters in a word BPE vocabulary file; the order of its merges is their rank."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and len(w) > 6 and w[:-4].isascii() and w[:-4].isalpha())
    return {w: k + 1 for k, (_, w) in enumerate(whole)}


def alphabet(s: str) -> int:
    """Size of the union of the character classes in s."""
    return (
        10 * any("0" <= c <= "9" for c in s) + 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s)
        + 33 * any(c.isascii() and not c.isalnum() for c in s) + 100 * any(not c.isascii() for c in s)
    ) or 1


#: Pairs of neighbouring keys, with the rows and directions that they go in.
STEPS: dict[str, set[str]] = {}
for _row in (*ROWS, *(x[::-1] for x in ROWS)):
    for _pair in zip(_row, _row[1:]):
        STEPS.setdefault("".join(_pair), set()).add(_row)


def walk_end(low: str, i: int) -> int:
    """Where the longest keyboard walk in one row and direction from a place ends."""
    ways, j = STEPS.get(low[i : i + 2]), i + 2
    if not ways:
        return i + 1
    while j < len(low) and (ways := ways & STEPS.get(low[j - 1 : j + 1], set())):
        j += 1
    return j


class Repeats:
    """The cheapest repeat that ends at a place, of those that start at places of one run of a character.

    A start costs its own cost and the log of the length. Of two starts the later one is cheaper first, then the earlier one for
    good, from a place that can be told; so a stack of starts, with the places where each gives way to the one below, is enough.
    """

    def __init__(self):
        self.starts: list[tuple[int, float, float]] = []  # start, its cost, place where the one below becomes cheaper

    def add(self, i: int, cost: float) -> None:
        while self.starts:
            j, below, until = self.starts[-1]
            if cost <= below:
                self.starts.pop()
                continue
            more = 10 ** min(cost - below, 300.0)
            gives_way = (more * i - j) / (more - 1) if more > 1 else math.inf
            if gives_way < until:
                break
            self.starts.pop()
        else:
            gives_way = math.inf
        self.starts.append((i, cost, gives_way))

    def best(self, j: int) -> float:
        while len(self.starts) > 1 and self.starts[-1][2] <= j:
            self.starts.pop()
        return self.starts[-1][1] + math.log10(j - self.starts[-1][0]) if self.starts else math.inf


def log10_guesses(s: str, ranks: dict[str, int], enough: float = math.inf, longest: int | None = None) -> float:
    """Smallest cost, in log10 guesses, of any segmentation of s; or, once none can cost less than `enough`, that.

    A word costs its rank (twice with capitals, twice with look-alike characters); a date 365 * 119 or its year 119; a repeat of three
    or more alphabet * length; a walk of three or more 4 * 47 * length; brute force alphabet ** length. Each further span of a
    segmentation costs a factor 2, for guessing where spans end. longest: length of the longest word in ranks.

    From each place, words, dates and walks reach a few places on; brute force and repeats are carried along. So time is linear.
    """
    n = len(s)
    if not n:
        return 0.0
    log = math.log10
    char, join = log(alphabet(s)), log(2)
    low = s.lower()
    plain = low.translate(LEET)
    if len(low) != n:  # a letter whose lower case has more letters
        low = plain = s
    if longest is None:
        longest = max(map(len, ranks), default=0)
    reach = max(longest, LONGEST_DATE, max(map(len, ROWS)))
    best, brute, repeats, run, cheap = [math.inf] * (n + 1), math.inf, Repeats(), 0, 0
    best[0] = -join
    for i in range(n + 1):
        if i:
            brute = min(best[i - 1] + join, brute) + char
            if i > 1 and s[i - 1] != s[i - 2]:
                repeats, run = Repeats(), i - 1
            if i - 3 >= run:
                repeats.add(i - 3, best[i - 3])
            best[i] = min(best[i], brute, repeats.best(i) + join + char)
            if best[i] < enough or brute < enough:
                cheap = i
            elif i - cheap > reach:
                return enough
        here = best[i] + join
        for j in range(i + 3, min(n, i + longest) + 1):
            cost = -1.0
            if (r := ranks.get(low[i:j])) is not None:
                cost = log(r + 1)
            if (r := ranks.get(plain[i:j])) is not None and (cost < 0 or log(r + 1) + join < cost):
                cost = log(r + 1) + join
            if cost >= 0:
                best[j] = min(best[j], here + cost + (join if s[i:j] != low[i:j] else 0.0))
        if i < n and "0" <= s[i] <= "9":
            for j in range(i + 4, min(n, i + LONGEST_DATE) + 1):
                if DATE.fullmatch(s, i, j):
                    best[j] = min(best[j], here + (log(119) if j - i == 4 else log(365 * 119)))
        for j in range(i + 3, walk_end(low, i) + 1):
            best[j] = min(best[j], here + log(4 * 47 * (j - i)))
    return best[n]


def scan(text: str, ranks: dict[str, int], min_log10: float, longest: int | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Pattern spans and added spans of one text. longest: length of the longest word in ranks."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    added = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        if log10_guesses(m[k], ranks, min_log10, longest) >= min_log10:
            added.append(("guess", *m.span(k)))
    return base, added


def scan_secrets(docs: DataFrame, words_path: str | None = None, min_log10: float = 8.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess and redacted_chars of each row of (doc_id, text).

    redacted_chars: characters under any span, each counted once. words_path: the ranked word list, on every machine.
    """
    if words_path is None:
        import public_tokenizers

        words_path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = ranked_words(words_path)
        longest = max(map(len, ranks), default=0)
        for b in batches:
            rows = []
            for text in b["text"]:
                base, added = scan(text if isinstance(text, str) else "", ranks, min_log10, longest)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                end = under = 0
                for _, s, e in sorted(base + added, key=lambda x: x[1:]):
                    under += max(0, e - max(s, end))
                    end = max(end, e)
                rows.append((*n, common.digest(base, KINDS)[1], common.digest(base + added, KINDS)[0], len(added), under))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "redacted_chars"])], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_batches(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, redacted_chars long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"))
