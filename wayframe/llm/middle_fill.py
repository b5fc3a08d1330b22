"""Fill-in-middle examples: a text is cut at two unit boundaries and its parts change places behind markers.

Units are words with the white space before them, trailing white space being one of its own (`units="words"`), or characters. The ends of a
text's units form a set of offsets, kept as a roaring set does: by the high bits of the offset in containers of 2^16, each a sorted array,
a bitmap or a list of runs, whichever is smallest, with the number of members before each container. Looking for the k-th boundary is a
search among these numbers, then a selection in one container, so both cuts cost little however long the text is.

Null texts count as empty, and an empty text is plain. A null doc_id is cut as the seed alone says. Texts of any length are taken whole; a
batch holds some megabytes or one text. Rows are independent: repeated rows give repeated results, an empty table an empty one. There are
no ties to break. Of the input only doc_id, text and the columns named in keep are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARKS = ("<P>", "<S>", "<M>")
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
CONTAINER = 1 << 16
ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"


class Boundaries:
    """A set of offsets below 2^48, in containers of 2^16, with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        """offsets: sorted, each once."""
        high = offsets >> 16
        at = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(offsets) else np.zeros(0, dtype=np.int64)
        self.high = high[at]
        #: members before each container, and the number of all at the end
        self.before = np.r_[at, len(offsets)].astype(np.int64)
        self.containers = [self._container(part) for part in np.split((offsets & (CONTAINER - 1)).astype(np.uint16), at[1:])] if len(offsets) else []

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.r_[True, np.diff(low.astype(np.int32)) != 1])
        if 4 * len(starts) < min(2 * len(low), CONTAINER // 8):
            return RUNS, low[starts], starts
        if 2 * len(low) <= CONTAINER // 8:
            return ARRAY, low
        bits = np.zeros(CONTAINER, dtype=bool)
        bits[low] = True
        words = np.packbits(bits)
        return BITMAP, words, np.r_[0, np.cumsum(np.bitwise_count(words.view(np.uint64)).astype(np.int64))]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        k -= int(self.before[c])
        kind, *data = self.containers[c]
        if kind == ARRAY:
            low = int(data[0][k])
        elif kind == RUNS:
            r = int(np.searchsorted(data[1], k, side="right")) - 1
            low = int(data[0][r]) + k - int(data[1][r])
        else:
            words, before = data
            w = int(np.searchsorted(before, k, side="right")) - 1
            inside = np.flatnonzero(np.unpackbits(words[8 * w : 8 * w + 8]))
            low = 64 * w + int(inside[k - int(before[w])])
        return (int(self.high[c]) << 16) + low


def unit_ends(text: str, units: str = "words") -> np.ndarray:
    """Offsets, in code points, at which the units of a text end."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if units == "chars":
        return np.arange(1, len(cp) + 1)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1 if len(cp) else np.zeros(0, dtype=np.int64)
    return np.r_[ends, len(cp)] if len(cp) and blank[-1] else ends


def cut(text: str, doc_id: object, seed: int = 42, rate: int = 50, spm: int = 80, units: str = "words") -> tuple[int, str, int | None, int | None, str]:
    """RESULT for one text: rate and spm are the percentages of texts that are rearranged, and of these with the suffix first."""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = unit_ends(text, units)
    n = len(ends)
    if not n or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    chosen = Boundaries(ends)
    i, j = (chosen.select(k - 1) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    first, middle, last = text[:i], text[i:j], text[j:]
    if h[3] % 100 < spm:
        return n, "spm", i, j - i, f"<S>{last}<P>{first}<M>{middle}"
    return n, "psm", i, j - i, f"<P>{first}<S>{last}<M>{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, units: str = "words", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the new text."""
    d = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    schema = ", ".join([*[f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "n long, form string, prefix_chars long, middle_chars long, output string"])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [cut(text or "", i, seed, rate, spm, units) for i, text in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist())]
            made = [pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else ([],) * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names=[f"__{i}" for i in range(len(keep))] + list(RESULT))

    out = common.in_batches(d).mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], *RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text of which fill_in_middle made output. Markers never stand in a text that is rearranged, so they split it."""
    def whole(parts: Column) -> Column:
        p, s = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
        return F.concat(p, parts[3], s)

    return F.when(form == "plain", output).otherwise(common.let(F.split(output, "|".join(MARKS), -1), whole))


def op13_middle_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS k,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
h AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(k, 1, 8))::BIGINT AS h1, ('0x' || substr(k, 9, 8))::BIGINT AS h2,
         ('0x' || substr(k, 17, 8))::BIGINT AS h3, ('0x' || substr(k, 25, 8))::BIGINT AS h4
  FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(units[1:i], '') AS a, array_to_string(units[i + 1:j], '') AS m, array_to_string(units[j + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
