"""Remove passages that repeat across documents: overlapping windows of three lines, found by hash over the whole corpus.

Lines are the parts between line feeds that hold a word; others stay where they are and count for nothing. A document of
under three lines has no window of three. With long_words, as an addition to the method, shorter passages have windows too:
one or two lines of together more than so many words, and a whole text of under three lines, with marks of its ends. Of each
repeated window the first occurrence, by (doc_id, place), stays; the lines that the later ones cover go, so overlapping windows
merge into one removed passage.

Null texts stay null, with no lines. Rows of null doc_id sort first, rows of one doc_id are told apart by their text, and equal rows
count as one. An empty table gives an empty one; texts of any length take time in proportion to it; input columns named as result
columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RESULT = ("n_lines", "n_removed")
#: Passages of more words than this are cut however few their lines.
LONG_WORDS = 50
#: Tasks over which the occurrences of one window are dealt.
SALTS = 64


def _hash(*parts: Column) -> list[Column]:
    """Two hashes of 64 bits, of unlike inputs, that stand for the parts; nulls and ends of parts count."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))]


def with_lines(docs: DataFrame) -> DataFrame:
    full = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return docs.withColumn("__lines", F.filter(full, lambda x: x.rlike(common.WORD)))


def covered(docs: DataFrame, size: int = 3, long_words: int | None = None) -> DataFrame:
    """(doc_id, __text_hash, __gone): for each document that loses lines, the sorted places, from 0, among its lines that hold a word."""
    least = size if long_words is None else 1
    d = with_lines(docs).select("doc_id", F.xxhash64("text").alias("__text_hash"), "__lines").where(F.size("__lines") >= least)

    def window(lines: Column, i: Column, n: int) -> Column:
        a, b = _hash(*[F.lit(n)] * (n != size), *[F.get(lines, i + k) for k in range(n)])
        return F.struct(a.alias("a"), b.alias("b"), i.alias("at"), F.lit(n).alias("n"))

    def windows(lines: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(lines) - size), lambda i: window(lines, i, size))

    def all_windows(lines: Column) -> Column:
        def short(words: Column) -> Column:
            def of(n: int) -> Column:
                held = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i + n <= F.size(lines)) & (sum(F.get(words, i + k) for k in range(n)) > long_words))
                return F.transform(held, lambda i: window(lines, i, n))

            a, b = _hash(F.lit("start"), *[F.get(lines, F.lit(k)) for k in range(size - 1)], F.lit("end"))
            whole = F.array(F.struct(a.alias("a"), b.alias("b"), F.lit(0).alias("at"), F.size(lines).alias("n")))
            return F.concat(F.when(F.size(lines) >= size, windows(lines)).otherwise(whole), *[of(n) for n in range(1, size)])

        return common.let(F.transform(lines, lambda x: F.size(common.words(x))), short)

    each = common.let(F.col("__lines"), windows if long_words is None else all_windows)
    w = d.select("doc_id", "__text_hash", F.explode(each).alias("w")).select("doc_id", "__text_hash", "w.*")
    here = F.struct("doc_id", "__text_hash", "at")
    # a window's occurrences are dealt over SALTS tasks, where all but the first are later ones; only these firsts meet in one task
    w = w.withColumn("salt", F.pmod(F.xxhash64(here), F.lit(SALTS)))
    dealt = w.withColumn("first", F.min(here).over(Window.partitionBy("a", "b", "salt")))
    firsts = dealt.where(here == F.col("first")).withColumn("first", F.min(here).over(Window.partitionBy("a", "b")))
    later = dealt.where(here != F.col("first")).unionByName(firsts.where(here != F.col("first")))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda w: F.sequence(w["at"], w["at"] + w["n"] - 1)))))
    return later.groupBy("doc_id", "__text_hash").agg(places.alias("__gone"))


def dedup(docs: DataFrame, size: int = 3, long_words: int | None = None) -> DataFrame:
    """docs with the repeated passages cut out of text, and n_lines and n_removed (lines that hold a word, long)."""
    docs = common.without(docs, *RESULT)
    gone = covered(docs, size, long_words).select(F.col("doc_id").alias("__doc"), F.col("__text_hash").alias("__hash"), "__gone")
    d = docs.withColumn("__text_hash", F.xxhash64("text"))
    d = d.join(gone, d["doc_id"].eqNullSafe(gone["__doc"]) & (d["__text_hash"] == gone["__hash"]), "left")
    full = F.split(F.col("text"), "\n", -1)

    def cut(lines: Column) -> Column:
        # the place of a line among those that hold a word is the number of such lines before it
        held = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(common.WORD), i)), lambda i: i.isNotNull())
        drop = common.let(held, lambda h: F.transform(F.col("__gone"), lambda g: F.get(h, g)))
        return common.let(F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines))), lambda at: F.array_join(F.flatten(kept(lines, at)), "\n"))

    def kept(lines: Column, at: Column) -> Column:
        """The runs of lines between those that go, whose places are at, with a place before the first and after the last line."""
        return F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.slice(lines, F.get(at, k - 1) + 2, F.get(at, k) - F.get(at, k - 1) - 1))

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(common.let(full, cut))
    lines = F.size(F.filter(full, lambda x: x.rlike(common.WORD)))
    d = d.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return d.withColumn("text", text).select(*docs.columns, *RESULT)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_line_dedup with repeated passages of one or two lines over LONG_WORDS words, and repeated whole short texts, cut too."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, long_words=LONG_WORDS)


SQL = r"""
WITH l AS (
  SELECT doc_id, text, u.line, u.pos FROM (
    SELECT doc_id, text, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'pos': i})) AS u
    FROM documents WHERE text IS NOT NULL)),
h AS (
  SELECT doc_id, text, line, pos, regexp_matches(line, '[^\x20\x09-\x0D]') AS held,
         sum(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place
  FROM l),
w AS (
  SELECT doc_id, place, [line, lead(line) OVER o, lead(line, 2) OVER o] AS k, lead(line, 2) OVER o IS NOT NULL AS whole
  FROM h WHERE held WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
later AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY k ORDER BY doc_id, place) AS n FROM w WHERE whole)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, place + k AS place FROM later, (VALUES (0), (1), (2)) v(k)),
r AS (
  SELECT h.doc_id, count(*) FILTER (WHERE held)::BIGINT AS n_lines, count(*) FILTER (WHERE held AND g.place IS NOT NULL)::BIGINT AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (held AND g.place IS NOT NULL)) AS text
  FROM h LEFT JOIN gone g ON h.doc_id = g.doc_id AND h.place = g.place GROUP BY h.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
