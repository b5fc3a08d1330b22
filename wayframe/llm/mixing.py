"""Mix sources to target weights by hash-random order, distributed prefix sums and exact cuts.

Nulls: a null text has size 0; null sources form one source, which sorts last; a null doc_id only changes the key.
Empty tables give empty results, repeated rows are separate rows, and input columns named as result columns are replaced. Rows of equal
keys have equal doc_ids and texts, so it does not matter which comes first. Texts of any length count whole. Sources are as many as one task can order, some millions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RESULT = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Words to take from each source, one row per source of (source, size).

    Weights repeat over the sources in code point order. The targets share `share` of all words by weight, none above
    `limit` times its source; what is cut off is shared again by weight. Sorted by limit per weight, the sources at
    their limit come first, so one pass of running sums finds the level that the others share.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.select("source", "size", w.alias("w"), n.alias("n")).withColumn("cap", F.col("size") * F.lit(limit))
    by = Window.orderBy(F.col("cap") / F.col("w"), "n")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level of the first source that is not cut off
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "n", "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])
    return s.select("source", F.col("size").alias("source_size"), F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix", digits: int = 3) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes, repeats counted.

    A row's key is a hash, so its first `digits` hex digits deal each source into ranges of the random order of like size:
    a source of any size spreads over 16 ** digits of them. Sums per range give each range its start by a running sum over
    ranges, and rows are ordered within their range only. A source of `b` words to take gives each row b // size epochs,
    and the rows at the start of the order another one up to the remainder; the row at the cut gives the words still wanted.
    """
    d = common.without(docs, *RESULT).withColumn("__size", common.n_words(F.col("text")))
    d = d.withColumn("__key", F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))))
    d = d.withColumn("__range", F.substring("__key", 1, digits))
    ranges = common.checkpointed(d.groupBy("source", "__range").agg(F.sum("__size").alias("__sum")))
    sources = targets(ranges.groupBy("source").agg(F.sum("__sum").alias("size")), weights, share, limit)
    sources = sources.withColumnRenamed("source", "__s")
    budget = F.floor("target").cast("long")
    starts = (
        ranges.withColumn("__before", F.sum("__sum").over(Window.partitionBy("source").orderBy("__range")) - F.col("__sum"))
        .join(sources, F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("__epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long"))
        .withColumn("__rest", budget - F.col("__epochs") * F.col("source_size"))
        .select(F.col("source").alias("__s"), F.col("__range").alias("__r"), "__before", "source_size", "target", "__epochs", "__rest")
    )
    rows = d.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    order = Window.partitionBy("source", "__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("__before") + F.sum("__size").over(order) - F.col("__size")
    taken = F.col("__epochs") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - start))
    kept = [c for c in d.columns if c not in ("__size", "__key", "__range")]
    return rows.withColumn("taken", taken.cast("long")).select(*kept, F.col("__size").alias("size"), "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as taken, rounded to whole documents (half up), says; columns as in docs."""
    m = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.expr("(2 * taken + size) div (2 * size)")).otherwise(0).cast("int")
    return m.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).drop("__copy")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", *RESULT)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n
  FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, n LIMIT 1)), cap) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size
         - (sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size))))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
