"""Global numbers of rows in an order, and mini-batches from them, without one task that sees all rows.

An order is a text key. Its first hexadecimal digits deal the rows into ranges of like size; sums of the ranges' counts give each range its first
number, and rows are ordered within their range only. So numbers, and the batches cut from them, do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def random_key(key: str | Column, seed: int = 0, epoch: int = 0) -> Column:
    """A random order of rows that seed, epoch and the row's own key decide, as hexadecimal digits. A null key counts as empty."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))))


def numbered(rows: DataFrame, order: Column, ties: tuple[str, ...], out: str = "number", digits: int = 3) -> DataFrame:
    """rows with their number, from 0, in the order of hexadecimal keys, then of the columns of ties; rows equal in both may change places.

    16 ** digits ranges; a range's rows meet in one task, so take more digits for more rows. The counts of ranges are the only rows of one window.
    """
    d = rows.withColumn("_key", order).withColumn("_range", F.substring("_key", 1, digits))
    counts = d.groupBy("_range").agg(F.count("*").alias("_n"))
    # at most 16 ** digits rows
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", *ties))
    return d.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + inside - 1).drop("_key", "_range", "_start")


def mini_batches(rows: DataFrame, size: int, key: str, seed: int = 0, epoch: int = 0, shuffle: bool = True, digits: int = 3) -> DataFrame:
    """rows with batch, from 0, and place in it: batches of size rows in a random order, the last one of what is left. Without shuffle the order is
    that of the key, a number, nulls first."""
    if size <= 0:
        raise ValueError(f"batches of {size} rows")
    if not shuffle:
        return _cut(_in_order(rows, key), size)
    return _cut(numbered(rows, random_key(key, seed, epoch), (key,), "_number", digits), size)


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """rows with _number in the order of a numeric key: ranges of the key between quantiles take the place of those of the hash."""
    cuts = rows.approxQuantile(key, [i / 64 for i in range(1, 64)], 0.002) if rows.select(key).dropna().limit(1).count() else []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(key).cast("double"))) if cuts else F.lit(0)
    return numbered(rows, F.lpad(F.hex(F.coalesce(at, F.lit(0)).cast("long")), 3, "0"), (key,), "_number")


def _cut(numbers: DataFrame, size: int) -> DataFrame:
    return numbers.withColumn("batch", F.floor(F.col("_number") / size)).withColumn("place", (F.col("_number") % size).cast("int")).drop("_number")


def weighted_mean(metrics: DataFrame, *names: str, size: str = "n") -> DataFrame:
    """One row: of each named metric its mean over batches, weighted by their sizes, and the sum of the sizes. Null metrics, and batches without rows, take no part."""
    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col(size)), F.sum(F.when(F.col(c).isNotNull(), F.col(size)))).alias(c)

    return metrics.where(F.col(size) > 0).agg(*[mean(c) for c in names], F.coalesce(F.sum(size), F.lit(0)).alias(size))
