"""Joins with the lookup rules of sample pipelines, and guards that fail a run on broken inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(rows: DataFrame, key: str, candidates: list[Column], table: DataFrame, table_key: str, value: str) -> DataFrame:
    """rows with the value under the first of the candidate keys that the table has; null for none. `key` identifies a row.

    All candidates are looked up in one equi-join and the best is picked by a partial aggregate.
    """
    many = rows.select(key, F.posexplode(F.array(*candidates)).alias("_p", "_k"))
    hits = many.join(table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v")), "_k")
    best = hits.groupBy(key).agg(F.min(F.struct("_p", "_v")).alias("_b"))
    return rows.join(best, key, "left").withColumn(value, F.col("_b._v")).withColumn("candidate", F.col("_b._p")).drop("_b")


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    return rows.join(table.select(key, value), key, "left").withColumn("found", F.col(value).isNotNull()).withColumn(value, F.coalesce(value, default))


def checked(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join in which every row must match, or the query fails at that row."""
    j = rows.join(table.withColumn("_hit", F.lit(True)), key, "left")
    fail = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string")))
    return j.withColumn("_ok", F.when(F.col("_hit").isNull(), fail.cast("boolean")).otherwise(True)).where("_ok").drop("_ok", "_hit")


def matched(rows: DataFrame, table: DataFrame, key: str, agree: str) -> DataFrame:
    """rows, each with the columns of the one row of table that has its key. A key that the table has twice is an error before anything runs; a row without a match, or
    whose `agree`, where it has one, differs from the table's, fails the query. `agree` is the table's."""
    assert_unique(table, key)
    j = rows.withColumnRenamed(agree, "_agree").join(table.withColumn("_hit", F.lit(True)), key, "left")
    name = F.col(key).cast("string")
    none, other = (F.raise_error(F.concat(F.lit(text), name)).cast("boolean") for text in (f"no match for {key} ", f"another {agree} for {key} "))
    same = F.col("_agree").isNull() | (F.col("_agree").cast("string") == "") | F.coalesce(F.col("_agree").cast("string") == F.col(agree).cast("string"), F.lit(False))
    return j.where(F.when(F.col("_hit").isNull(), none).when(~same, other).otherwise(True)).drop("_hit", "_agree")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(rows: DataFrame, *keys: str) -> DataFrame:
    found = repeated_keys(rows, *keys).limit(1).collect()
    if found:
        raise ValueError(f"repeated key: {found[0]}")
    return rows


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


#: Columns that hold the future, which no observation or prompt may have.
FUTURE = ("y_future", "future_local", "future_trajectory", "answer", "intention", "lane_status")


def observations(samples: DataFrame, forbidden: tuple[str, ...] = FUTURE) -> DataFrame:
    """samples without the columns of the future, so a scan does not read them."""
    return samples.drop(*[c for c in samples.columns if c.lower() in forbidden])


def assert_no_future(rows: DataFrame, forbidden: tuple[str, ...] = FUTURE) -> DataFrame:
    if leaked := [c for c in rows.columns if c.lower() in forbidden]:
        raise ValueError(f"columns of the future: {leaked}")
    return rows


def only_split(rows: DataFrame, split: str, allowed: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Rows of one split; names compare without case and blanks."""
    name = split.strip().lower()
    if name not in allowed:
        raise ValueError(f"split {split!r} is not one of {allowed}")
    return rows.where(F.lower(F.trim("split")) == name)
