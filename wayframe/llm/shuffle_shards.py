"""Shuffled shards by a two-pass external shuffle: records scatter by seeded hashes into buckets that fit in memory, and each bucket is shuffled.

1. A record is known by the hash of its content and, among equal records, by its number; equal records may change places, so these
   numbers need no look at where a record stands. A seeded hash of both deals records evenly into as many buckets as hold
   `bucket_bytes` of text each, whatever keys, sources or copies the records share.
2. Each bucket is brought into a stated order and shuffled by Fisher and Yates' method with a generator of its own seed. Buckets follow each
   other, so a running sum of their counts gives each record its place in one random order of all, which is cut into shards of
   counts at most one apart (law `rows`). The order is the same for every partitioning of the input and on every rerun.

Null texts have no bytes and size 1, and a null doc_id is a value like others. Rows that repeat are rows of their own, of any number: they
are counted before they are shuffled, and dealt out again in pieces. An empty table gives empty shards and no rows. Texts of any
length are read whole; passes over lean rows carry only their hash. There are no groups in this method: copies of a text scatter like other records.
Input columns named as result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import common

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Equal records that one task deals out at once.
PIECE = 4096


def content(docs: DataFrame, columns: tuple[str, ...] | None = None) -> list[Column]:
    """Two hashes of a row's content, nulls and their places included; maps count by their entries as text."""
    names = list(columns or docs.columns)
    parts = [F.struct(F.to_json(c) if isinstance(docs.schema[c].dataType, MapType) else F.col(c)) for c in names]
    return [F.xxhash64(*parts, *[F.col(c).isNull() for c in names]).alias("__a"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("__b")]


def records(docs: DataFrame, seed: int = 42, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One lean row per record: __a, __b (two hashes of its content), __nth among equal records, __key (seeded), doc_id, size, text_crc32.

    columns: those that make the content, all by default.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lean = docs.select(*content(docs, columns), "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    equal = lean.groupBy("__a", "__b", "doc_id", "size", "text_crc32").agg(F.count("*").alias("__n"))
    once = equal.where("__n = 1").withColumn("__nth", F.lit(0).cast("long")).drop("__n")
    pieces = equal.where("__n > 1").withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(PIECE).cast("long"))))
    # pieces of an often repeated record spread over tasks before they become rows
    pieces = pieces.repartition("__a", "__from").withColumn("__nth", F.explode(F.sequence("__from", F.least(F.col("__from") + (PIECE - 1), F.col("__n") - 1))))
    return once.unionByName(pieces.drop("__n", "__from")).withColumn("__key", F.xxhash64(F.lit(seed), "__a", "__b", "__nth"))


def shuffler(seed: int) -> Callable[[pa.Table], pa.Table]:
    """Gives the rows of a bucket their places in a random order of the bucket."""

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([(c, "ascending") for c in ("__key", "__a", "__b", "__nth")])
        place = np.arange(bucket.num_rows)
        # Generator.shuffle is Fisher and Yates' method
        np.random.default_rng([seed, bucket["__bucket"][0].as_py()]).shuffle(place)
        return bucket.append_column("__place", pa.array(place))

    return run


def places(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = 64 << 20, columns: tuple[str, ...] | None = None) -> DataFrame:
    """records() with law, shard and slot, and grown_shard, which this law leaves null."""
    keyed = common.checkpointed(records(docs, seed, columns))
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_buckets, n = max(1, -(-total[0] // bucket_bytes)), total[1]
    keyed = keyed.withColumn("__bucket", F.pmod("__key", F.lit(n_buckets).cast("long")))
    # one row a bucket: running sums within groups of 1,024 buckets, and over the groups
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("c")).withColumn("g", F.expr("__bucket div 1024"))
    groups = counts.groupBy("g").agg(F.sum("c").alias("gc")).withColumn("gs", F.sum("gc").over(Window.orderBy("g")) - F.col("gc"))
    starts = counts.join(groups, "g").select("__bucket", (F.col("gs") + F.sum("c").over(Window.partitionBy("g").orderBy("__bucket")) - F.col("c")).alias("__start"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema) + ", __place long"
    shuffled = keyed.groupBy("__bucket").applyInArrow(shuffler(seed), schema).join(starts, "__bucket")
    at, least, more = F.col("__start") + F.col("__place"), n // shards, n % shards
    # the first `more` shards hold one record more than the others
    shard = F.when(at < more * (least + 1), F.floor(at / F.lit(least + 1))).otherwise(more + F.floor((at - more * (least + 1)) / F.lit(max(1, least)))).cast("int")
    out = shuffled.withColumn("shard", shard).withColumn("slot", at - F.col("shard") * least - F.least("shard", F.lit(more)))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = 64 << 20) -> DataFrame:
    """docs with RESULT. Equal records are one row of the join that as many places multiply, so no text is moved more than once for that."""
    d = common.without(docs, *RESULT)
    at = places(d, shards, seed, bucket_bytes).select("__a", "__b", *RESULT)
    whole = d.select(*content(d), F.struct(*d.columns).alias("__row")).groupBy("__a", "__b").agg(F.first("__row").alias("__row"))
    return whole.join(at, ["__a", "__b"]).select("__row.*", *RESULT)


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_bytes: int = 64 << 20, parts: int = 1) -> None:
    """Write docs, with RESULT, as Parquet in one folder shard=k per shard, in `parts` files whose rows are in the order of slot."""
    rows = shard_rows(docs, shards, seed, bucket_bytes)
    rows.repartitionByRange(shards * parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return places(docs).select("doc_id", *RESULT)
