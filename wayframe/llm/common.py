"""Column expressions and small helpers that the text operators share."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 09 to 0D.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.array_remove(parts, "")


def n_words(text: Column) -> Column:
    """Number of words as a long. Each word has one first character, so one blank is put before each and counted."""
    plain = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), SPACE_CHARS, " " * len(SPACE_CHARS))
    parts = F.split(plain, " +")
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where none is set: a temporary one in local mode, an error on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if spark.sparkContext.master.startswith("local"):
        return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    raise ValueError("spark.checkpoint.dir is not set: tables in between need a folder that all machines share")


def checkpointed(df: DataFrame, *used: DataFrame) -> DataFrame:
    """df cut off from its lineage by a table written in the shared folder, which goes when the session's JVM ends, or before:
    used names earlier such tables that nothing reads any more once df is written.

    Unlike checkpoint(), the table read again brings along no constraints of its former plan, which in loops multiply.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    for old in used:
        if (gone := getattr(old, "_table_path", None)) is not None:
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = hadoop
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names the result needs; names compare without case, as Spark does."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def in_batches(df: DataFrame, size: int = 6 << 20) -> DataFrame:
    """df, in a session whose Arrow batches to Python hold at most about `size` bytes, unless the session has its own bound.

    Plans read the setting when they run, so it stays set; it bounds memory and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key, str(2**31 - 1)).rstrip("bB")) > 1 << 30:
        conf.set(key, str(size))
    return df


def digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> tuple[str, str]:
    """Spans of (kind, start, end) by start, then kind as listed, comma-joined; and the SHA-256 of that."""
    rank = {k: i for i, k in enumerate(kinds)}
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))
    return joined, hashlib.sha256(joined.encode()).hexdigest()
