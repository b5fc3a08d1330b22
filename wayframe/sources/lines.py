"""Lines of text files with their exact numbers, and JSON lines whose faults are named by file and line.

A file is read in splits by many tasks. Each split counts its lines once, and sums over the splits before it give every line its number, so
neither numbers nor an ordered limit need one task, or one order, of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The file of a line, its number there, from 1, and its number over all files by name.
FILE, LINE, OVERALL = "_file", "_line", "_overall"


def held(text: Column) -> Column:
    return ~text.rlike(r"^\s*$")


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(value, _file, _line, _overall) of the lines that are not blank; limit: of the first so many such lines.

    Files follow each other by name. Blank lines count in numbers of lines, and not towards the limit. The lines of one split, of
    spark.sql.files.maxPartitionBytes at most, are ordered in one task where the limit falls into it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))
    of_split = (F.min("_m").alias("_first"), F.count("*").alias("_n"), F.count_if(held(F.col("value"))).alias("_held"))
    splits = raw.groupBy(FILE, "_block").agg(*of_split)
    in_file = Window.partitionBy(FILE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # one row per file in the window without partition
    files = splits.groupBy(FILE).agg(F.sum("_n").alias("_fn"), F.sum("_held").alias("_fh"))
    over = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(FILE, before("_fn", over).alias("_files_n"), before("_fh", over).alias("_files_held"))
    splits = splits.withColumn("_lines", before("_n", in_file)).withColumn("_before", before("_held", in_file)).join(files, FILE)
    splits = splits.withColumn("_before", F.col("_before") + F.col("_files_held"))
    if limit is not None and limit > 0:
        splits = splits.where(F.col("_before") < limit)
    rows = raw.where(held(F.col("value"))).join(splits.drop("_n"), [FILE, "_block"])
    rows = rows.withColumn(LINE, F.col("_m") - F.col("_first") + F.col("_lines") + 1).withColumn(OVERALL, F.col(LINE) + F.col("_files_n"))
    if limit is not None and limit > 0:
        whole = F.col("_before") + F.col("_held") <= limit
        turn = F.row_number().over(Window.partitionBy(FILE, "_block").orderBy("_m"))
        cut = rows.where(~whole).withColumn("_turn", turn).where(F.col("_turn") + F.col("_before") <= limit)
        rows = rows.where(whole).unionByName(cut.drop("_turn"))
    return rows.select("value", FILE, LINE, OVERALL)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str = "sample_id", limit: int | None = None) -> DataFrame:
    """Rows of JSON lines, with _file, _line, _overall, and _error: null, `json` for a line that is none, `key` for a missing or blank key.

    Blank lines are passed over. limit: the first so many lines, by file name and line.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = numbered_lines(spark, path, limit)
    rows = lines.select("*", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    blank = F.coalesce(~held(F.col(f"r.{key}").cast("string")), F.lit(True))
    error = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "json").when(blank, "key")
    return rows.select(*[f"r.{f.name}" for f in schema.fields], error.alias("_error"), FILE, LINE, OVERALL)


def first_fault(rows: DataFrame, key: str = "sample_id") -> tuple[str, int, str] | None:
    """(file, line, reason) of the first line, by number, that is bad or whose key an earlier line has; None for no fault.

    Reasons are those of _error, and `repeated`. Only aggregates of keys meet; a key's lines are never gathered.
    """
    place = F.struct(OVERALL, FILE, LINE)
    bad = rows.where("_error is not null").agg(F.min(F.struct(OVERALL, FILE, LINE, F.col("_error").alias("reason"))).alias("p"))
    good = rows.where("_error is null").select(F.col(key).alias("_key"), place.alias("_place"))
    firsts = good.groupBy("_key").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = good.join(firsts, "_key").where("_place > _first").agg(F.min("_place").alias("q")).select(F.when(F.col("q").isNotNull(), F.struct(F.col(f"q.{OVERALL}"), F.col(f"q.{FILE}"), F.col(f"q.{LINE}"), F.lit("repeated").alias("reason"))).alias("p"))
    found = bad.unionByName(again).agg(F.min("p").alias("p")).first()["p"]
    return None if found is None else (found[FILE], found[LINE], found["reason"])


def valid_jsonl(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """read_jsonl rows without the columns of faults and places. Before anything is used, the first fault is raised as file:line: reason, and so are files
    without lines."""
    if (fault := first_fault(rows, key)) is not None:
        raise ValueError("{}:{}: {}".format(*fault))
    if rows.isEmpty():
        raise ValueError("no lines")
    return rows.drop("_error", FILE, LINE, OVERALL)


def resume_ids(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    """(key): the ids that are in an output of JSON lines already; none where it is absent. A bad or repeated line is an error."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = read_jsonl(spark, path, schema, key)
    if (fault := first_fault(rows, key)) is not None:
        raise ValueError("{}:{}: {}".format(*fault))
    return rows.select(key)
