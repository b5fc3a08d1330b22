"""Readers and writers of response texts, JSON lines, manifests, vector tables and split tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as A
from ..functions import text as X
from ..operators.settings import Settings
from .arrays import put_json
from .lines import read_jsonl, valid_jsonl  # noqa: F401

#: Columns of the records that go into a prompt, come of a model, and are compared with the truth.
PROMPTS = "sample_id string not null, event_id string, source_split string not null, system_prompt string not null, user_prompt string not null"
PREDICTED = "sample_id string not null, status string not null, raw_output string, intention int, trajectory array<struct<x: double, y: double>>"
REFERENCES = "sample_id string not null, intention int not null, trajectory array<struct<x: double, y: double>> not null"


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows in the columns of schema (DDL), each cast where it can be, and `_error`: the first column that lacks a value it must have, else null.

    A column that is absent is null, a text of blanks in a column that must have a value is none, and other columns go.
    """
    fields = T.StructType.fromDDL(schema).fields
    given = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
    made = rows.select(*[given(f).alias(f.name) for f in fields])
    lacks = lambda f: F.col(f.name).isNull() | (F.trim(f.name) == "") if isinstance(f.dataType, T.StringType) else F.col(f.name).isNull()
    wrong = [F.when(lacks(f), f.name) for f in fields if not f.nullable]
    return made.withColumn("_error", F.coalesce(*wrong, F.lit(None).cast("string")))


def read_responses(spark: SparkSession, folder: str, recursive: bool = False, kind: str = "response") -> DataFrame:
    """(sample_id, text, file) of <kind>_sample_<id>.txt files; sample_id is null where the name has no number."""
    reader = spark.read.option("pathGlobFilter", f"{kind}_sample_*.txt").option("recursiveFileLookup", recursive)
    raw = reader.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    number = F.regexp_extract("file", rf"{kind}_sample_(\d+)\.txt$", 1)
    return raw.select(F.nullif(number, F.lit("")).cast("int").alias("sample_id"), F.col("value").alias("text"), "file")


def not_finite(rows: DataFrame) -> Column:
    """Whether a row has a number, at any depth of its columns, that is not finite; null or false if not."""

    def odd(c: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.isnan(c) | (F.abs(c) == float("inf"))
        if isinstance(kind, T.ArrayType):
            return F.exists(c, lambda x: F.coalesce(odd(x, kind.elementType), F.lit(False))) if has_numbers(kind.elementType) else None
        if isinstance(kind, T.MapType):
            tests = [t for t in (odd(F.map_keys(c), T.ArrayType(kind.keyType)), odd(F.map_values(c), T.ArrayType(kind.valueType))) if t is not None]
        elif isinstance(kind, T.StructType):
            tests = [t for f in kind.fields if (t := odd(c[f.name], f.dataType)) is not None]
        else:
            return None
        return any_of(tests)

    def has_numbers(kind: T.DataType) -> bool:
        return odd(F.lit(None), kind) is not None

    def any_of(tests: list[Column]) -> Column | None:
        out = None
        for t in tests:
            t = F.coalesce(t, F.lit(False))
            out = t if out is None else out | t
        return out

    tests = [t for f in rows.schema.fields if (t := odd(F.col(f"`{f.name}`"), f.dataType)) is not None]
    return any_of(tests) if tests else F.lit(False)


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False, key: str = "sample_id") -> None:
    """Write JSON lines; the committer publishes a finished folder only. Keys must be unique and not blank, and numbers at any depth finite."""
    from ..operators.joins import assert_unique

    if not rows.where(F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))).isEmpty():
        raise ValueError(f"a blank {key}")
    assert_unique(rows, key)
    if not rows.where(F.coalesce(not_finite(rows), F.lit(False))).isEmpty():
        raise ValueError("numbers that are not finite are not JSON")
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_contexts(spark: SparkSession, path: str, width: int = 17) -> DataFrame:
    """Good rows of a context manifest: all of the train split, vectors of the given width and finite, ids unique."""
    from ..operators.joins import assert_unique

    rows = spark.read.schema("sample_id string, event_id string, source_split string, status string, vector array<double>").json(path)
    if not rows.where(F.coalesce(F.col("source_split") != "train", F.lit(True))).isEmpty():
        raise ValueError("contexts of another split than train")
    good = rows.where("status = 'ok'")
    odd = (F.size("vector") != width) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not good.where(F.col("vector").isNull() | odd).isEmpty():
        raise ValueError("vectors of another width or not finite")
    return assert_unique(good, "sample_id")


def read_split(spark: SparkSession, path: str, split: str, include_future: bool = False, limit: int | None = None, order: str = "sample_id") -> DataFrame:
    """Samples of one split; without their future columns, which are then not read, unless asked for. limit: the first so many by `order`, whose ties are any of them."""
    from ..operators.joins import observations, only_split

    rows = only_split(spark.read.parquet(path), split)
    rows = rows if include_future else observations(rows)
    return rows.orderBy(order).limit(limit) if limit is not None and limit > 0 else rows


def read_configured(spark: SparkSession, settings: Settings, split: str, schema: str, include_future: bool = False, limit: int | None = None) -> DataFrame:
    """The split that a settings file names, from MATLAB files: rows of schema (DDL), whose columns of the future are not decoded unless asked for.

    A split that the kind of run may not read and a path that is still a placeholder are errors before a file is opened. limit: the first so many samples by file
    name and place. A file without the key of the split is an error that names the keys there are.
    """
    from ..operators.joins import FUTURE
    from .mat import read_mat

    path, key = settings.split(split)
    fields = [f for f in T.StructType.fromDDL(schema).fields if include_future or f.name.lower() not in FUTURE]
    return read_mat(spark, path, T.StructType(fields), key, limit=limit)


def save_artifact(rows: DataFrame, path: str, split: str = "train", version: int = 1) -> None:
    """A fitted table with its provenance in columns, as an index or scaler."""
    rows.withColumn("_version", F.lit(version)).withColumn("_split", F.lit(split)).write.parquet(path)


def load_artifact(spark: SparkSession, path: str, version: int = 1, widths: dict[str, int] | None = None, positive: tuple[str, ...] = ()) -> DataFrame:
    """A fitted table, checked before it is used: version, split, not empty, numbers finite at any depth, arrays of the widths given by column, and columns of numbers
    or arrays of numbers that must be above zero, as scales."""
    rows = spark.read.parquet(path)
    kinds = dict(rows.dtypes)
    tests = {"of another version, or not fitted on train": F.expr(f"_version <> {version} or _split <> 'train' or _version is null or _split is null"), "with numbers that are not finite": not_finite(rows)}
    for c, n in (widths or {}).items():
        tests[f"with {c} of another width than {n}"] = F.coalesce(F.size(c) != n, F.lit(True))
    for c in positive:
        low = lambda x: F.coalesce(x <= 0, F.lit(True))
        tests[f"with {c} not above zero"] = F.coalesce(F.exists(c, low), F.lit(True)) if kinds[c].startswith("array") else low(F.col(c))
    found = rows.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, t in enumerate(tests.values())]).first()
    if not found["n"]:
        raise ValueError("an empty artifact")
    for i, text in enumerate(tests):
        if found[f"t{i}"]:
            raise ValueError(f"artifact {text}: {found[f't{i}']} rows")
    return rows.drop("_version", "_split")


def write_vectors(answers: DataFrame, folder: str, width: int = 30) -> None:
    """Answers (sample_id, vector, error, ...) as vectors, meta and dead letters: tables `vectors` and `errors`, lines of `meta`, and files vocab.json and summary.json.

    A vector of another width or with a number that is not finite is a dead letter too. Missing texts of meta are empty.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.coalesce("error", F.when(F.col("vector").isNull() | (F.size("vector") != width), "width").when(bad, "not finite"))
    rows = answers.withColumn("error", reason)
    good = rows.where("error is null")
    meta = [f.name for f in answers.schema.fields if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType)) and f.name != "error"]
    good.select("sample_id", "vector").write.parquet(f"{folder}/vectors")
    good.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in meta]).write.option("header", True).option("emptyValue", "").csv(f"{folder}/meta")
    rows.where("error is not null").select(*meta, "error").write.json(f"{folder}/errors")
    parsed, errors = (rows.sparkSession.read.schema("sample_id string").format(kind).load(f"{folder}/{name}").count() for name, kind in (("vectors", "parquet"), ("errors", "json")))
    put_json(f"{folder}/summary.json", {"parsed": parsed, "errors": errors, "c_dim": width if parsed else None})
    layout = {"phase_onehot": len(X.PHASES), "strategy_scores": len(X.STRATEGIES), "speed_change_onehot": len(X.SPEEDS), "continuous": len(A.NUMBERS), "continuous_mask": len(A.NUMBERS)}
    put_json(f"{folder}/vocab.json", {"phases": list(X.PHASES), "strategy_pool": list(X.STRATEGIES), "speed_change_vocab": list(X.SPEEDS), "continuous_fields": list(A.NUMBERS), "c_layout": layout, "c_dim_total": sum(layout.values())})


def read_vectors(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """(sample_id, vector), one row per sample: of repeats the one of the largest `order`, and without it any repeat is an error."""
    from ..operators.joins import assert_unique

    rows = spark.read.parquet(path)
    if order is None:
        return assert_unique(rows, "sample_id").select("sample_id", "vector")
    return rows.groupBy("sample_id").agg(F.max_by("vector", order).alias("vector"))


def append_history(metrics: DataFrame, path: str) -> None:
    """Add rows of metrics, as of an epoch, to the lines at path."""
    metrics.write.mode("append").json(path)


def close_history(spark: SparkSession, path: str, folder: str, metric: str, epoch: str = "epoch", largest: bool = False) -> dict:
    """Sum up the lines that append_history wrote: best and last record, and files metrics.csv (a folder, by epoch), best_metrics.json and summary.json in folder.

    The best record has the least metric, or with largest the greatest, of ties the first epoch; records without a number there, or with NaN, are never best. A
    history has one record an epoch (repeats and null epochs are an error), so the sorted rows are few. An empty history is an error.
    """
    from ..operators.joins import assert_unique

    rows = assert_unique(spark.read.json(path), epoch)
    value = F.nanvl(F.col(metric).cast("double"), F.lit(None))
    found = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(epoch).isNull()).alias("unnamed"),
        F.min_by(F.struct("*"), F.when(value.isNotNull(), F.struct((-value if largest else value).alias("v"), F.col(epoch)))).alias("best"),
        F.max_by(F.struct("*"), epoch).alias("last"),
    ).first()
    if not found["n"] or found["unnamed"]:
        raise ValueError("an empty history" if not found["n"] else f"records without {epoch}")
    rows.select(epoch, *[c for c in rows.columns if c != epoch]).coalesce(1).sortWithinPartitions(epoch).write.mode("overwrite").option("header", True).csv(f"{folder}/metrics.csv")
    best, last = (r.asDict(True) if r is not None else None for r in (found["best"], found["last"]))
    put_json(f"{folder}/best_metrics.json", {"metric": metric, "best_epoch": best and best[epoch], "best_value": best and best[metric], "record": best})
    summary = {"epochs": found["n"], "best_record": best, "last_record": last, "metrics_csv": f"{folder}/metrics.csv", "metrics_jsonl": path, "best_metrics": f"{folder}/best_metrics.json"}
    put_json(f"{folder}/summary.json", summary)
    return summary


def write_batch_summary(done: DataFrame, folder: str, kind: str = "prompt") -> dict[str, int]:
    """What became of a batch (sample_id, status): lines (sample_id, success, table) in batch_summary, and counts by status in summary.json.

    success is status ok or dry_run; a null status is none and counts as `unknown`. table is where write_texts put the sample's text.
    """
    named = F.coalesce("status", F.lit("unknown"))
    lines = done.select("sample_id", named.alias("status"))
    lines.select("sample_id", F.col("status").isin("ok", "dry_run").alias("success"), "status", F.lit(f"kind={kind}").alias("table")).write.mode("overwrite").json(f"{folder}/batch_summary")
    # counted from what was written, so a batch that asks a model is not run again
    written = by_status(done.sparkSession.read.schema("status string").json(f"{folder}/batch_summary"))
    put_json(f"{folder}/summary.json", {"samples": sum(written.values()), "success": written.get("ok", 0) + written.get("dry_run", 0), "statuses": written})
    return written


def by_status(rows: DataFrame) -> dict[str, int]:
    """Rows by status, by name."""
    return {r["status"]: r["count"] for r in sorted(rows.groupBy("status").count().collect(), key=lambda r: r["status"])}


def write_texts(rows: DataFrame, folder: str, kind: str = "prompt") -> None:
    """(sample_id, text) as one table per kind; texts stay rows, as a file for each would not scale."""
    rows.select("sample_id", "text").write.mode("append").parquet(f"{folder}/kind={kind}")


def with_phase(responses: DataFrame, prompts: DataFrame, fallback: str = "anticipation") -> DataFrame:
    """Responses (sample_id, text) with the phase that their prompt (sample_id, text) names, else the fallback."""
    from ..functions.text import prompt_phase

    named = prompts.groupBy("sample_id").agg(F.min("text").alias("_p")).select("sample_id", prompt_phase(F.col("_p")).alias("_phase"))
    return responses.join(named, "sample_id", "left").withColumn("phase", F.coalesce("_phase", F.lit(fallback))).drop("_phase")
