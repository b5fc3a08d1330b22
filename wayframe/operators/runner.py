"""Restartable batch inference: what is done is skipped, failures become statuses, and results are appended."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_text
from .joins import assert_unique, pending

SCHEMA = "sample_id string, status string, raw_output string, error string, attempts int"
ATTEMPTS = "array<struct<format_attempt: int, api_attempts: int, status: string, raw_output: string, error: string>>"
AUDITED = f"sample_id string, status string, raw_output string, error string, attempts {ATTEMPTS}"


@dataclass(frozen=True)
class Generation:
    """Settings of a text generator, checked when made."""

    batch: int = 4
    max_input: int = 3072
    max_new: int = 1024
    sampling: bool = False
    temperature: float = 0.7
    top_p: float = 0.9
    beams: int = 1
    window: int | None = None

    def __post_init__(self):
        if min(self.batch, self.max_input, self.max_new, self.beams) <= 0:
            raise ValueError("batch, token limits and beams must be positive")
        if not 0 < self.top_p <= 1 or (self.sampling and self.temperature <= 0):
            raise ValueError("top_p lies in (0, 1], and sampling needs a positive temperature")
        if self.sampling and self.beams != 1:
            raise ValueError("either sampling or beams")
        if self.window is not None and not 0 < self.max_input + self.max_new <= self.window:
            raise ValueError(f"{self.max_input} + {self.max_new} tokens do not fit a window of {self.window}")


class RequestFailed(Exception):
    """A request that was given up, with the number of times it was made."""

    def __init__(self, message: str, attempts: int):
        super().__init__(message)
        self.attempts = attempts


class MissingSetting(Exception):
    """A setting of the machine without which no request can succeed: it ends the run instead of becoming a status of every record."""


def delays(attempts: int, first: float = 1.0, longest: float = 30.0) -> list[float]:
    """Waits between attempts: doubling, up to the longest."""
    return [min(longest, first * 2**k) for k in range(attempts - 1)]


def retryable(status: int | None) -> bool:
    return status is None or status in (408, 409, 425, 429) or status >= 500


def named_failure(e: Exception) -> str:
    """Class and HTTP status of a failure: texts of a service may hold credentials."""
    try:
        return f"{type(e).__name__} (HTTP {int(e.status_code)})"
    except (AttributeError, TypeError, ValueError):
        return type(e).__name__


def requested(request: Callable[[str], str], prompt: str, retries: int, first: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """The answer, without blanks around it, and the number of requests; a blank answer is a failure. Waits double up to the longest."""
    for attempt in range(1, retries + 2):
        try:
            answer = request(prompt)
            if not isinstance(answer, str) or not answer.strip():
                raise ValueError("an empty answer")
            return answer.strip(), attempt
        except MissingSetting:
            raise
        except Exception as e:  # noqa: BLE001  any failure of a service
            status = getattr(e, "status_code", None)
            if attempt > retries or not retryable(status if isinstance(status, int) else None):
                raise RequestFailed(f"given up after {attempt} requests: {named_failure(e)}", attempt) from None
            sleep(min(longest, first * 2 ** (attempt - 1)))
    raise ValueError("retries must not be negative")


def completions(
    records: DataFrame,
    request: Callable[..., str],
    parser: Callable[[str], object],
    reminder: str,
    format_retries: int = 2,
    api_retries: int = 4,
    first: float = 1.0,
    longest: float = 30.0,
    sleep: Callable[[float], None] = time.sleep,
    prompt: str = "prompt_text",
    others: tuple[str, ...] = (),
    concurrent: int = 1,
) -> DataFrame:
    """(sample_id, status, raw_output, error, attempts) of records (sample_id, prompt, others), at most `concurrent` of them asked for at once in a task.

    request gets the prompt, and the columns in `others` by name. status is ok, parse_error (the parser refused the last of format_retries + 1 answers) or
    api_error (a request was given up); raw_output is the last answer. attempts lists each answer asked for, with its requests, status and error; from the second
    on the prompt ends in the reminder. A null prompt is an api_error without a request. Rows keep their order, and what a task holds is one Arrow batch, however
    many requests run; request and parser must bear threads. A task that Spark repeats asks again.
    """
    if format_retries < 0 or api_retries < 0:
        raise ValueError("retries must not be negative")
    if concurrent < 1:
        raise ValueError("at least one request at once")

    def one(text: str | None, *more) -> tuple:
        audit, raw, named = [], None, dict(zip(others, more))
        for k in range(format_retries + 1):
            try:
                if text is None:
                    raise RequestFailed("no prompt", 0)
                raw, made = requested(lambda p: request(p, **named), text if k == 0 else f"{text}\n\n{reminder}", api_retries, first, longest, sleep)
            except RequestFailed as e:
                audit.append((k, e.attempts, "api_error", None, str(e)))
                break
            try:
                parser(raw)
                audit.append((k, made, "ok", raw, None))
                break
            except Exception as e:  # noqa: BLE001  a status, not a failure of the run
                audit.append((k, made, "parse_error", raw, " ".join(f"{type(e).__name__}: {e}".split())[:300]))
        return audit[-1][2], raw, audit[-1][4], audit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("format_attempt", "api_attempts", "status", "raw_output", "error")
        with ThreadPoolExecutor(concurrent) as pool:
            for b in batches:
                rows = list(pool.map(one, b[prompt], *[b[c] for c in others]))
                out = pd.DataFrame(rows, columns=["status", "raw_output", "error", "attempts"], index=b.index)
                out["attempts"] = [[dict(zip(names, a)) for a in audit] for audit in out["attempts"]]
                yield pd.concat([b[["sample_id"]], out], axis=1)

    return records.select("sample_id", prompt, *others).mapInPandas(run, AUDITED)


def dry_run(records: DataFrame) -> DataFrame:
    """What a run would ask for: (sample_id, status dry_run, prompt_text), and nothing is asked."""
    return records.select("sample_id", F.lit("dry_run").alias("status"), "prompt_text")


def assert_all_ok(done: DataFrame, allowed: tuple[str, ...] = ("ok", "dry_run")) -> DataFrame:
    """done, or an error with the statuses of its failures; for the end of a run that captures them row by row."""
    bad = done.where(~F.coalesce(F.col("status").isin(*allowed), F.lit(False))).groupBy("status").count().collect()
    if bad:
        raise ValueError("failed records: " + ", ".join(f"{r['status']} {r['count']}" for r in sorted(bad, key=lambda r: str(r["status"]))))
    return done


def predictions(records: DataFrame, predictor: Callable[[list[str]], list[str]], parser: Callable[[str], object], batch: int = 16, format_retries: int = 0) -> DataFrame:
    """(sample_id, status, raw_output, error, attempts) of records (sample_id, prompt_text).

    A record without a prompt is a generation_error by itself. A batch whose predictor fails or returns another number of outputs is a generation_error throughout; an output that the parser
    refuses is asked for again, alone, up to format_retries times and then a parse_error; a failure while asking again concerns that record only. Task retries may call the predictor again, so it
    must bear repeats.
    """

    def call(prompts: list[str]) -> list[str]:
        out = predictor(prompts)
        if len(out) != len(prompts):
            raise ValueError(f"{len(out)} outputs for {len(prompts)} prompts")
        return out

    def one(prompt: str, raw: str) -> tuple:
        for attempt in range(1, format_retries + 2):
            try:
                parser(raw)
                return "ok", raw, None, attempt
            except Exception as e:  # noqa: BLE001  a status, not a failure of the run
                error = f"{type(e).__name__}: {e}"
                if attempt <= format_retries:
                    try:
                        raw = call([prompt])[0]
                    except Exception as e:  # noqa: BLE001  of this record only
                        return "generation_error", raw, f"{type(e).__name__}: {e}", attempt + 1
        return "parse_error", raw, error, format_retries + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                prompts = [p if isinstance(p, str) else None for p in part["prompt_text"]]
                asked = [p for p in prompts if p is not None]
                try:
                    made = iter([one(p, raw) for p, raw in zip(asked, call(asked) if asked else [])])
                except Exception as e:  # noqa: BLE001
                    made = iter([("generation_error", None, f"{type(e).__name__}: {e}", 1)] * len(asked))
                rows = [("generation_error", None, "no prompt", 0) if p is None else next(made) for p in prompts]
                out = pd.DataFrame(rows, columns=["status", "raw_output", "error", "attempts"])
                yield pd.concat([part[["sample_id"]].reset_index(drop=True), out], axis=1)

    made = records.select("sample_id", "prompt_text").mapInPandas(run, SCHEMA)
    return made.withColumn("error", error_text(made["error"]))


def resume(records: DataFrame, path: str, predictor, parser, **options) -> dict[str, int]:
    """Append the predictions of records that the table at path does not have; counts by kind. Failed ids count as done."""
    spark = records.sparkSession
    assert_unique(records, "sample_id")
    # the file system of the path decides, so that remote folders work too
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    done = spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)
    if not done.where("sample_id is null or status is null").isEmpty():
        raise ValueError("rows of an earlier run without id or status")
    before = assert_unique(done, "sample_id").count()
    todo = pending(records, done, "sample_id")
    predictions(todo, predictor, parser, **options).write.mode("append").parquet(path)
    counts = {r["status"]: r["count"] for r in spark.read.schema(SCHEMA).parquet(path).groupBy("status").count().collect()}
    total = sum(counts.values())
    return {"input": records.count(), "skipped": before, "written": total - before, **counts}
