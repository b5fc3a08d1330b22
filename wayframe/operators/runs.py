"""Prediction runs with a log of committed batches: what a batch returned is on disk before the next one is asked for.

A run's folder holds one file of JSON lines per batch, named by a hash of the batch's ids and put there by a rename. A killed run thus resumes
behind its last finished batch, whether the job, a task or a machine was lost; a task that runs again, or twice at once, finds or replaces the
files of its own batches, so an id has one row. Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import fields, is_dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lines import resume_ids
from ..sources.shared import opened
from .joins import assert_unique, pending

#: Fields of a row that a parser does not set.
PROTECTED = ("sample_id", "status", "raw_output", "error")
MODES = ("resume", "overwrite", "new")


def error_of(e: Exception) -> str:
    return " ".join(f"{type(e).__name__}: {e}".split())[:300]


def plain(v: object) -> object:
    """A value as JSON has it, at any depth: mappings, lists, dataclasses and arrays; numbers must be finite, and anything else is an error."""
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError("a number that is not finite")
        return v
    if isinstance(v, Mapping):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if is_dataclass(v) and not isinstance(v, type):
        return plain({f.name: getattr(v, f.name) for f in fields(v)})
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    raise TypeError(f"{type(v).__name__} is not JSON")


def payload(parsed: object) -> dict:
    """The fields that a parsed answer adds to its row: those of a mapping, dataclass or object, but for PROTECTED ones. Null, texts and other plain values add none."""
    if parsed is None or isinstance(parsed, (str, bool, int, float)):
        return {}
    if not isinstance(parsed, Mapping) and not is_dataclass(parsed) and hasattr(parsed, "__dict__"):
        parsed = vars(parsed)
    found = plain(parsed)
    if not isinstance(found, dict):
        raise TypeError("a parser returns a mapping or an object with fields")
    return {k: v for k, v in found.items() if k not in PROTECTED}


def answered(ids: list[str], prompts: list[str], predictor: Callable[[list[str]], list[str]], parser: Callable[[str], object] | None, fail_fast: bool) -> list[dict]:
    """The rows of one batch. A predictor that fails, or returns another number of outputs or an empty one, makes all of them a generation_error, unless
    fail_fast lets the failure out; an output that the parser refuses is a parse_error of its record."""
    try:
        outputs = list(predictor(prompts))
        if len(outputs) != len(prompts):
            raise RuntimeError(f"{len(outputs)} outputs for {len(prompts)} prompts")
        for i, raw in zip(ids, outputs):
            if not isinstance(raw, str) or not raw.strip():
                raise ValueError(f"no output for {i}")
    except Exception as e:  # noqa: BLE001  a status, not a failure of the run
        if fail_fast:
            raise
        return [{"sample_id": i, "status": "generation_error", "raw_output": "", "error": error_of(e)} for i in ids]
    rows = []
    for i, raw in zip(ids, outputs):
        row = {"sample_id": i, "status": "ok", "raw_output": raw.strip()}
        if parser is not None:
            try:
                row |= payload(parser(raw))
            except Exception as e:  # noqa: BLE001
                row |= {"status": "parse_error", "error": error_of(e)}
        rows.append(row)
    return rows


def put(system: fs.FileSystem, folder: str, name: str, content: bytes) -> None:
    """A file that is there whole or not at all."""
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(hidden) as out:
        out.write(content)
    system.move(hidden, f"{folder}/{name}")


def run(
    records: DataFrame, path: str, predictor: Callable[[list[str]], list[str]], parser: Callable[[str], object] | None = None, batch: int = 16, mode: str = "resume", fail_fast: bool = False, parts: int | None = None
) -> dict[str, int]:
    """Predict the records (sample_id, prompt_text) that the folder at path has no row of; counts of input, skipped, written, ok and errors.

    mode: `resume` skips ids that are there, failed ones too, and refuses a folder with a bad or repeated line; `overwrite` starts anew; `new` refuses a folder
    that is there. A parser may return fields that the row gets. Records without a prompt are a generation_error each and are not asked for. parts: how many
    tasks ask; a task asks for its records in the order of their ids, `batch` at a time. Ids must be unique and not blank.
    """
    if mode not in MODES or batch <= 0:
        raise ValueError(f"mode {mode} or batch {batch}")
    spark = records.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "new" and system.exists(hadoop):
        raise FileExistsError(path)
    if mode == "overwrite":
        system.delete(hadoop, True)
    records = records.select(F.col("sample_id").cast("string").alias("sample_id"), "prompt_text")
    if not records.where(F.coalesce(F.trim("sample_id") == "", F.lit(True))).isEmpty():
        raise ValueError("a blank sample_id")
    assert_unique(records, "sample_id")
    todo = pending(records, resume_ids(spark, path), "sample_id")
    todo = todo.repartition(parts, "sample_id") if parts else todo.repartition("sample_id")

    def committed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, folder = opened(path)
        target.create_dir(folder)
        counts: Counter = Counter()

        def commit(ids: list[str], prompts: list[str]) -> None:
            name = f"batch-{hashlib.sha256(json.dumps(ids).encode()).hexdigest()[:32]}.jsonl"
            if target.get_file_info(f"{folder}/{name}").type == fs.FileType.File:  # of an earlier attempt of this task
                with target.open_input_stream(f"{folder}/{name}") as f:
                    rows = [json.loads(line) for line in f.read().decode("utf-8").splitlines()]
            else:
                asked = [k for k, p in enumerate(prompts) if p is not None]
                made = answered([ids[k] for k in asked], [prompts[k] for k in asked], predictor, parser, fail_fast) if asked else []
                by = dict(zip(asked, made))
                rows = [by.get(k, {"sample_id": i, "status": "generation_error", "raw_output": "", "error": "no prompt"}) for k, i in enumerate(ids)]
                lines = (json.dumps(r, ensure_ascii=False, separators=(",", ":"), allow_nan=False) for r in rows)
                put(target, folder, name, "".join(f"{line}\n" for line in lines).encode("utf-8"))
            counts.update(r["status"] for r in rows)

        ids: list[str] = []
        prompts: list[str] = []
        for b in batches:
            ids += b.column("sample_id").to_pylist()
            prompts += b.column("prompt_text").to_pylist()
            while len(ids) >= batch:
                commit(ids[:batch], prompts[:batch])
                del ids[:batch], prompts[:batch]
        if ids:
            commit(ids, prompts)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["status", "n"])

    made = todo.sortWithinPartitions("sample_id").mapInArrow(committed, "status string, n long").groupBy("status").agg(F.sum("n").alias("n")).collect()
    by = {r["status"]: r["n"] for r in made}
    written, total = sum(by.values()), records.count()
    return {"input": total, "skipped": total - written, "written": written, "ok": by.get("ok", 0), "errors": written - by.get("ok", 0)}
