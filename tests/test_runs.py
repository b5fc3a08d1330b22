import json
import os

import numpy as np
import pytest

from wayframe.operators import runs
from wayframe.sources import arrays, io, lines


def records(spark, n, start=0):
    return spark.createDataFrame([(f"id{i:03d}", f"prompt {i}") for i in range(start, start + n)], "sample_id string, prompt_text string")


def rows_at(spark, path):
    return {r["sample_id"]: r for r in spark.read.schema("sample_id string, status string, raw_output string, error string, size int").json(path).collect()}


def test_counts_of_batches(spark, tmp_path):
    path, log = str(tmp_path / "out"), tmp_path / "log"

    def predict(prompts):
        with open(log, "a") as f:
            f.write(json.dumps(prompts) + "\n")
        return prompts

    run = lambda df, **o: runs.run(df, path, predict, batch=2, parts=1, **o)
    assert run(records(spark, 3)) == {"input": 3, "skipped": 0, "written": 3, "ok": 3, "errors": 0}
    assert [json.loads(x) for x in log.read_text().splitlines()] == [["prompt 0", "prompt 1"], ["prompt 2"]]
    assert run(records(spark, 4)) == {"input": 4, "skipped": 3, "written": 1, "ok": 1, "errors": 0} and len(log.read_text().splitlines()) == 3
    with pytest.raises(FileExistsError):
        run(records(spark, 4), mode="new")
    assert run(records(spark, 2), mode="overwrite")["written"] == 2 and set(rows_at(spark, path)) == {"id000", "id001"}
    for bad in (records(spark, 2).union(records(spark, 1)), spark.createDataFrame([(" ", "x")], "sample_id string, prompt_text string")):
        with pytest.raises(Exception):
            run(bad)
    with pytest.raises(ValueError):
        run(records(spark, 1), mode="append")
    (tmp_path / "out" / "batch-zz.jsonl").write_text('{"sample_id": "x"\n')
    with pytest.raises(ValueError, match="batch-zz.jsonl:1: json"):
        run(records(spark, 5))


def test_statuses(spark, tmp_path):
    def predict(prompts):
        if any("7" in p for p in prompts):
            raise RuntimeError("down\n now")
        return [p.upper() if "4" not in p else " " for p in prompts]

    def parse(raw):
        if raw.endswith("2"):
            raise ValueError("two")
        return {"size": len(raw)}

    df = records(spark, 9).unionByName(spark.createDataFrame([("id100", None), ("id101", "more")], "sample_id string, prompt_text string"))
    got = runs.run(df, str(tmp_path / "o"), predict, parse, batch=2, parts=1)
    assert got == {"input": 11, "skipped": 0, "written": 11, "ok": 5, "errors": 6}
    rows = rows_at(spark, str(tmp_path / "o"))
    assert {k[2:]: r["status"] for k, r in rows.items()} == {"000": "ok", "001": "ok", "002": "parse_error", "003": "ok", "004": "generation_error", "005": "generation_error", "006": "generation_error", "007": "generation_error", "008": "ok", "100": "generation_error", "101": "ok"}
    assert rows["id006"]["error"] == "RuntimeError: down now" and rows["id000"]["size"] == 8 and rows["id100"]["error"] == "no prompt" and rows["id002"]["raw_output"] == "PROMPT 2"


@pytest.mark.parametrize("death", ["error", "kill"])
def test_a_killed_run_resumes_behind_its_last_batch(spark, tmp_path, death):
    path, log, flag = str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "flag")

    def predict(prompts):
        if "prompt 13" in prompts and not os.path.exists(flag):
            open(flag, "w").close()
            if death == "kill":
                os._exit(9)
            raise RuntimeError("stop")
        with open(log, "a") as f:
            f.write("\n".join(prompts) + "\n")
        return prompts

    with pytest.raises(Exception):
        runs.run(records(spark, 20), path, predict, batch=3, parts=1, fail_fast=True)
    before = set(rows_at(spark, path))
    assert before == {f"id{i:03d}" for i in range(12)}
    got = runs.run(records(spark, 20), path, predict, batch=3, parts=1, fail_fast=True)
    assert got == {"input": 20, "skipped": 12, "written": 8, "ok": 8, "errors": 0} and len(rows_at(spark, path)) == 20
    asked = open(log).read().splitlines()
    assert sorted(asked) == sorted(f"prompt {i}" for i in range(20))
    assert lines.resume_ids(spark, path).count() == 20


def test_a_task_that_runs_again_leaves_one_row_an_id(spark, tmp_path):
    path, flag = str(tmp_path / "out"), str(tmp_path / "flag")

    def predict(prompts):
        if "prompt 5" in prompts and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("once")
        return prompts

    for _ in range(2):
        try:
            got = runs.run(records(spark, 9), path, predict, batch=2, parts=2, fail_fast=True)
        except Exception:
            continue
    assert got["input"] == 9 and len(spark.read.json(path).collect()) == 9 == len(rows_at(spark, path))


# --- vectors


def vectors(spark, n=50, width=30):
    r = np.random.default_rng(0)
    return spark.createDataFrame([(f"s{i}", [float(x) for x in v]) for i, v in enumerate(r.standard_normal((n, width)).astype(np.float32))], "sample_id string, vector array<float>")


def test_round_trip_of_vectors(spark, tmp_path):
    df, path = vectors(spark), str(tmp_path / "v")
    arrays.write_arrays(df.repartition(4), path, 30)
    assert sorted(map(str, arrays.read_arrays(spark, path, 30).collect())) == sorted(map(str, df.collect()))
    assert json.loads((tmp_path / "v" / "summary.json").read_text()) == {"parsed": 50, "parts": 4, "c_dim": 30}
    with pytest.raises(Exception, match="exists|FileExists"):
        arrays.write_arrays(df, path)
    arrays.write_arrays(df.limit(5), path, overwrite=True)
    assert arrays.read_arrays(spark, path).count() == 5 and json.loads((tmp_path / "v" / "summary.json").read_text())["parsed"] == 5
    assert not [p for p in os.listdir(path) if p.startswith(".part")]


def test_pairs_of_files_by_ranges(spark, tmp_path, monkeypatch):
    v = np.random.default_rng(1).standard_normal((1003, 4)).astype(np.float32)
    np.save(tmp_path / "ids.npy", np.arange(1003, dtype=np.int32))
    np.save(tmp_path / "c.npy", v)
    monkeypatch.setattr(arrays, "ROWS", 100)
    parts = arrays.ArrayReader({"path": str(tmp_path), "width": "4"}).partitions()
    assert [(p.start, p.end) for p in parts][::10] == [(0, 100), (1000, 1003)]
    got = {r["sample_id"]: r["vector"] for r in arrays.read_arrays(spark, str(tmp_path), 4).collect()}
    assert got == {str(i): [float(x) for x in row] for i, row in enumerate(v)}


@pytest.mark.parametrize("fault", ["nan", "width", "ids", "dimensions", "cut", "pickle", "text"])
def test_broken_files_are_refused(spark, tmp_path, fault):
    c, ids, path = np.ones((6, 3), dtype=np.float32), np.array(list("abcdef")), tmp_path / "part-0.npz"
    if fault == "nan":
        c[2, 1] = np.nan
    save = {"width": dict(ids=ids, c=c[:, :2]), "ids": dict(ids=ids[:5], c=c), "dimensions": dict(ids=ids, c=c[:, 0]), "pickle": dict(ids=np.array([{}] * 6, dtype=object), c=c), "text": dict(ids=ids, c=c.astype(str))}
    np.savez(path, **save.get(fault, dict(ids=ids, c=c)))
    if fault == "cut":
        path.write_bytes(path.read_bytes()[:200])
    with pytest.raises(Exception, match="Broken|part-0.npz"):
        arrays.read_arrays(spark, str(tmp_path), 3).collect()


def test_vectors_that_are_no_numbers_are_not_published(spark, tmp_path):
    bad = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "sample_id string, vector array<float>").coalesce(1)
    nan = spark.createDataFrame([("a", [1.0, float("nan")])], "sample_id string, vector array<float>")
    for k, df in enumerate((bad, nan, bad.repartition(2, "sample_id"))):
        with pytest.raises(Exception):
            arrays.write_arrays(df, str(tmp_path / str(k)), 2)
        assert not (tmp_path / str(k)).exists() or not [p for p in os.listdir(tmp_path / str(k)) if p.endswith(".npz")]


def test_a_record_without_a_prompt_fails_alone(spark):
    from wayframe.operators import runner

    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "sample_id string, prompt_text string").coalesce(1)
    got = {r["sample_id"]: (r["status"], r["error"], r["attempts"]) for r in runner.predictions(df, lambda p: [q.upper() for q in p], str).collect()}
    assert got == {"a": ("ok", None, 1), "b": ("generation_error", "no prompt", 0), "c": ("ok", None, 1)}
