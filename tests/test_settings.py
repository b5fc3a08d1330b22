"""Settings files of the three kinds, the splits that they name, and the summaries of runs."""

import copy
import json

import pytest

from wayframe.operators.settings import Settings
from wayframe.sources import io, mat

DATA = {"train_mat": "in/train.mat", "test_mat": "<TEST>", "train_key": "tr", "test_key": "te"}
GIVEN = {
    "context": {
        "data": DATA | {"history_steps": 10, "future_steps": 30, "sample_rate_hz": 5},
        "paths": {"work_dir": "out", "index": "s3://b/index"},
        "llm": {"model": "<MODEL>"},
        "context": {"dimension": 17, "k": 4},
        "intention_points": {"n_clusters": 64},
        "model": {"d_model": 256},
        "train": {},
        "evaluation": {"prediction_mode": "top1"},
    },
    "joint": {"data": DATA, "paths": {"train_jsonl": "a.jsonl", "validation_jsonl": "<OPTIONAL>"}, "road": {"lane_id_to_position": {"2": "left"}}, "lora": {"r": 8}},
    "direct": {"data": {"test_mat": "/x/test.mat", "test_key": "te"}, "paths": {"test_prompts": "p.jsonl"}, "llm": {"max_format_retries": 1, "base_url_env": ""}},
}


def changed(kind, section, key, value):
    given = copy.deepcopy(GIVEN[kind])
    given.setdefault(section, {})[key] = value
    return given


def test_sections_and_defaults(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(GIVEN["context"]))
    s = Settings.load(path, "context")
    assert s.split(" Train ") == (str(tmp_path / "in/train.mat"), "tr") and s.path("work_dir") == str(tmp_path / "out") and s.path("index") == "s3://b/index"
    assert s["context"] == {"dimension": 17, "k": 4, "metric": "euclidean", "exclude_same_event": True} and s["model"] == {"d_model": 256}
    assert (s["llm"]["temperature"], s["llm"]["max_tokens"], s["data"]["sample_rate_hz"], len(s["data"]["neighbor_roles"])) == (0.7, 1200, 5.0, 6)
    with pytest.raises(ValueError, match="data.test_mat is still a placeholder"):
        s.split("test")
    joint = Settings.of(GIVEN["joint"], "joint", tmp_path)
    assert (joint["generation"]["top_p"], joint["lora"]["r"], joint["lora"]["alpha"], joint["road"]["num_lanes"], joint["prompt"]["history_stride"]) == (0.9, 8, 16, None, 1)
    with pytest.raises(ValueError, match="paths.validation_jsonl is still"):
        joint.path("validation_jsonl")
    direct = Settings.of(GIVEN["direct"], "direct", tmp_path)
    assert direct.split("test") == ("/x/test.mat", "te") and direct["llm"]["base_url_env"] is None and direct["llm"]["max_format_retries"] == 1
    with pytest.raises(ValueError, match="reads only test"):
        direct.split("train")
    direct["data"]["neighbor_roles"].clear()
    assert len(Settings.of(GIVEN["direct"], "direct", tmp_path)["data"]["neighbor_roles"]) == 6
    with pytest.raises(FileNotFoundError):
        Settings.load(tmp_path / "none.json", "joint")


@pytest.mark.parametrize(
    "kind, section, key, value, message",
    [
        ("context", "context", "dimension", 16, "one of 17"),
        ("context", "context", "k", 0, "out of range"),
        ("context", "context", "k", 1.5, "whole number"),
        ("context", "context", "k", True, "whole number"),
        ("context", "context", "metric", "manhattan", "one of euclidean"),
        ("context", "evaluation", "prediction_mode", "all", "one of top1"),
        ("context", "evaluation", "horizons_seconds", [1, -1], "positive numbers"),
        ("context", "data", "sample_rate_hz", float("nan"), "finite number"),
        ("context", "paths", "work_dir", " ", "must be a path"),
        ("context", "llm", "token", "x", "remove token"),
        ("joint", "data", "train_key", " ", "blank"),
        ("joint", "data", "future_steps", 40, "one of 50"),
        ("joint", "data", "neighbor_roles", ["a"] * 6, "six different"),
        ("joint", "data", "intention_label_mode", "other", "one of phase"),
        ("joint", "road", "num_lanes", 0, "out of range"),
        ("joint", "road", "lane_id_to_position", {"1": " "}, "blank place"),
        ("joint", "prompt", "trajectory_precision", 9, "out of range"),
        ("joint", "generation", "top_p", 0.0, "out of range"),
        ("direct", "data", "history_steps", 9, "one of 10"),
        ("direct", "prompt", "max_neighbors", 7, "out of range"),
        ("direct", "prompt", "context_mode", "all", "one of target_only"),
        ("direct", "llm", "max_backoff_seconds", 0.5, "out of range"),
        ("direct", "llm", "api_key_env", "a key", "environment variables"),
    ],
)
def test_refused_values(tmp_path, kind, section, key, value, message):
    with pytest.raises(ValueError, match=message):
        Settings.of(changed(kind, section, key, value), kind, tmp_path)


def test_refused_files(tmp_path):
    with pytest.raises(ValueError, match="missing: llm, train"):
        Settings.of({k: v for k, v in GIVEN["context"].items() if k not in ("llm", "train")}, "context", tmp_path)
    with pytest.raises(ValueError, match="JSON object"):
        Settings.of([], "joint", tmp_path)
    with pytest.raises(ValueError, match="road must be an object"):
        Settings.of(GIVEN["joint"] | {"road": 3}, "joint", tmp_path)
    with pytest.raises(ValueError, match="data.test_key is missing"):
        Settings.of({"data": {"test_mat": "a"}, "paths": {"test_prompts": "p"}}, "direct", tmp_path)
    with pytest.raises(ValueError, match="kind of run"):
        Settings.of({}, "other", tmp_path)


def test_configured_split(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), [[float(i)]]) for i in range(9)], "traj_id double, y_future array<array<double>>")
    mat.write_mat(rows.repartition(2), str(tmp_path / "in/train.mat"), "tr")
    s = Settings.of(GIVEN["joint"], "joint", tmp_path)
    plain = io.read_configured(spark, s, "train", rows.schema.simpleString()[7:-1])
    assert plain.columns[:1] == ["traj_id"] and "y_future" not in plain.columns
    assert sorted(r[0] for r in plain.select("traj_id").collect()) == [float(i) for i in range(9)]
    assert io.read_configured(spark, s, "train", "traj_id double, y_future array<array<double>>", include_future=True).where("y_future is not null").count() == 9
    assert io.read_configured(spark, s, "train", "traj_id double", limit=4).count() == 4
    with pytest.raises(ValueError, match="placeholder"):
        io.read_configured(spark, s, "test", "traj_id double")


def test_limits_have_an_order(spark, tmp_path):
    spark.createDataFrame([(str(i), "train" if i % 2 else "test", 1.0) for i in range(10)], "sample_id string, split string, answer double").repartition(5).write.parquet(str(tmp_path / "s"))
    got = io.read_split(spark, str(tmp_path / "s"), "Train", limit=3)
    assert [r["sample_id"] for r in got.collect()] == ["1", "3", "5"] and got.columns == ["sample_id", "split"]


def test_history_is_summed_up(spark, tmp_path):
    path, out = str(tmp_path / "h"), str(tmp_path / "o")
    for epoch, ade in ((2, 0.5), (1, 0.75), (3, 0.5), (4, None)):
        io.append_history(spark.createDataFrame([(epoch, ade, 1)], "epoch int, ade double, fde int"), path)
    got = io.close_history(spark, path, out, "ade")
    assert (got["epochs"], got["best_record"]["epoch"], got["last_record"]["epoch"]) == (4, 2, 4)
    assert io.close_history(spark, path, out, "ade", largest=True)["best_record"]["epoch"] == 1
    assert json.loads((tmp_path / "o/best_metrics.json").read_text())["best_value"] == 0.75
    assert json.loads((tmp_path / "o/summary.json").read_text())["epochs"] == 4
    assert [r["epoch"] for r in spark.read.option("header", True).csv(f"{out}/metrics.csv").collect()] == ["1", "2", "3", "4"]
    io.append_history(spark.createDataFrame([(4, 0.1)], "epoch int, ade double"), path)
    with pytest.raises(ValueError):
        io.close_history(spark, path, out, "ade")


def test_batch_summary(spark, tmp_path):
    done = spark.createDataFrame([("a", "ok"), ("b", "dry_run"), ("c", "parse_error"), ("d", None), ("e", "ok")], "sample_id string, status string")
    assert io.write_batch_summary(done, str(tmp_path)) == {"dry_run": 1, "ok": 2, "parse_error": 1, "unknown": 1}
    lines = {r["sample_id"]: (r["success"], r["table"]) for r in spark.read.json(str(tmp_path / "batch_summary")).collect()}
    assert lines["a"] == (True, "kind=prompt") and lines["d"] == (False, "kind=prompt") and len(lines) == 5
    assert json.loads((tmp_path / "summary.json").read_text())["success"] == 3
    assert io.write_batch_summary(done.limit(0), str(tmp_path / "none")) == {}
