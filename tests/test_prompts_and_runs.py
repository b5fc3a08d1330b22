import math

import pytest
from pyspark.sql import functions as F

from wayframe.functions import prompts as P
from wayframe.operators import evaluate as E
from wayframe.operators import runner
from wayframe.operators import samples as S
from wayframe.sources import io

from test_samples import frame, sample


def test_exact_texts(spark):
    rows = spark.createDataFrame([([0.125, 2.675, -0.0, -0.001, None, 1e9],), ([],), (None,)], "a array<double>")
    got = [r["t"] for r in rows.select(P.exact_texts(F.col("a")).alias("t")).collect()]
    assert got == [["0.12", "2.67", "0.00", "-0.00", None, "1000000000.00"], [], None]


def test_scene(spark):
    lead = [[3.0, 1.0, 30.0 + i, 4.0, 12.0, 0.0, 0.0, 0.0] for i in range(12)]
    far = [[4.0, 1.0, 400.0, 0.0, 12.0, 0.0, 0.0, 0.0]] * 12
    raw = frame(spark, sample(ctx={"phys_tl": lead, "phys_of": far}), sample(x_hist=None))
    text, none = [r["scene"] for r in P.with_scene(S.adapted(raw)).orderBy(F.col("error").isNotNull()).collect()]
    lines = text.split("\n")
    assert none is None and len(lines) == 9
    assert lines[1] == "target: moving (36.00, 0.00) km/h, acceleration 0.00 m/s^2"
    assert lines[2] == "path: (-9.00, 0.00) (-6.00, 0.00) (-3.00, 0.00) (0.00, 0.00)"
    assert lines[3] == "leader beside: 30.00 m ahead, 4.00 m left, moving (43.20, 0.00) km/h"
    assert lines[4] == "follower beside: not seen" and lines[7] == "follower in lane: none within 200 m"
    placed = P.with_scene(S.adapted(raw), lanes=3, places={1: "left"}).where("error is null").first()["scene"]
    assert placed.startswith("The target is on a highway of 3 lanes, in the left lane.\n")


def test_chat_and_fixed_texts(spark):
    rows = spark.createDataFrame([(" a ", "b\n"), ("a", " \n"), (None, "b")], "s string, u string")
    got = [tuple(r["c"]) for r in rows.select(P.chat(F.col("s"), F.col("u")).alias("c")).collect()]
    assert got == [(None, "<s>[INST] <<SYS>>\na\n<</SYS>>\n\nb [/INST]"), ("no user text", None), ("no system text", None)]
    assert "50 pairs" in P.reminder_text() and "next 5 s" in P.task_text()
    for f in (P.reminder_text, P.task_text):
        with pytest.raises(ValueError):
            f(0)


class Busy(Exception):
    status_code = 503


def test_requests_wait_and_give_up():
    waits, calls = [], []

    def third(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise Busy("key=hidden")
        return " yes "

    assert runner.requested(third, "q", 4, 1.0, 1.5, waits.append) == ("yes", 3) and waits == [1.0, 1.5]
    with pytest.raises(runner.RequestFailed, match=r"2 requests: Busy \(HTTP 503\)$"):
        runner.requested(lambda p: (_ for _ in ()).throw(Busy("key=hidden")), "q", 1, sleep=waits.append)
    refused = type("Refused", (Exception,), {"status_code": 401})
    with pytest.raises(runner.RequestFailed) as e:
        runner.requested(lambda p: (_ for _ in ()).throw(refused()), "q", 4, sleep=waits.append)
    assert e.value.attempts == 1


def test_completions_keep_every_attempt(spark):
    def request(prompt):
        if prompt.startswith("down"):
            raise RuntimeError("secret")
        return "good" if prompt == "x" or ("again" in prompt and prompt.startswith("twice")) else "bad"

    def parse(raw):
        if raw == "bad":
            raise ValueError("not  good")

    rows = spark.createDataFrame([("0", "x"), ("1", "twice"), ("2", "never"), ("3", "down"), ("4", None)], "sample_id string, prompt_text string")
    done = runner.completions(rows, request, parse, "again", format_retries=1, api_retries=1, first=0.0)
    got = {r["sample_id"]: r for r in done.collect()}
    assert {k: (r["status"], r["raw_output"], r["error"]) for k, r in got.items()} == {
        "0": ("ok", "good", None), "1": ("ok", "good", None), "2": ("parse_error", "bad", "ValueError: not good"),
        "3": ("api_error", None, "given up after 2 requests: RuntimeError"), "4": ("api_error", None, "no prompt"),
    }
    assert [tuple(a) for a in got["1"]["attempts"]] == [(0, 1, "parse_error", "bad", "ValueError: not good"), (1, 1, "ok", "good", None)]
    assert [tuple(a)[:3] for a in got["3"]["attempts"]] == [(0, 2, "api_error")] and got["4"]["attempts"][0]["api_attempts"] == 0
    assert runner.completions(rows.limit(0), request, parse, "again").count() == 0
    with pytest.raises(ValueError, match="api_error 2, parse_error 1"):
        runner.assert_all_ok(done)
    assert runner.assert_all_ok(runner.dry_run(rows)).count() == 5


@pytest.mark.parametrize("wrong", [{"batch": 0}, {"max_new": 0}, {"top_p": 0.0}, {"sampling": True, "temperature": 0.0}, {"sampling": True, "beams": 2}, {"window": 4000}])
def test_generation_settings(wrong):
    runner.Generation(window=4096)
    with pytest.raises(ValueError):
        runner.Generation(**wrong)


def test_resume_refuses_a_broken_table(spark, tmp_path):
    rows = spark.createDataFrame([("0", "x")], "sample_id string, prompt_text string")
    path = str(tmp_path / "twice")
    for _ in range(2):
        spark.createDataFrame([("9", "ok", "", None, 1)], runner.SCHEMA).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="repeated"):
        runner.resume(rows, path, list, str)
    path = str(tmp_path / "null")
    spark.createDataFrame([(None, "ok", "", None, 1)], runner.SCHEMA).write.parquet(path)
    with pytest.raises(ValueError, match="without id"):
        runner.resume(rows, path, list, str)


def test_losses(spark):
    path = "array<struct<x: double, y: double>>"
    rows = spark.createDataFrame(
        [([[(0.0, 0.0), (5.0, 0.0)], [(0.0, 0.0), (1.0, 0.5)]], [0.0, math.log(3)], [(0.0, 0.0), (1.0, 0.0)], [True, True]), ([[(2.0, 0.0)]], [1.0], [(0.0, 0.0)], [False])],
        f"m array<{path}>, s array<double>, t {path}, v array<boolean>",
    )
    got = [r["l"] for r in rows.select(E.winner_loss(F.col("m"), F.col("s"), F.col("t"), F.col("v")).alias("l")).collect()]
    assert (got[0]["assigned"], got[0]["steps"], got[0]["regression"]) == (1, 2, 0.125) and got[0]["classification"] == pytest.approx(math.log(4 / 3))
    assert got[1] is None
    one = spark.range(1).select(E.kl_loss(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("k"), E.smooth_l1(F.lit(-3.0)).alias("s"), E.kl_loss(F.array().cast("array<double>"), F.array().cast("array<double>")).alias("n")).first()
    assert tuple(one) == (0.5, 2.5, None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"lane_status": 2.9, "ctx": {"ego": [[1, 2]], "phys_tf": [[3, null]], "other": [[1]]}}', (2, [[1.0, 2.0]], {"phys_tf": [[3.0, None]]})),
        ('{"lane_status": [[[1]]], "ctx": [[{"ego": [[[[5]]]], "phys_ol": []}]]}', (1, [[5.0]], {})),
        ('{"lane_status": [1, 2], "ctx": [{"ego": [[1]]}, {}]}', (0, None, {})),
        ('{"lane_status": "x", "ctx": 3}', (0, None, {})),
        ("{}", (0, None, {})),
        ("{", None),
        (None, None),
    ],
)
def test_lenient(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(S.lenient(F.col("t")).alias("s")).first()["s"]
    assert (got and (got["status"], got["ego"], got["neighbors"])) == want


def test_typed_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", " ", "u", 1), (None, "train", "s", "u", 1), ("c", "train", "s", "u", 1)], "sample_id string, source_split string, system_prompt string, user_prompt string, x int")
    got = io.typed(rows, io.PROMPTS)
    assert "x" not in got.columns and "event_id" in got.columns and [r["_error"] for r in got.collect()] == ["system_prompt", "sample_id", None]
    assert io.typed(spark.createDataFrame([("a", "left")], "sample_id string, intention string"), io.REFERENCES).first()["_error"] == "intention"
    for bad in ([("a", [math.nan])], [("a", [math.inf])], [(" ", [1.0])]):
        with pytest.raises(ValueError):
            io.write_jsonl(spark.createDataFrame(bad, "sample_id string, v array<double>"), str(tmp_path / "j"))
    io.write_jsonl(spark.createDataFrame([("a", [1.0]), ("b", None)], "sample_id string, v array<double>"), str(tmp_path / "j"))
    io.save_artifact(spark.createDataFrame([], "v double"), str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="empty"):
        io.load_artifact(spark, str(tmp_path / "empty"))
