import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.functions import kinematics as K
from wayframe.functions import text as X
from wayframe.operators import evaluate as E
from wayframe.operators import frames as R
from wayframe.operators import joins as J
from wayframe.operators import retrieval as N
from wayframe.operators import runner
from wayframe.sources import io
from wayframe.streaming import resume

POINTS = "array<struct<x: double, y: double>>"


def value(spark, col, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, F.Column) else v.alias(k) for k, v in given.items()] or [F.lit(0).alias("z")])
    return row.select(col.alias("v")).first()["v"]


def vehicle(x, y=0.0, v=10.0):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(v)).alias("v"))


@pytest.mark.parametrize(
    ("x", "y", "v", "role", "risk", "ttc"),
    [
        (20, 3.5, 8, "a", "low", (15.2 + 4.8) / 2),
        (-7, 3.5, 13, "a", "medium", 7 / 3),
        (6, 3.5, 0, "a", "high", 0.6),
        (4, 2.0, 10, "a", "critical", 99.0),
        (1, 3.0, 10, "phys_tl", "leader_overlap", 99.0),
        (-20, 1.0, 10, "a", "high", 99.0),
    ],
)
def test_interaction(spark, x, y, v, role, risk, ttc):
    m = value(spark, K.interaction(vehicle(0), vehicle(x, y, v), F.lit(role)))
    assert m["risk"] == risk and m["ttc"] == pytest.approx(ttc) and m["position"] == ("ahead" if x > 0 else "behind")


def test_interaction_of_none(spark):
    assert value(spark, K.interaction(vehicle(0), F.lit(None).cast("struct<x: double, y: double, v: double>"), F.lit("a"))) is None


def test_pair_swaps(spark):
    one, two = (value(spark, K.pair(*p)) for p in ((vehicle(0, v=12), vehicle(30, v=10)), (vehicle(30, v=10), vehicle(0, v=12))))
    assert one == two and one["gap"] == pytest.approx(25.2) and one["ttc"] == pytest.approx(12.6) and one["trend"] == "closing"


def test_rotation_and_wrap(spark):
    p = F.from_json(F.lit('[{"x": 0, "y": 10}, {"x": -1, "y": 9}]'), POINTS)
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(9.0).alias("y"))
    got = value(spark, R.in_target_frame(p, origin, F.lit(math.pi / 2)))
    assert [(round(r["fwd"], 9), round(r["left"], 9)) for r in got] == [(1, 0), (0, 1)]
    assert value(spark, K.wrapped(F.lit(1.5 * math.pi))) == pytest.approx(-0.5 * math.pi)
    assert value(spark, K.heading(F.lit(90.0))) == pytest.approx(math.pi / 2)


def test_masks_treat_nan_as_nowhere(spark):
    rows = "array<struct<id: int, x: double, y: double>>"
    a = F.from_json(F.lit('[{"id": 1, "x": "NaN", "y": 0}, {"id": 0, "x": 1, "y": 1}, {"id": 3, "x": 1, "y": 1}, {"id": null, "x": 1, "y": 1}]'), rows)
    assert value(spark, R.mask(a)) == [False, False, True, False]
    nan = F.from_json(F.lit('[{"id": 1, "x": "NaN", "y": 0}]'), rows)
    assert value(spark, R.present_loose(nan)) is False and value(spark, R.present_strict(nan)) is False and value(spark, R.present_loose(a)) is True


def test_windows(spark):
    a = F.array(*map(F.lit, (1, 2, 3)))
    assert value(spark, R.tail_window(a, 5)) == [None, None, 1, 2, 3] and value(spark, R.tail_window(a, 2)) == [2, 3]
    assert value(spark, R.head_window(a, 5, F.lit(0))) == [1, 2, 3, 0, 0] and value(spark, R.strided(F.array(*map(F.lit, range(6))), 2)) == [0, 2, 4, 5]
    assert value(spark, R.time_offsets(3, 10)) == pytest.approx([-0.2, -0.1, 0.0])


def test_cyclic(spark):
    assert value(spark, R.cyclic(F.array(*map(F.lit, (True, False, True))), 5)) == [0, 2, 0, 2, 0]
    assert value(spark, R.cyclic(F.array(F.lit(False)), 2)) == [-1, -1]


def test_lane_geometry(spark):
    rows = spark.createDataFrame([("s", t, 3.0, 1.0) for t in range(3)] + [("bad", 0, 30.0, 1.0), ("nan", 0, float("nan"), 1.0)], "sample string, t int, upper double, lower double")
    got = {r["sample"]: r for r in R.lane_width(rows, "sample", "upper", "lower").collect()}
    assert got["s"]["width"] == 4.0 and list(got["s"]["boundaries"]) == [-5.0, -1.0, 3.0, 7.0] and got["bad"]["width"] == got["nan"]["width"] == 3.9


def test_knn_exclusions_and_fewer_than_k(spark):
    rows = spark.createDataFrame([(0, "a", [0.0, 0.0]), (1, "a", [0.1, 0.0]), (2, "b", [5.0, 0.0]), (3, "c", [5.1, 0.0])], "id long, grp string, v array<double>")
    near = lambda k, **o: [r["neighbor_id"] for r in N.knn(rows, rows, k, **o).where("query_id = 0").orderBy("rank").collect()]
    assert near(2) == [2, 3] and near(5, exclude_group=False, exclude_self=False) == [0, 1, 2, 3] and near(5) == [2, 3]


def test_knn_matches_brute_force_over_blocks(spark):
    x = np.random.default_rng(5).standard_normal((60, 6))
    rows = spark.createDataFrame([(i, str(i % 3), v.tolist()) for i, v in enumerate(x)], "id long, grp string, v array<double>")
    d = ((x[:, None] - x) ** 2).sum(2)
    want = {i: [int(j) for j in sorted((j for j in range(60) if j % 3 != i % 3), key=lambda j: (d[i, j], j))[:4]] for i in range(60)}
    got = {}
    for r in N.knn(rows, rows, 4, block=16).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == want


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_ties_beyond_any_slack(spark, metric):
    r = np.random.default_rng(3)
    same, big = r.normal(size=7).tolist(), (r.normal(size=(40, 7)) * 1e-3 + 1e5).tolist()
    rows = [(i, f"g{i}", same) for i in range(50)] + [(50 + i, f"g{50 + i}", v) for i, v in enumerate(big)]
    e = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    got = {}
    for row in N.knn(e, e, 4, metric, block=1000).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["neighbor_id"])
    assert got[49] == [0, 1, 2, 3] and got[0] == [1, 2, 3, 4]
    if metric == "euclidean":
        x = np.array(big)
        for i in range(40):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            d[i] = np.inf
            assert got[50 + i] == (50 + np.lexsort((np.arange(40), d))[:4]).tolist()


def test_lloyd_recovers_two_groups(spark):
    r = np.random.default_rng(7)
    p = np.concatenate([r.normal((-2, 5), 0.05, (40, 2)), r.normal((2, 10), 0.05, (40, 2))])
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double")
    c = sorted((round(r["x"]), round(r["y"])) for r in N.lloyd(points, N.seeds(points, 2)).collect())
    assert c == [(-2, 5), (2, 10)]


def test_endpoints(spark):
    p = F.from_json(F.lit('[{"x": 0, "y": 0}, {"x": 1, "y": 1}, {"x": 2, "y": 2}]'), POINTS)
    at = lambda *m: value(spark, N.endpoint(p, F.array(*map(F.lit, m))))
    assert at(True, True, False)["x"] == 1 and at(True, True, True)["x"] == 2 and at(False, False, False) is None


def test_matching_predictions(spark):
    refs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sample_id string, y int")
    made = spark.createDataFrame([("a", "ok", None, 1), ("b", "parse_error", "bad", None), ("x", None, None, 4)], "sample_id string, status string, error string, y int")
    assert {r["sample_id"]: (r["kind"], r["reason"]) for r in E.problems(refs, made).collect()} == {"b": ("invalid", "bad"), "c": ("missing", None), "x": ("extra", None)}
    with pytest.raises(E.CoverageError, match="bad"):
        E.matched(refs, made)
    assert [(r["sample_id"], r["y"], r["p_y"]) for r in E.matched(refs, made, strict=False).collect()] == [("a", 1, 1)]
    with pytest.raises(ValueError, match="repeated"):
        E.matched(refs.union(refs), made)


def test_knn_without_groups_and_contexts_without_neighbours(spark):
    rows = spark.createDataFrame([(0, None, [0.0]), (1, None, [1.0]), (2, "a", [2.0]), (3, "a", [9.0])], "id long, grp string, v array<double>")
    near = N.knn(rows, rows, 1)
    assert {r["query_id"]: r["neighbor_id"] for r in near.collect()} == {0: 1, 1: 0, 2: 1, 3: 1}
    contexts = rows.select("id", F.array(F.col("id").cast("double")).alias("context"))
    got = N.mean_context(near.where("query_id < 2"), contexts, queries=near.select("query_id"), width=1).collect()
    assert sorted((r["query_id"], r["pos"], r["value"]) for r in got) == [(0, 0, 1.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]


def test_runner_failure_while_asking_again(spark):
    def predict(prompts):
        if prompts == ["bad"]:
            raise RuntimeError("down")
        return list(prompts)

    def parse(raw):
        if raw == "bad":
            raise ValueError(raw)

    rows = spark.createDataFrame([("0", "x"), ("1", "bad"), ("2", "y")], "sample_id string, prompt_text string").coalesce(1)
    got = {r["sample_id"]: (r["status"], r["attempts"]) for r in runner.predictions(rows, predict, parse, format_retries=1).collect()}
    assert got == {"0": ("ok", 1), "1": ("generation_error", 2), "2": ("ok", 1)}


def test_displacement(spark):
    zero = [(0.0, 0.0)] * 50
    rows = spark.createDataFrame([(1, zero, [(1.0, 0.0)] * 50), (2, zero, [(3.0, 0.0)] * 50)], f"id int, a {POINTS}, b {POINTS}")
    d = E.displacement(E.distances(rows, "a", "b", ("id",)), (1.0, 5.0), 10).collect()
    assert [(r["horizon"], r["steps"], r["ade"], r["fde"], r["samples"]) for r in d] == [("1s", 10, 2.0, 2.0, 2), ("5s", 50, 2.0, 2.0, 2)]
    with pytest.raises(ValueError):
        E.displacement(rows, (1.0, 1.0), 10)


def test_classification(spark):
    rows = spark.createDataFrame([("keep", "keep"), ("left", "left"), ("left", "keep")], "t string, p string")
    for r in E.classification(rows, "t", "p").collect():
        assert r["accuracy"] == pytest.approx(2 / 3) and r["macro_f1"] == pytest.approx(2 / 3)


def test_coverage(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    a = spark.createDataFrame([("a", True), ("b", False), ("x", True)], "id string, ok boolean")
    classes = E.coverage(e, a, "id", "ok")
    assert {r["id"]: r["kind"] for r in classes.collect()} == {"a": "valid", "b": "invalid", "c": "missing", "x": "extra"}
    r = E.coverage_report(classes).first()
    assert r["valid"] + r["invalid"] + r["missing"] == r["expected"] == 3 and not r["exact"]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ('{"future_trajectory": [[1, 2], [3.5, 4]]}', None),
        ('{"future_trajectory": [[1, 2]]}', "count"),
        (' {"future_trajectory":[[1e3,-0.5],[3 , 4]] }\n', None),
        ('{"future_trajectory": [[1, 02], [3, 4]]}', "not json"),
        (" ", "empty"),
        ('Here: {"future_trajectory": [[1, 2], [3, 4]]}', "not json"),
        ('```json\n{"future_trajectory": [[1, 2], [3, 4]]}\n```', "not json"),
        ('{"future_trajectory": [[1, 2], [3, 4]], "more": 1}', "keys"),
        ('{"future_trajectory": [[1, 2], [3, 4]], "future_trajectory": [[1, 2], [3, 4]]}', "repeated key"),
        ('{"future_trajectory": [[1, true], [3, 4]]}', "point"),
        ('{"future_trajectory": [[1, NaN], [3, 4]]}', "not finite"),
        ('{"future_trajectory": [[1, 1e999], [3, 4]]}', "not finite"),
        ("[[1, 2], [3, 4]]", "keys"),
        (None, "empty"),
    ],
)
def test_strict_points(spark, text, error):
    points, found = X.read_points(text, 2)
    assert found == error and (points is None) == (error is not None)
    assert value(spark, X.strict_points(F.lit(text).cast("string"), 2)) == (points, error)


def test_first_json():
    r = random.Random(1)
    assert X.first_object('a {"k": "}\\"{", "m": {"n": 1}} {"z": 2}')[0] == '{"k": "}\\"{", "m": {"n": 1}}'
    assert all(X.first_object(t) == (None, None) for t in ("no", "{", None)) and X.first_object("{x} {") == ("{x}", None)
    for _ in range(200):
        value = {"".join(r.choice('ab{}"\\') for _ in range(5)): {"x": ["}", '"', r.random()]}}
        assert json.loads(X.first_object("t" + json.dumps(value) + " } {")[0]) == value


def test_text_rules(spark):
    text = lambda f, s, *a: value(spark, f(F.lit(s), *a))
    assert text(X.phase, " CROSSING ") == "crossing" and text(X.phase, "") == "anticipation" and value(spark, X.phase(F.lit(None).cast("string"))) == "anticipation"
    assert text(X.prompt_phase, "x\nPhase: Relaxation") == "relaxation" and text(X.prompt_phase, "in the crossing") == "crossing" and text(X.prompt_phase, "?") is None
    assert text(X.safe_float, "about -1.5e2 m") == -150 and text(X.safe_float, "none", 7.0) == 7.0 and text(X.safe_float, "1e999", 7.0) == 7.0
    assert text(X.error_text, " a \n b ") == "a b"
    a = F.array(*map(F.lit, range(9)))
    assert value(spark, X.head_and_tail(a, 5)) == [0, 1, 2, 7, 8] and value(spark, X.padded(F.slice(a, 1, 3), F.lit(-1), 4, left=True)) == [-1, 0, 1, 2]
    assert value(spark, X.ranked_code(F.array(F.lit("b"), F.lit("a")), ("a", "b", "c"))) == [1.0, 2.0, 0.0]


def test_lookups_and_guards(spark):
    rows, table = spark.createDataFrame([(1,), (5,)], "id long"), spark.createDataFrame([(2, "two"), (0, "zero")], "k long, v string")
    got = {r["id"]: (r["v"], r["candidate"]) for r in J.first_hit(rows, "id", [F.col("id"), F.col("id") - 1, F.col("id") + 1], table, "k", "v").collect()}
    assert got == {1: ("zero", 1), 5: (None, None)}
    with pytest.raises(Exception, match="no match for id"):
        J.checked(rows, table.withColumnRenamed("k", "id"), "id").collect()
    with pytest.raises(ValueError, match="repeated"):
        J.assert_unique(rows.union(rows), "id")
    with pytest.raises(ValueError, match="future"):
        J.assert_no_future(rows.withColumn("Answer", F.lit(1)))
    with pytest.raises(ValueError, match="split"):
        J.only_split(rows, "validation")
    assert J.observations(rows.withColumn("y_future", F.lit(1))).columns == ["id"]


def test_runner_statuses_and_resume(spark, tmp_path):
    def predict(prompts):
        if "boom" in prompts:
            raise RuntimeError("down\n now")
        return [p.upper() for p in prompts]

    def parse(raw):
        if raw == "BAD":
            raise ValueError("bad")

    records = spark.createDataFrame([("0", "x"), ("1", "bad"), ("2", "boom"), ("3", "y")], "sample_id string, prompt_text string").coalesce(1)
    got = {r["sample_id"]: r for r in runner.predictions(records, predict, parse, batch=2, format_retries=1).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"0": "ok", "1": "parse_error", "2": "generation_error", "3": "generation_error"}
    assert got["1"]["attempts"] == 2 and got["2"]["error"] == "RuntimeError: down now"
    path = str(tmp_path / "out")
    assert runner.resume(records.where("sample_id < 2"), path, predict, parse)["written"] == 2
    assert runner.resume(records, path, predict, parse) == {"input": 4, "skipped": 2, "written": 2, "ok": 1, "parse_error": 1, "generation_error": 2}
    assert runner.delays(4, 0.5, 1.5) == [0.5, 1.0, 1.5] and runner.retryable(429) and not runner.retryable(401)


def test_stream_does_each_file_once(spark, tmp_path):
    schema, src, out, check = "sample_id string, prompt_text string", *(str(tmp_path / x) for x in "soc")
    go = lambda: resume.stream_predictions(spark, src, schema, out, check, lambda p: p, lambda raw: raw)
    for k in range(2):
        spark.createDataFrame([(str(k), "x")], schema).write.mode("append").parquet(src)
        go()
        assert spark.read.parquet(out).count() == k + 1
    go()
    assert spark.read.parquet(out).count() == 2


def test_files(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "response_sample_7.txt").write_text("a\nb")
    (folder / "response_sample_x.txt").write_text("c")
    assert {(r["sample_id"], r["text"]) for r in io.read_responses(spark, str(folder)).collect()} == {(7, "a\nb"), (None, "c")}
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("sample_id", StringType()), StructField("t", StringType())])
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"sample_id": "1", "t": "x"}\n\nnot json\n{"t": "y"}\n')
    assert sorted(str(r["_error"]) for r in io.read_jsonl(spark, str(lines), schema).collect()) == ["None", "json", "key"]
    with pytest.raises(ValueError, match="l.jsonl:3: json"):
        io.valid_jsonl(io.read_jsonl(spark, str(lines), schema))
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], schema)
    io.write_jsonl(rows, str(tmp_path / "out"))
    assert io.valid_jsonl(io.read_jsonl(spark, str(tmp_path / "out"), schema)).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_jsonl(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="repeated"):
        io.write_jsonl(rows.union(rows), str(tmp_path / "two"))
    io.save_artifact(rows, str(tmp_path / "a"))
    assert io.load_artifact(spark, str(tmp_path / "a")).columns == ["sample_id", "t"]
    io.save_artifact(rows, str(tmp_path / "b"), split="test")
    with pytest.raises(ValueError):
        io.load_artifact(spark, str(tmp_path / "b"))


def test_context_rules(spark):
    from wayframe.functions import answers as A

    good = {"Situation Understanding": "s", "Reasoning": "r", "Actions": ["left-turn", "Straight"], "Affordance": ["slow allow", "LEFT_ALLOW"], "Scenario_name": "parking lot"}
    read = lambda text: value(spark, A.context_vector(A.context(F.lit(text))))
    want = [0.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert read(json.dumps(good)) == want and read(" ```JSON\n" + json.dumps(good) + "\n```\n") == want and read("```\n" + json.dumps(good, indent=1) + "\n```") == want
    changes = ({"more": 1}, {"Actions": ["fly"]}, {"Actions": ["straight", "STRAIGHT "]}, {"Actions": "straight"}, {"Actions": []}, {"Actions": ["straight", None]}, {"Actions": list(A.ACTIONS[:4])}, {"Scenario_name": None}, {"Reasoning": " "}, {"Reasoning": 5})
    for change in changes:
        assert read(json.dumps(good | change)) is None, change
    assert read(json.dumps(good) + " so") is None and read("") is None and read("[]") is None and read("```json\n```") is None
    assert read("```python\n" + json.dumps(good) + "\n```") is None and read("```json " + json.dumps(good) + "```") is None
    assert value(spark, A.context(F.lit(json.dumps(good))))["scenario"] == "PARKING_LOT"


def test_strategy_answers(spark):
    from wayframe.functions import answers as A

    body = {
        "phase": "lane crossing", "decision": {"strategy_scores": {"maintain": 0.5, "Yield": 3, "MAINTAIN_AND_OBSERVE": "about 0.75", "fly": 1}, "primary_strategy": "decisive", "target_gap": "gap 2", "confidence": "0.9 or so", "risk_tolerance": None, "stability_level": True},
        "prediction_guidance": {"expected_speed_change": "Slow down, then accelerate", "key_interaction": " tff"},
    }
    read = lambda text, *a: value(spark, A.strategy_answer(F.lit(text), *a))
    r = read("Sure: " + json.dumps(body) + " }")
    scores = [0.0] * 12
    scores[X.STRATEGIES.index("MAINTAIN_AND_OBSERVE")], scores[X.STRATEGIES.index("YIELD_FOR_GAP2")] = 0.75, 1.0
    assert r["vector"] == pytest.approx([0, 1, 0, *scores, 0, 0, 1, 0, 0, 0, 0, 0.9, 1, 0, 0, 0, 0, 1, 1]) and len(r["vector"]) == 30
    assert (r["phase"], r["status"], r["primary_strategy"], r["target_gap"], r["speed_change"], r["key_interaction"]) == ("crossing", 1, "DECISIVE_MERGE", "gap 2", "DECEL", "TFF")
    assert r["ignored"] == {"fly": "1"} and r["error"] is None
    bare = read("{}", "Relaxation")
    assert bare["vector"] == [0, 0, 1, *[0] * 12, 0, 1, 0, *[0] * 12] and bare["primary_strategy"] == "NONE" and bare["target_gap"] == "NONE"
    odd = read('{"decision": [1], "prediction_guidance": 3, "phase": ""}')
    assert odd["vector"] == [1, 0, 0, *[0] * 12, 0, 1, 0, *[0] * 12]
    assert read("none")["error"] == "no complete object" and read("{ open")["error"] == "no complete object" and read("{'a': 1}")["error"] == "not json" and read("{'a': 1}")["vector"] is None


def test_joint_rules(spark):
    from wayframe.functions import answers as A

    good = 'Thought:\n- Notable feature: a\n- Potential behavior: b\nFinal answer:\n- Intention: "1: Left lane change"\n- Trajectory: "[[1, 2], [3, 4.5]]"'
    read = lambda text: value(spark, A.joint_answer(F.lit(text), 2))
    for text in (good, good.replace('"', ""), good.replace(": Left lane change", ""), "\n" + good.lower().replace("feature", "features").replace("\n", "\n\n") + "\n", good.replace("], [", "],\n ["), good.replace('"[', "'[").replace(']"', "]'")):
        assert read(text)["intention"] == 1 and read(text)["points"] == [[1, 2], [3, 4.5]] and read(text)["features"] == ["a"], text
    changes = (("Left", "Right"), ("[3, 4.5]", "[3]"), (", [3, 4.5]", ""), ("4.5", "NaN"), ("4.5", "1e39"), ("- Potential behavior: b\n", ""), ("- Potential", "- Likely"), ('4.5]]"', '4.5]]"\nmore'), ("1:", "3:"), ("Final answer:", "Answer:"), ("Thought:", "So. Thought:"))
    for a, b in changes:
        assert read(good.replace(a, b)) is None, (a, b)
    assert read("") is None and value(spark, A.joint_answer(F.lit(None).cast("string"), 2)) is None
    points = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-4.256)))
    text = value(spark, A.formatted_joint(F.array(F.lit("a")), F.array(F.lit(" b ")), F.lit(2), points))
    assert text.endswith('- Intention: "2: Right lane change"\n- Trajectory: "[[1.0,2.0],[3.0,-4.26]]"') and read(text)["behaviors"] == ["b"]
    assert value(spark, A.formatted_joint(F.array(F.lit(" ")), F.array(F.lit("b")), F.lit(2), points)) is None
    assert value(spark, X.strict_points(A.formatted_direct(points), 2))["points"] == [[1.0, 2.0], [3.0, -4.26]]
    cases = ((1, "left_lane_change"), ("Lane-Keeping", "keep_lane"), (" rlc ", "right_lane_change"), ("3", None), ("", None))
    assert [value(spark, A.intention(F.lit(x))) for x, _ in cases] == [y for _, y in cases]


def test_training_pair(spark):
    from wayframe.functions import answers as A

    p = value(spark, A.training_pair(F.array(*map(F.lit, range(10))), F.array(F.lit(50)), 99, 7))
    assert p["input_ids"] == [0, 1, 2, 8, 9, 50, 99] and p["labels"] == [-100] * 5 + [50, 99]


def test_network(spark):
    from wayframe.operators import models

    r = np.random.default_rng(3)
    x, (w, b), (u, c) = r.standard_normal((5, 4)), (r.standard_normal((4, 6)), r.standard_normal(6)), (r.standard_normal((6, 2)), r.standard_normal(2))
    rows = models.mlp(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "v", [(w, b), (u, c)]).orderBy("id").collect()
    assert np.allclose([k["output"] for k in rows], np.maximum(x @ w + b, 0) @ u + c)
