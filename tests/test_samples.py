import math

import pytest
from pyspark.sql import functions as F

from wayframe.functions import answers as A
from wayframe.functions import kinematics as K
from wayframe.operators import evaluate as E
from wayframe.operators import retrieval as N
from wayframe.operators import samples as S
from wayframe.sources import io


def ego(i, x=None, y=0.0):
    row = [1.0, 1.0, 100.0 + i, float(i if x is None else x), y, 1.9, 2.0] + [0.0] * 12
    row[16] = 10.0
    return row


def sample(**change):
    given = {
        "scenario_id": 7.0, "traj_id": 2.5, "lane_status": 1.0, "time_since_crossing": 0.5, "x_hist": [[float(i), 0.0, 10.0, 0.0, 0.0, 0.0] for i in range(12)],
        "ctx": {"ego": [ego(i) for i in range(12)], **dict.fromkeys(S.ROLES)}, "y_future": [[12.0 + i, 0.5] for i in range(5)],
    }
    ctx = change.pop("ctx", {})
    return given | change | {"ctx": given["ctx"] | ctx}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), S.RAW)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"x_hist": None}, "x_hist has too few rows"),
        ({"x_hist": [[0.0] * 6] * 9}, "x_hist has too few rows"),
        ({"x_hist": [[0.0] * 5] * 12}, "x_hist has too few columns"),
        ({"x_hist": [[math.nan] * 6] * 12}, "x_hist is not finite"),
        ({"ctx": {"ego": None}}, "ego has too few rows"),
        ({"ctx": {"ego": [ego(i, math.inf) for i in range(12)]}}, "ego has no place"),
        ({"ctx": {"ego": [ego(i, i + 0.01) for i in range(12)]}}, "x_hist and ego are not aligned"),
        ({"ctx": {"phys_of": [[1.0]]}}, "phys_of has too few columns"),
        ({"scenario_id": None}, "an identifier is missing"),
        ({"lane_status": 1.5}, "lane_status is not allowed"),
        ({"lane_status": 3.0}, "lane_status is not allowed"),
        ({"time_since_crossing": math.nan}, "time_since_crossing is not finite"),
        ({"y_future": [[0.0, math.nan]]}, "y_future is not finite"),
        ({"y_future": [[0.0, 1.0]]}, "y_future has another number of rows"),
        ({"y_future": None}, None),
    ],
)
def test_rules_of_samples(spark, change, error):
    assert S.adapted(frame(spark, sample(**change)), statuses=(0, 1, 2), future_rows=5).first()["error"] == error


def test_adapted_sample(spark):
    tl = [[5.0, 1.0, 20.0 + i, 1.0, 8.0, 0.0, 0.0, 0.0] for i in range(3)]
    tl[1][0] = -1.0
    off = [[0.0] * 8] * 10
    raw = frame(spark, sample(ctx={"phys_tl": tl, "phys_off": off}), sample(x_hist=[])).withColumn("note", F.lit("kept"))
    good, bad = S.split_by_error(S.adapted(raw))
    row = good.first()
    assert bad.count() == 1 and "error" not in good.columns and row["note"] == "kept"
    assert row["sample_id"] == "7:2.5:111" and row["event_id"] == "7" and len(row["history"]) == 10 and row["history"][0]["x"] == 2.0
    assert [r["valid"] for r in row["neighbors"][0]] == [False] * 7 + [True, False, True] and row["neighbors"][0][8]["x"] == 0.0
    assert not any(r["valid"] for a in row["neighbors"][1:] for r in a) and [len(a) for a in row["neighbors"]] == [10] * 6
    last = good.select(S.last_valid(F.col("neighbors")[0]).alias("r"), S.last_valid(F.col("neighbors")[1]).alias("n")).first()
    assert last["r"]["x"] == 22.0 and last["n"] is None


def test_empty_samples(spark):
    made = S.adapted(spark.createDataFrame([], S.RAW))
    assert made.select(S.retrieval_vector(F.col("history"), F.col("ego"), F.col("neighbors")).alias("v")).count() == 0


def test_vectors_of_a_sample(spark):
    tl = [[5.0, 1.0, 20.0 + i, 1.0, 8.0, 0.0, 0.0, 0.0] for i in range(10)]
    good = S.split_by_error(S.adapted(frame(spark, sample(ctx={"phys_tl": tl}))))[0]
    hist, mine, others = F.col("history"), F.col("ego"), F.col("neighbors")
    row = good.select(
        S.retrieval_vector(hist, mine, others).alias("v"), S.history_vector(mine, S.by_phase(F.lit(1), others)).alias("h"), S.history_vector(mine, S.by_phase(F.lit(2), others)).alias("old"),
        S.lane_boundaries(mine).alias("b"), S.target_vector(F.col("future"), mine, 2).alias("t"), S.target_vector(F.col("future"), mine, 6).alias("none"), S.local_future(F.col("future"), hist, 6).alias("l"),
    ).first()
    assert len(row["v"]) == 800 and sum(row["v"][490:560]) == 20 and sum(row["v"][720:]) == 80
    assert row["v"][63:70] == [0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 1.0] and row["v"][70:77] == [9.0, 1.0, 8.0, 0.0, 0.0, 0.0, 1.0]
    assert len(row["h"]) == 160 and row["h"][:8] == [0.0, 0.0, 10.0, 0.0, 18.0, 1.0, 8.0, 0.0] and not any(row["h"][8:16]) and not any(row["old"][4:16])
    assert [round(b, 6) for b in row["b"]] == [-5.8, -1.9, 2.0, 5.9]
    assert row["t"] == [10.0, 0.5, 11.0, 0.5] and row["none"] is None and [p["valid"] for p in row["l"]] == [True] * 5 + [False] and row["l"][0]["fwd"] == 1.0


def test_absent_and_short_neighbours(spark):
    a = [(0.0, 0.0, 1.0, 0.0), (2.0, 0.0, 1.0, 0.0)]
    kind = "array<struct<x: double, y: double, lon_v: double, lat_v: double>>"
    rows = spark.createDataFrame([(a, [[(5.0, 1.0, 3.0, 0.5)], [(0.0, 0.0, 9.0, 9.0)], [(math.nan, 1.0, 1.0, 1.0)]])], f"e {kind}, n array<{kind}>")
    strict, loose = (rows.select(S.history_vector(F.col("e"), F.col("n"), s)).first()[0] for s in (True, False))
    assert strict == [0, 0, 1, 0, 5, 1, 3, 0.5] + [0] * 8 + [2, 0, 1, 0, -2, 0, 0, 0] + [0] * 8
    assert math.isnan(loose[12]) and loose[:12] == strict[:12]


def test_lanes_without_widths(spark):
    rows = spark.createDataFrame([([(math.nan, 1.0), (0.0, -1.0)],)], "e array<struct<upper: double, lower: double>>")
    assert [round(b, 6) for b in rows.select(S.lane_boundaries(F.col("e"))).first()[0]] == [-5.85, -1.95, 1.95, 5.85]


def test_notable_sentences(spark):
    tl = [[5.0, 1.0, 30.0, 0.0, 8.0, 0.0, 0.0, 0.0]] * 10
    tf = [[6.0, 1.0, 1.0, 0.0, 12.0, 0.0, 0.0, 0.0]] * 10
    far = [[6.0, 1.0, 500.0, 0.0, 1.0, 0.0, 0.0, 0.0]] * 10
    hist = [[float(i), 0.0, 10.0, 0.5, 0.75, 0.0] for i in range(12)]
    g = S.adapted(frame(spark, sample(x_hist=hist, ctx={"phys_tl": tl, "phys_tf": tf, "phys_tff": far, "phys_ol": tf}), sample()))
    many, none = (r["s"] for r in g.select(S.sentences(S.notable(F.col("history"), F.col("neighbors"))).alias("s")).collect())
    assert many == ["target drifts left at 1.80 km/h", "target speeds up by 0.75 m/s^2", "vehicle A leads and is slower by 7.20 km/h", "vehicle B is 10.00 m behind"]
    assert none == ["target moves steadily"]


def test_intentions_and_places(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (3,)], "s int")
    got = rows.select(S.phase_intention(F.col("s")).alias("i")).select("i", S.behaviors(F.col("i")).alias("b")).collect()
    assert [r["i"] for r in got] == [1, 1, 0, None] and got[2]["b"] == [S.BEHAVIORS[0]] and got[3]["b"] is None
    gaps = spark.createDataFrame([(-1.5, True), (3.0, True), (3.0, False), (None, None)], "g double, a boolean")
    assert [tuple(r[0]) for r in gaps.select(K.side_flags(F.col("g"), F.col("a"))).collect()] == [("side_by_side", True), ("ahead", False), ("behind", True), (None, False)]


def test_frames_without_gaps(spark):
    rows = spark.createDataFrame([([(1.0,), (math.nan,), (2.0,)],), ([(math.nan,), (2.0,)],), (None,)], "a array<struct<x: double>>")
    assert [len(r[0]) if r[0] else None for r in rows.select(S.without_gaps(F.col("a"))).collect()] == [2, None, None]


def test_sample_and_shuffle(spark):
    rows = spark.range(100)
    one, two = (sorted(r["id"] for r in S.sampled(rows.repartition(n), 10, "id", 5).collect()) for n in (1, 7))
    assert one == two and len(set(one)) == 10 and S.sampled(rows, 500, "id").count() == 100
    order = [r["id"] for r in S.shuffled(rows, "id", 1).collect()]
    assert sorted(order) == list(range(100)) and order != list(range(100)) and order != [r["id"] for r in S.shuffled(rows, "id", 2).collect()]


def test_masked_last_and_anchors(spark):
    p = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y")) for i in range(3)])
    q = F.array(*[F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))] * 3)
    mask = lambda *m: F.array(*map(F.lit, m))
    assert spark.range(1).select(E.masked_last(p, q, mask(True, False, True)), E.masked_last(p, q, mask(False, False, False))).first()[:] == (1.0, None)
    points = spark.createDataFrame([(i, float(i % 3 * 10), float(i % 2)) for i in range(12)], "id long, x double, y double")
    found, cost = N.anchors(points, 3, starts=4, rounds=20)
    assert cost == pytest.approx(3.0) == N.inertia(points, found) and sorted(round(r["x"]) for r in found.collect()) == [0, 10, 20]
    with pytest.raises(ValueError, match="distinct"):
        N.anchors(points, 7)


def test_decision_labels(spark):
    texts = ['{"phase": "relaxation", "decision": {"target_gap": "GAP1"}}', '{"decision": {"primary_strategy": "x", "target_gap": "gap1", "confidence": 1}}', "[1]", "no", None]
    full, other, *none = (r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.decision_labels(F.col("t"))).collect())
    assert (full["phase"], full["strategy_id"], full["gap"], full["gap_id"], full["stability_level"], full["aggressiveness"]) == ("RELAXATION", 3, "N/A", -1, 0.5, None)
    assert (other["strategy"], other["strategy_id"], other["gap_id"], other["confidence"], other["completion"]) == ("X", 4, 0, 1.0, 0.5)
    assert none == [None] * 3


def test_vector_sinks(spark, tmp_path):
    rows = [("a", [1.0, 2.0], "p", None), ("b", None, "p", "no JSON"), ("c", [1.0], None, None), ("d", [1.0, math.nan], None, None), ("e", [0.0, 0.0], None, None)]
    io.write_vectors(spark.createDataFrame(rows, "sample_id string, vector array<double>, phase string, error string"), str(tmp_path / "v"), 2)
    assert {r["sample_id"]: r["vector"] for r in io.read_vectors(spark, str(tmp_path / "v/vectors")).collect()} == {"a": [1.0, 2.0], "e": [0.0, 0.0]}
    assert {r["sample_id"]: r["error"] for r in spark.read.json(str(tmp_path / "v/errors")).collect()} == {"b": "no JSON", "c": "width", "d": "not finite"}
    assert spark.read.option("header", True).csv(str(tmp_path / "v/meta")).count() == 2
    spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 2)], "sample_id string, vector array<double>, n int").write.parquet(str(tmp_path / "r"))
    assert io.read_vectors(spark, str(tmp_path / "r"), "n").first()["vector"] == [2.0]
    with pytest.raises(ValueError):
        io.read_vectors(spark, str(tmp_path / "r")).count()


def test_texts_phases_and_history(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Phase: crossing"), (2, "nothing")], "sample_id int, text string")
    got = io.with_phase(spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "sample_id int, text string"), texts)
    assert {r["sample_id"]: r["phase"] for r in got.collect()} == {1: "crossing", 2: "anticipation", 3: "anticipation"}
    io.write_texts(texts, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("kind = 'prompt'").count() == 2
    for epoch in (1, 2):
        io.append_history(spark.createDataFrame([(epoch, 0.5)], "epoch int, loss double"), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
