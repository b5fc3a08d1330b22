import pytest
from pyspark.sql import functions as F

from wayframe.functions import teacher as T
from wayframe.functions import text as X

FRAME = "struct<x: double, y: double, v: double, lat_v: double, acc: double, yaw: double, lane_u: double>"
ROW = "id int, status int, " + ", ".join(f"{r} struct<first: {FRAME}, last: {FRAME}>" for r in ("ego", "tl", "tf", "tff", "ol", "of"))


def move(x0, x, y=0.0, v0=10.0, v=10.0, acc=0.0, lat=0.0, yaw=0.0, u=None):
    real = lambda *a: tuple(None if q is None else float(q) for q in a)
    return real(x0, y, v0, lat, 0.0, yaw, u), real(x, y, v, lat, acc, yaw, u)


def requests(spark, *rows):
    got = T.with_request(spark.createDataFrame(list(rows), ROW)).select("id", "request").collect()
    return {r["id"]: r["request"] for r in got}


def test_requests_by_phase(spark):
    ego, tl, tf, tff = move(0, 10, u=0.7, lat=0.3), move(12, 25, 3.0, v=13.0), move(-20, -8, 3.0, v=12.0, acc=0.6), move(-40, -28, 3.0)
    got = requests(
        spark, (0, 0, ego, tl, tf, tff, None, None), (1, 1, ego, tl, tf, tff, None, None), (2, 2, ego, None, None, None, move(20, 29), move(-30, -19, v=12.0)), (3, 0, ego, None, None, None, None, None), (4, 0, None, tl, tf, tff, None, None), (5, 7, ego, tl, tf, tff, None, None),
        (6, 0, ego, tl, move(0, 30, 3.0), tff, None, None),
    )
    assert got[4] is None and got[5] is None
    a, b, c = got[0], got[1], got[2]
    assert a.splitlines()[0] == "Phase: ANTICIPATION" and b.startswith("Phase: CROSSING") and c.startswith("Phase: RELAXATION")
    assert "Own speed: 10.00 to 10.00 m/s (stable)" in a and "Boundary: 0.70 to 0.70 m away; done of the change: 0.40." in a and "Boundary" not in b + c
    assert "Leader aside: ahead, gap 7.20 to 10.20 m (opening), 3.00 m aside, speed 13.00 m/s (dv 3.00)" in a and "Follower aside: behind, gap 15.20 to 13.20 m (closing)" in a
    assert "Gap 1 (between leader and follower): 28.20 m, stable. Way in: direct." in a.replace("opening", "stable") and "Gap 2 (between the followers): 15.20 m, stable." in a
    assert "Gap 1 (between leader and follower): none. Way in: position_change." in got[6] and "Way in: free." in got[3] and "Leader aside: none, the lane is open ahead." in got[3]
    assert "Distance kept: short, advised 15.00 m." in c and "Motion: still sideways, heading along it." in c and "Follower in lane: behind, gap 25.20 to 24.20 m (closing)" in c and "Gap 1" not in c
    assert all(s in a and s not in c for s in T.MERGE) and all(s in c and s not in a for s in T.RELAX)


def test_requests_name_their_phase(spark):
    got = requests(spark, *[(k, k, move(0, 10), None, None, None, None, None) for k in range(3)])
    df = spark.createDataFrame(list(got.items()), "id int, t string").select("id", X.prompt_phase(F.col("t")).alias("p"))
    assert {r["id"]: r["p"] for r in df.collect()} == dict(enumerate(X.PHASES))


def samples(spark):
    return spark.createDataFrame([("a", "e", "train", "go"), ("b", "e", "test", "stop")], "sample_id string, event_id string, split string, scene string")


def test_records_of_prompts_and_answers(spark):
    s = samples(spark)
    make = lambda df, split, user="scene": T.inference_records(df, split, F.lit("sys"), F.col(user), F.concat(F.lit("sys "), user))
    assert [tuple(r) for r in make(s, " Train ").collect()] == [("a", "e", "train", "sys", "go", "sys go")]
    future = s.withColumn("y_future", F.lit("left"))
    for df, user in ((future, "scene"), (future.withColumnRenamed("y_future", "hint"), "hint")):
        with pytest.raises(ValueError, match="future"):
            make(df, "test", user) if df is future else T.assert_no_future(spark.createDataFrame([("left",)], "y_future string").select(F.col("y_future").alias("hint")))
    labels = spark.createDataFrame([("a", "Thought", 1, [[1.0, 2.0]]), ("b", "x", 0, [[0.0, 0.0]]), ("c", None, 0, [[0.0, 0.0]])], "sample_id string, answer string, intention int, future_local array<array<double>>")
    rows = T.supervised_records(make(s, "train"), labels).collect()
    assert len(rows) == 1 and rows[0]["answer"] == "Thought" and rows[0]["future_local"] == [[1.0, 2.0]] and rows[0]["source_split"] == "train"
    for records, wrong in ((make(s, "test"), "train split"), (make(s.replace("a", "c", ["sample_id"]), "train"), "no answer: c"), (make(s.replace("a", "z", ["sample_id"]), "train"), "no match")):
        with pytest.raises(Exception, match=wrong):
            T.supervised_records(records, labels).collect()
    with pytest.raises(ValueError, match="repeated"):
        T.supervised_records(make(s, "train"), labels.union(labels))
