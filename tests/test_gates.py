from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.functions import kinematics as K
from wayframe.operators import clusters, evaluate, joins, lineage, retrieval, runs
from wayframe.sources import io


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1, 2.0, (3.0, [4.0], (5.0,)), [6.0])], "id int, x double, s struct<a: double, y_future: array<double>, deep: struct<answer: double>>, y_future array<double>")


def test_lineage_of_columns(samples, spark):
    s = lineage.sources(samples.select("id", (F.col("x") + F.col("s.a")).alias("sum"), F.col("y_future").alias("path"), F.col("s").alias("t"), F.col("s.deep.answer").alias("z")))
    assert s == {"id": {"id"}, "sum": {"x", "s.a"}, "path": {"y_future"}, "t": {"s.a", "s.y_future", "s.deep.answer"}, "z": {"s.deep.answer"}}
    renamed = samples.select(F.col("s").alias("t")).select("t.a", F.col("t.deep").alias("d"))
    assert lineage.sources(renamed) == {"a": {"s.a"}, "d": {"s.deep.answer"}}
    assert lineage.sources(samples.select(F.explode("y_future").alias("e"), "id"))["e"] == {"y_future"}
    assert lineage.sources(samples.groupBy("id").agg(F.max("s.y_future").alias("m"))) == {"id": {"id"}, "m": {"s.y_future"}}
    assert lineage.sources(samples.select("x").union(samples.select("s.a"))) == {"x": {"x", "s.a"}}
    made = samples.select("id", "y_future").mapInPandas(lambda b: b, "id int, other array<double>")
    assert "y_future" in lineage.sources(made)["other"]


@pytest.mark.parametrize("leak", ["renamed", "nested", "derived", "joined", "windowed", "whole"])
def test_future_is_refused_under_any_name(samples, leak):
    from pyspark.sql import Window

    w = Window.partitionBy("id")
    df = {
        "renamed": samples.select("id", F.col("y_future").alias("hint")), "nested": samples.select("id", F.col("s.y_future").alias("hint")), "derived": samples.select("id", (F.size("y_future") + F.col("x")).alias("n")),
        "joined": samples.select("id", "x").join(samples.select("id", F.col("s.deep").alias("d")), "id"), "windowed": samples.select("id", F.max("y_future").over(w).alias("m")), "whole": samples.select(F.struct("id", "s").alias("all")),
    }[leak]
    with pytest.raises(ValueError, match="future"):
        lineage.assert_no_future(df)


def test_what_has_no_future_passes(samples):
    good = samples.select("id", "x", F.col("s.a").alias("a")).where("size(y_future) > 0").withColumn("k", F.col("a") * 2)
    assert lineage.assert_no_future(good).count() == 1
    assert lineage.assert_no_future(joins.observations(samples.drop("s"))).columns == ["id", "x"]


def test_fits_take_train_only(spark):
    rows = spark.createDataFrame([("a", " Train", [1.0, 2.0], 0.0, 1.0), ("b", "train", [3.0, 1.0], 5.0, 1.0)], "id string, source_split string, v array<double>, x double, y double").withColumn("grp", F.col("id"))
    other = rows.unionByName(rows.withColumn("source_split", F.lit("test")).withColumn("id", F.lit("c")))
    assert retrieval.moments(rows, "v").count() == 2 and retrieval.knn(rows, rows, 1).count() == 2 and clusters.anchors(rows, 2, starts=1)[1] == 0
    for fit in (lambda d: retrieval.moments(d, "v").count(), lambda d: retrieval.knn(d, d, 1).count(), lambda d: clusters.anchors(d, 2, starts=1), lambda d: retrieval.moments(d.withColumn("source_split", F.lit(None).cast("string")), "v").count()):
        with pytest.raises(Exception, match="a fit on the split"):
            fit(other)


def test_matched_rows_agree(spark):
    rows = spark.createDataFrame([("a", "e1", 1), ("b", None, 2), ("b", "", 3)], "sample_id string, event_id string, v int")
    table = spark.createDataFrame([("a", "e1", 10), ("b", "e2", 20), ("c", "e3", 30)], "sample_id string, event_id string, w int")
    assert sorted(map(tuple, joins.matched(rows, table, "sample_id", "event_id").select("sample_id", "v", "event_id", "w").collect())) == [("a", 1, "e1", 10), ("b", 2, "e2", 20), ("b", 3, "e2", 20)]
    for bad, match in ((("z", "e1", 4), "no match for sample_id z"), (("c", "e1", 4), "another event_id for sample_id c")):
        with pytest.raises(Exception, match=match):
            joins.matched(rows.union(spark.createDataFrame([bad], rows.schema)), table, "sample_id", "event_id").collect()
    with pytest.raises(ValueError, match="repeated"):
        joins.matched(rows, table.union(table), "sample_id", "event_id")


def test_payloads():
    @dataclass
    class Parsed:
        status: str
        points: object

    class Thing:
        def __init__(self):
            self.x, self.error = (1, [2.0]), "mine"

    assert runs.payload(Parsed("no", np.array([[1.0, 2.0]]))) == {"points": [[1.0, 2.0]]} and runs.payload(Thing()) == {"x": [1, [2.0]]}
    assert runs.payload({1: np.float32(2), "sample_id": "z", "d": {"e": (True, None)}}) == {"1": 2.0, "d": {"e": [True, None]}} and runs.payload(None) == runs.payload("text") == {}
    for bad in ([1], {"x": float("nan")}, {"x": {"y": [np.inf]}}, {"x": {1, 2}}, {"x": object()}):
        with pytest.raises((TypeError, ValueError)):
            runs.payload(bad)
    rows = runs.answered(["a"], ["p"], lambda p: p, lambda raw: {"sample_id": "other", "status": "mine", "n": 1}, False)
    assert rows == [{"sample_id": "a", "status": "ok", "raw_output": "p", "n": 1}]
    assert runs.answered(["a"], ["p"], lambda p: p, lambda raw: {"n": float("nan")}, False)[0]["status"] == "parse_error"


def test_settling_and_ordered_gaps(spark):
    rows = spark.createDataFrame([(10.0, 0.0, 0.2, 0.0), (0.0, 10.0, -0.05, -0.04), (1.0, 1.0, None, float("nan"))], "a double, b double, lat_v double, yaw double")
    v = lambda x: F.struct(F.col(x).alias("x"), F.lit(1.0).alias("v"))
    got = rows.select(K.gap_between(v("a"), v("b"))["gap"].alias("g"), K.settling(F.col("lat_v"), F.col("yaw")).alias("s")).collect()
    assert [r["g"] for r in got] == [pytest.approx(5.2), None, None] and [tuple(r["s"]) for r in got] == [(True, False), (False, True), (False, False)]


def test_pooled_and_metric(spark):
    rows = spark.createDataFrame([([[1.0, -5.0], [3.0, -1.0], [9.0, 9.0]], [True, True, None]), ([[1.0, 2.0]], [False]), ([], [])], "v array<array<double>>, m array<boolean>")
    got = rows.select(evaluate.pooled(F.col("v"), F.col("m")).alias("p")).select("p.*").collect()
    assert tuple(got[0]) == ([2.0, -3.0], [3.0, -1.0]) and tuple(got[1]) == ([0.0, 0.0], [0.0, 0.0]) and tuple(got[2]) == (None, None)
    m = evaluate.vector_metric(spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [2.0, 0.0])], "p array<double>, q array<double>"), "p", "q").first()
    assert m["mse"] == pytest.approx(5 / 4) and m["cosine"] == pytest.approx(0.5 / 2**0.5) and m["combined"] == pytest.approx(1.25 + 0.4 * (1 - 0.5 / 2**0.5))


def test_artifacts_are_checked(spark, tmp_path):
    good = spark.createDataFrame([(0, 1.0, [1.0, 2.0]), (1, 2.0, [0.0, 3.0])], "pos int, std double, v array<double>")
    io.save_artifact(good, str(tmp_path / "good"))
    load = lambda name, **o: io.load_artifact(spark, str(tmp_path / name), **o)
    assert load("good", widths={"v": 2}, positive=("std",)).count() == 2
    for options, match in (({"widths": {"v": 3}}, "width"), ({"positive": ("v",)}, "v not above zero"), ({"version": 2}, "version")):
        with pytest.raises(ValueError, match=match):
            load("good", **options)
    for k, bad in enumerate(((2, float("nan"), [1.0, 1.0]), (2, 1.0, [1.0, float("inf")]))):
        io.save_artifact(good.union(spark.createDataFrame([bad], good.schema)), str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError, match="not finite: 1 rows"):
            load(f"bad{k}")
