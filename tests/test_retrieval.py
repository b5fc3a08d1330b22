import numpy as np
import pytest

from wayframe.operators import retrieval as N

V = [(0.0, 0.0), (0.1, 0.0), (5.0, 0.0), (5.1, 0.0)]


def index(spark, plus=0.0):
    rows = [(f"s{i}", g, [x + plus, y + plus]) for i, ((x, y), g) in enumerate(zip(V, ("event-a", "event-a", "event-b", "event-c")))]
    return spark.createDataFrame(rows, "id string, grp string, v array<double>")


def found(df):
    return [(r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in df.orderBy("query_id", "rank").collect()]


def test_ids_that_are_texts_and_both_exclusions(spark):
    i = index(spark)
    got = found(N.knn(i.where("id = 's0'"), i, 2))
    assert [g[2] for g in got] == ["s2", "s3"] and [g[3] for g in got] == pytest.approx([5.0, 5.1])


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_padding(spark, metric):
    i = index(spark, 1.0)
    got = found(N.knn(i.where("id = 's0'"), i, 5, metric, exclude_self=False, exclude_group=False, pad=True))
    assert [g[1] for g in got] == [1, 2, 3, 4, 5] and got[4][2:] == (None, float("inf")) and all(g[2] for g in got[:4])
    alone = found(N.knn(i.where("id = 's0'"), i.where("grp = 'event-a'"), 2, metric, pad=True))
    assert alone == [("s0", 1, None, float("inf")), ("s0", 2, None, float("inf"))]
    assert found(N.knn(i.where("id = 's0'"), i.where("grp = 'event-a'"), 2, metric)) == []
    assert found(N.knn(i.where("id = 's0'"), i.where("false"), 1, metric, pad=True)) == [("s0", 1, None, float("inf"))]


def test_vectors_that_are_none_are_refused(spark):
    good = [("a", "g", [1.0, 2.0]), ("b", "h", [2.0, 1.0])]
    frame = lambda *more: spark.createDataFrame([*good, *more], "id string, grp string, v array<double>")
    assert len(found(N.knn(frame(), frame(), 1, "cosine"))) == 2 and len(found(N.knn(frame(), frame(("z", "i", [0.0, 0.0])), 1))) == 2
    for bad, match in ((("z", "i", [0.0, 0.0]), "zero vector"), (("z", "i", [float("nan"), 1.0]), "finite"), (("z", "i", [None, 1.0]), "finite"), (("z", "i", [1.0]), "widths"), (("z", "i", None), "widths")):
        with pytest.raises(Exception, match=match):
            found(N.knn(frame(), frame(bad), 1, "cosine"))
    assert len(found(N.knn(frame((None, "i", [1.0, 1.0])), frame((None, "i", [1.0, 1.0])), 1))) == 2


def test_matrix_checks():
    assert N.checked_matrix(np.ones((2, 3))).shape == (2, 3)
    for bad in (np.ones(3), np.ones((2, 0)), np.array([[np.inf]])):
        with pytest.raises(ValueError):
            N.checked_matrix(bad)
    with pytest.raises(ValueError):
        N.checked_matrix(np.array([[1.0], [0.0]]), nonzero=True)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_a_block_of_queries_keeps_k_rows_of_all_blocks_of_the_index(spark, monkeypatch, metric):
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (300, 3)) + 0.5
    df = spark.createDataFrame([(i, str(i % 5), [float(x) for x in v[i]]) for i in range(300)], "id long, grp string, v array<double>")
    made, put = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda d, *a: made.append(put(d, *a)) or made[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = found(N.knn(df, df, 3, metric, block=40))
        assert made[-1].count() == 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    for i in range(300):
        d = np.sqrt(((v - v[i]) ** 2).sum(1)) if metric == "euclidean" else np.maximum(1 - (unit * unit[i]).sum(1), 0)
        d[np.arange(300) % 5 == i % 5] = np.inf
        assert [g[2] for g in got if g[0] == i] == np.lexsort((np.arange(300), d))[:3].tolist()
