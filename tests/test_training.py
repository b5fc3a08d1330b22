import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.operators import batches as B
from wayframe.operators import models, training as T


def test_numbers_follow_the_order_for_any_partitions(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(500)] + [(7, 1.0), (7, 1.0), (None, 2.0)], "id long, v double")
    key = lambda i: hashlib.md5(f"3:1:{'' if i is None else i}".encode()).hexdigest()
    want = sorted([*range(500), 7, 7, None], key=key)
    for parts in (1, 5):
        got = B.numbered(rows.repartition(parts), B.random_key("id", 3, 1), ("id",), digits=1).orderBy("number").collect()
        assert [r["id"] for r in got] == want and [r["number"] for r in got] == list(range(503))


@pytest.mark.parametrize("shuffle", [True, False])
def test_batches(spark, shuffle):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    cut = lambda d, **o: sorted((r["batch"], r["place"], r["id"]) for r in B.mini_batches(d, 32, "id", shuffle=shuffle, **o).collect())
    got = cut(rows)
    assert got == cut(rows.repartition(7)) and [sum(b == k for b, _, _ in got) for k in range(4)] == [32, 32, 32, 4]
    assert sorted(i for _, _, i in got) == list(range(100)) and [p for b, p, _ in got if b == 3] == [0, 1, 2, 3]
    assert (cut(rows, epoch=1) == got) == (not shuffle) and ([i for _, _, i in got] == list(range(100))) == (not shuffle)
    assert B.mini_batches(rows.where("false"), 8, "id", shuffle=shuffle).count() == 0
    with pytest.raises(ValueError):
        B.mini_batches(rows, 0, "id")


def test_order_of_keys_of_any_sign(spark):
    keys = [-5.5, 3.0, None, 0.0, 1e300, -1e300, 3.0, 2.5] * 9
    got = B.mini_batches(spark.createDataFrame([(k,) for k in keys], "k double").repartition(3), 1000, "k", shuffle=False).orderBy("place").collect()
    assert [r["k"] for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0.0))


def test_weighted_mean(spark):
    m = spark.createDataFrame([(32, 1.0, None), (32, 2.0, 4.0), (4, 10.0, 5.0), (0, 99.0, 9.0)], "n long, a double, b double")
    r = B.weighted_mean(m, "a", "b").first()
    assert r["a"] == pytest.approx((32 + 64 + 40) / 68) and r["b"] == pytest.approx((128 + 20) / 36) and r["n"] == 68
    assert tuple(B.weighted_mean(m.where("false"), "a").first()) == (None, 0)


def test_gradient_by_finite_differences():
    r = np.random.default_rng(0)
    layers, x, y = T.first_layers((5, 7, 6, 4), 1), r.standard_normal((9, 5)), r.standard_normal((9, 4))
    y[3] = 0
    loss = lambda v: (lambda p: ((p - y) ** 2).mean(1).sum() + 0.4 * (1 - T.cosines(p, y)[0]).sum())(T.forward(T.shaped(v, layers), x)[-1])
    v = T.flat(layers)
    gradient = T.sums_of(layers, x, y, 0.4)[2]
    for i in range(len(v)):
        d = np.zeros(len(v))
        d[i] = 1e-6
        assert (loss(v + d) - loss(v - d)) / 2e-6 == pytest.approx(gradient[i], abs=1e-5)


def test_adam_and_clipping():
    """Two steps by hand: a gradient of norm 10 is cut to 5, decay comes after."""
    a = T.Adam(0.1, decay=0.5)
    v = a.step(np.array([1.0, -2.0]), np.array([6.0, 8.0]))
    g = np.array([3.0, 4.0]) + 0.5 * np.array([1.0, -2.0])
    assert v == pytest.approx(np.array([1.0, -2.0]) - 0.1 * g / (np.abs(g) + 1e-8), abs=1e-6)
    h = np.array([0.1, 0.2]) + 0.5 * v
    m, s = (0.9 * 0.1 * g + 0.1 * h) / (1 - 0.81), (0.999 * 0.001 * g**2 + 0.001 * h**2) / (1 - 0.999**2)
    assert a.step(v, np.array([0.1, 0.2])) == pytest.approx(v - 0.1 * m / (np.sqrt(s) + 1e-8))


def data(spark, n=120):
    r = np.random.default_rng(2)
    x, w = r.standard_normal((n, 6)), r.standard_normal((6, 3))
    rows = [(i, [float(v) for v in x[i]], [float(v) for v in np.tanh(x[i] @ w)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, [1.0] * 3), (n + 1, [float("nan")] * 6, [1.0] * 3)], "id long, x array<double>, y array<double>"), x, np.tanh(x @ w)


def test_training_is_the_same_for_any_partitions_and_learns(spark):
    df, x, y = data(spark)
    options = dict(hidden=8, epochs=4, batch=50, rate=0.02, seed=5)
    results = [T.train_student(df.repartition(p), df.limit(40), **options) for p in (1, 8)]
    for (w, b), (u, c) in zip(results[0][0], results[1][0]):
        assert w == pytest.approx(u, abs=1e-9) and b == pytest.approx(c, abs=1e-9)
    history = results[0][1].orderBy("epoch").collect()
    assert history[-1]["train_metric"] < 0.8 * history[0]["train_metric"] and [h["best_val_metric"] for h in history] == list(np.minimum.accumulate([h["val_metric"] for h in history]))
    # the same in plain numpy
    layers = T.first_layers((6, 8, 8, 3), 5)
    values, adam = T.flat(layers), T.Adam(0.02)
    for epoch in range(1, 5):
        order = sorted(range(120), key=lambda i: hashlib.md5(f"5:{epoch}:{i}".encode()).hexdigest())
        for k in range(0, 120, 50):
            at = order[k : k + 50]
            values = adam.step(values, T.sums_of(T.shaped(values, layers), x[at], y[at], 0.4)[2] / len(at))
    best = history[-1]["val_metric"] == min(h["val_metric"] for h in history)
    assert not best or T.flat(results[0][0]) == pytest.approx(values, abs=1e-9)
    out = {r["id"]: r["output"] for r in models.mlp(T.usable(df), "x", results[0][0]).collect()}
    assert len(out) == 120 and out[3] == pytest.approx(list(T.forward(results[0][0], x[3:4])[-1][0]))


@pytest.mark.parametrize("size", [2, 30, 7, 500])
def test_a_step_reads_the_partitions_of_its_batch_only(spark, monkeypatch, size):
    monkeypatch.setattr(T, "PART", 8)
    df, x, y = data(spark)
    layers = T.first_layers((6, 8, 8, 3), 5)
    packed, parts, together = T.laid_out(B.mini_batches(T.usable(df), size, "id", 5, 1), 120, size)
    order, seen = sorted(range(120), key=lambda i: hashlib.md5(f"5:1:{i}".encode()).hexdigest()), spark.sparkContext.accumulator(0)

    def counted(r):
        seen.add(r["n"])
        return r

    rdd = packed.persist().rdd.map(counted)
    for k in range(-(-120 // size)):
        at, before = order[k * size : (k + 1) * size], seen.value
        n, mse, cos, gradient = T.batch_sums(rdd, k, parts, together, layers, 0.4)
        m, c, g = T.sums_of(layers, x[at], y[at], 0.4)
        assert (n, mse, cos) == (len(at), pytest.approx(m / n), pytest.approx(c / n)) and gradient == pytest.approx(g / n, abs=1e-12)
        assert seen.value - before <= max(8, size)
    assert (parts, together) == {2: (1, 4), 7: (1, 1), 30: (4, 1), 500: (15, 1)}[size]
    packed.unpersist()


def test_nothing_to_train_on(spark):
    df = data(spark)[0]
    with pytest.raises(ValueError, match="usable rows"):
        T.train_student(df.where("x is null"), df, epochs=1)
    with pytest.raises(ValueError, match="widths"):
        T.train_student(df.unionByName(spark.createDataFrame([(1, [1.0], [1.0] * 3)], df.schema)), df, epochs=1)
