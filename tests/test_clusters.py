import numpy as np
import pytest

from wayframe.operators import clusters as C
from wayframe.plans import bindings


def framed(spark, p, parts=3):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double").repartition(parts)


def groups(seed=7, k=6, n=200):
    r = np.random.default_rng(seed)
    centres = r.uniform(-40, 40, (k, 2))
    return centres, np.concatenate([c + 0.1 * r.standard_normal((n, 2)) for c in centres])


def plain_step(p, c):
    d = ((p[:, None] - c) ** 2).sum(2)
    at = d.argmin(1)
    means, far = c.copy(), sorted(((d[at == j].min(1).max(), j) for j in set(at)), reverse=True)
    for j in range(len(c)):
        if (at == j).any():
            means[j] = p[at == j].mean(0)
    for j, (_, of) in zip([j for j in range(len(c)) if not (at == j).any()], far):
        mine = np.flatnonzero(at == of)
        means[j] = p[mine[d[mine].min(1).argmax()]]
    return means, d.min(1).sum()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 20000])
def test_nearest_is_that_of_all_centres_and_few_are_compared(n, monkeypatch):
    r = np.random.default_rng(n)
    for p in (r.standard_normal((n, 2)), r.integers(-3, 4, (n, 2)).astype(float), np.full((n, 2), 7.0)):
        for c in (r.standard_normal((64, 2)), r.integers(-3, 4, (200, 2)).astype(float), np.array([[1e9, 0.0]])):
            d = (p[:, :1] - c[:, 0]) ** 2 + (p[:, 1:] - c[:, 1]) ** 2
            at, d2 = C.nearest(p, c)
            assert at.tolist() == d.argmin(1).tolist() and d2.tolist() == d.min(1).tolist()
    if n == 20000:
        compared, put = [], np.copyto
        monkeypatch.setattr(C.np, "copyto", lambda to, v, where: (compared.append(where.size), put(to, v, where=where)))
        C.nearest(r.standard_normal((n, 2)), r.standard_normal((64, 2)))
        assert sum(compared) / 2 < n * 64 / 3


def test_rounds_of_all_starts_by_brute_force(spark):
    _, p = groups()
    r = np.random.default_rng(0)
    starts = [r.uniform(-40, 40, (k, 2)) for k in (6, 6, 9)] + [np.array([[0.0, 0.0], [500.0, 500.0], [600.0, 0.0]])]
    points = C.usable(framed(spark, p))
    for _ in range(4):
        new, cost = C.moved(points, starts)
        for s, c, got in zip(starts, cost, new):
            want, total = plain_step(p, s)
            assert got == pytest.approx(want, abs=1e-9) and c == pytest.approx(total)
        starts = new


def test_one_job_a_round_and_the_same_result_for_any_partitioning(spark):
    _, p = groups()
    starts = [p[[0, 1, 2, 3, 4, 5]], p[[0, 250, 450, 650, 850, 1100]]]
    a = C.lloyd_starts(C.usable(framed(spark, p, 1)), starts, rounds=25)
    b = C.lloyd_starts(C.usable(framed(spark, p, 8)), starts, rounds=25)
    assert a[2] == b[2] <= 26 and all(x == pytest.approx(y, abs=1e-6) for x, y in zip(a[0], b[0])) and a[1] == pytest.approx(b[1])
    assert len(C.lloyd_starts(C.usable(framed(spark, p)), starts, rounds=2)[0]) == 2


def test_anchors_recover_groups(spark):
    centres, p = groups(k=8)
    found, cost = C.anchors(framed(spark, p), 8, starts=5, rounds=30)
    got = np.array([(r["x"], r["y"]) for r in found.collect()])
    assert all(np.sqrt(((got - c) ** 2).sum(1)).min() < 0.08 for c in centres) and cost == pytest.approx(C.inertia(framed(spark, p), found))
    again = C.anchors(framed(spark, p, 7), 8, starts=5, rounds=30)[0]
    assert np.array([(r["x"], r["y"]) for r in again.collect()]) == pytest.approx(got, abs=1e-6)


def test_seeds_are_points_that_differ_and_do_not_depend_on_partitions(spark):
    _, p = groups(k=5, n=40)
    p = np.concatenate([p, p, p[:1].repeat(300, 0)])
    a, b = (C.seeded(C.usable(framed(spark, p, n)), 12, 4, seed=3) for n in (1, 6))
    for x, y in zip(a, b):
        assert x == pytest.approx(y) and len({tuple(v) for v in x}) == 12 and {tuple(v) for v in x} <= {tuple(v) for v in p}
    assert len({tuple(map(tuple, x)) for x in a}) == 4
    assert len(C.seeded(C.usable(framed(spark, p[:1].repeat(9, 0))), 3, 1)[0]) == 1


def test_odd_points(spark):
    nan = float("nan")
    rows = [(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 0.0), (4, 1.0, float("inf")), (None, 4.0, 0.0), (1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert C.usable(df).count() == 3
    found, cost = C.anchors(df, 2, starts=2)
    assert sorted(r["x"] for r in found.collect()) == [0.0, 4.0] and cost == 0
    with pytest.raises(ValueError, match="fewer than 3"):
        C.anchors(df, 3)
    with pytest.raises(ValueError, match="fewer"):
        C.anchors(df.where("false"), 1)


def test_query_finds_less_cost_than_its_first_points(spark, sf_dir):
    got = bindings.anchors_kmeans(spark, sf_dir).collect()
    step = bindings.lloyd_step(spark, sf_dir).collect()
    assert len(got) == 64 and sum(r["n"] for r in got) == sum(r["n"] for r in step) and sum(r["cost"] for r in got) < sum(r["cost"] for r in step)
