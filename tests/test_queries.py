import pytest

from wayframe.plans import bindings, ingest  # noqa: F401


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(name, spark, sf_dir, same_as_sql):
    if name in bindings.SQL:
        same_as_sql(bindings.QUERIES[name], bindings.SQL[name])
    else:
        assert bindings.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(bindings.QUERIES) <= set(e.queries())
    assert set(bindings.SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_plan_reads_only_what_it_needs(spark, sf_dir):
    plan = bindings.QUERIES["pending_records"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_whole_tables_enter(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    count = lambda name: bindings.QUERIES[name](spark, sf_dir).count()
    events = read("events")
    assert count("target_frame") == events.count() and count("prompt_records") == read("conversations").count()
    assert count("history_windows") == events.select("user_id").distinct().count()
    assert bindings.history_features(spark, sf_dir).selectExpr("sum(size(vector))").first()[0] == 16 * events.count()
    assert count("adapted_samples") == count("history_features")
    kinds = {r["doc_id"]: r["kind"] for r in bindings.coverage_classes(spark, sf_dir).collect()}
    assert {r["doc_id"] for r in read("documents").collect()} == {k for k, kind in kinds.items() if kind != "extra"}
    assert bindings.coverage_report(spark, sf_dir).first()["expected"] == read("documents").count()


def test_masked_pooling_as_its_sql_says(spark, tmp_path):
    """Halves, negative zeros, numbers and vectors that are null or short, ids that are null or repeated."""
    import duckdb
    import numpy as np

    r = np.random.default_rng(5)
    v = [float(x) for x in np.float32(r.standard_normal(64))]
    whole = [*(1e-6 * r.standard_normal((200, 64))), *(r.integers(-64, 64, (500, 64)) / 128), np.full(64, -0.0)]
    odd = [[None if i % 7 == 0 else x for i, x in enumerate(v)], None, [], v[:33], [None] * 64, [float("nan"), *v[1:]]]
    rows = [*enumerate([[float(x) for x in np.float32(w)] for w in whole] + odd), (-1, v), (-1, v[::-1]), (None, v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {r["vec_id"]: repr((list(r["mean"]), list(r["largest"]))) for r in bindings.QUERIES["masked_pooling"](spark, str(tmp_path)).collect()}
    want = {i: repr((list(m), list(x))) for i, m, x in con.sql(bindings.SQL["masked_pooling"]).fetchall()}
    assert "-0.0" in want[700] and got == want


def test_samples_of_followed_users_as_their_sql_says(spark, tmp_path):
    """Users below zero, over the borders of blocks, far apart, of one sample, and null ones, which follow nobody."""
    import duckdb

    users = [*range(-70, -55), *range(-3, 4), *range(55, 75), 127, 128, 134, 1000, None]
    rows = [(1000 * i + j, 60 * j, u, "view", float((7 * i + 13 * j) % 300)) for i, u in enumerate(users) for j in range(10 + 5 * (i % 3))]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    # the id of a vehicle is positive, which the SQL of retrieval_vectors does not ask
    for name, where in (("history_features", "true"), ("retrieval_vectors", "user_id > 0")):
        got = sorted((repr(r["user_id"]), r["sample"], r["vector"]) for r in bindings.QUERIES[name](spark, str(tmp_path)).where(where).collect())
        assert got == sorted((repr(u), s, v) for u, s, v in con.sql(f"select user_id, sample, vector from ({bindings.SQL[name]}) where {where}").fetchall())


def test_rules_read_what_is_made_once(spark, sf_dir):
    """Spark used to write the history into the filter on the error and again into each column that reads it."""
    plan = bindings.QUERIES["retrieval_vectors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", -10, 10)") == 2
