import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.llm import ngram_join, prefix_forest, quality_cnn
from wayframe.llm.components import components


def brute_classes(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups, copies):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        text = [word() for _ in range(r.randint(30, 120))]
        for _ in range(copies):
            t = [word() if r.random() < r.choice((0, 0.01, 0.03)) else w for w in text]
            if r.random() < 0.3:
                t += shared
            out.append(" ".join(t).upper() if r.random() < 0.3 else "  ".join(t))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("options", [{}, {"rounds": 0}, {"rounds": 3, "pivots": 1, "enough": 0}, {"rounds": 1, "share": 0.0001, "ranges": 3}, {"rounds": 0, "sample": 1}])
def test_classes_by_brute_force(spark, options):
    rows = near_copies(8, 12, 12) + [(1000, "a b c"), (1001, "A  b c"), (1002, ""), (1003, None), (1004, " \n")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_classes(rows)


def test_classes_of_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(documents).collect()}
    assert got == brute_classes(rows)


def test_classes_of_odd_rows(odd, empty):
    rows = ngram_join.join_classes(odd).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect()) and got[9] == got[10] == 9 and got[1] == 1 and got[None] is None
    assert sorted(r["n_shingles"] for r in rows if r["doc_id"] is None) == [0, 2] and len([r for r in rows if r["doc_id"] == 4]) == 2
    assert ngram_join.join_classes(empty).count() == 0


def test_repeated_ids_link_by_any_text(spark):
    long = [f"{w} " * 3 + " ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(1, "a b c d e f"), (1, "q r s t u v w"), (2, "a b c d e f"), (3, "q r s t u v w"), (3, "q r s t u v w"), (5, long[0]), (5, None), (4, long[0] + " end"), (9, long[1]), (9, long[2]), (8, long[2] + " end"), (7, long[1] + " end"), (6, long[3])]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 1), (1, 3, 1), (2, 2, 1), (3, 3, 1), (3, 3, 1), (4, 30, 4), (5, 0, 4), (5, 29, 4), (6, 29, 6), (7, 30, 7), (8, 30, 7), (9, 29, 7), (9, 29, 7)]


def test_many_copies_and_one_common_shingle(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = "one two three four five"
    rows = [(i, "a copy of one text that many have in common") for i in range(30_000)] + [(30_000 + i, f"{common} {word()} {word()}") for i in range(20_000)]
    rows += [(60_000 + i, f"{common} {'six seven eight nine ten'[: r.randint(3, 24)]}") for i in range(5_000)]
    start = time.time()
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), rounds=1).collect()}
    assert time.time() - start < 120 and len(got) == len(rows) and all(got[i] == 0 for i in range(30_000)) and got[30_000] == 30_000
    first = {t: i for i, t in reversed(rows)}
    want = brute_classes([(i, t) for t, i in first.items() if not 30_000 < i < 60_000])
    assert all(got[i] == (want[first[t]][1] if first[t] in want else i) for i, t in rows)


@pytest.mark.parametrize("remembered", [1 << 17, 1, 0])
@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_smallest_id_of_copies_over_batches(monkeypatch, remembered, order):
    """Over the batches of a task: representatives lead to the smallest id in two steps, and rows whose representative is another one are not entries."""
    monkeypatch.setattr(ngram_join, "REMEMBERED", remembered)
    r = np.random.default_rng(3)
    ids = {"up": np.arange(600), "down": np.arange(600)[::-1], "mixed": r.permutation(600)}[order]
    digest = r.integers(0, 9, 600).astype(np.uint64)
    size = np.where(digest == 8, 0, 5)
    seen, rep = {}, {}
    for at in range(0, 600, 40):
        b = slice(at, at + 40)
        i, n, one, two, first = ngram_join.equal_sets(ids[b], size[b], digest[b], digest[b] % np.uint64(2))
        rep |= dict(zip(i.tolist(), ngram_join.met_before(seen, i, n, one, two, first).tolist()))
    entries = [i for i in rep if rep[i] == i and size[ids == i][0] > 0]
    of = dict(zip(ids.tolist(), digest.tolist()))
    smallest = {d: min(i for i in of if of[i] == d) for d in range(8)}
    assert len(seen) <= remembered
    for i, d in of.items():
        assert rep[i] == i if d == 8 else of[rep[i]] == d and rep[i] <= i and rep[i] in entries
    assert all(s in entries for s in smallest.values())
    if remembered > 9 and order == "up":
        assert sorted(entries) == sorted(smallest.values())


@pytest.mark.parametrize("down", [False, True])
def test_one_text_over_many_batches(spark, down):
    """A long text on many rows of one task: one entry in its range where ids rise, and the smallest id whatever their order."""
    text = " ".join(f"w{i}" for i in range(2_000))
    rows = spark.range(0, 3_000, 1, 1).select((2_999 - F.col("id") if down else F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    made = ngram_join.packed(rows, 4, np.zeros(0, dtype=np.uint64)).where("id is not null")
    entries = made.agg(F.sum(F.length("id") / 8).cast("int")).first()[0]
    assert entries > 3 if down else entries == 1
    got = ngram_join.join_classes(rows).groupBy("n_shingles", "component_id").count().collect()
    assert [tuple(x) for x in got] == [(1_996, 0, 3_000)]


def test_more_shingles_than_sixteen_bits(spark):
    text = " ".join(f"w{i}" for i in range(70_004))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "a b c")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(df, ranges=1).collect()} == {1: (70_000, 1), 2: (70_001, 1), 3: (1, 3)}


def test_suffix_bound_never_drops():
    r = np.random.default_rng(0)
    for _ in range(2000):
        x, y = (np.unique(r.integers(0, 30, r.integers(0, 20))).astype(np.uint64) for _ in range(2))
        assert ngram_join.suffix_bound(x, y, len(np.intersect1d(x, y)))
        if len(x) and len(y):
            assert ngram_join.linked(x, y, 80) == (100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    assert {x["id"]: x["label"] for x in components(frame(edges)).collect()} == want
    half = components(frame(edges[:120]))
    assert {x["id"]: x["label"] for x in components(frame(edges[120:]), half).collect()} == want
    assert components(frame(edges).where("false")).count() == 0


def forest_recall(e, **options):
    """Recall of the 20 nearest against brute force, and the share of the candidates scored; ranks and scores are checked."""
    x = {r["vec_id"]: np.array(r["v"]) for r in e.collect()}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    got, queries = {}, e.where("vec_id % 20 = 0")
    for r in prefix_forest.nearest(e, queries, **options).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12) and r["rank"] == len(got[r["query_id"]])
    hits = 0
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, m @ x[q])
        hits += len(set(found) & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    n = sum(i % 20 == 0 for i in ids)
    assert len(got) == n
    scored = prefix_forest.nearest(e, queries, count_scored=True, **options).agg(F.sum("scored")).first()[0]
    return hits / (20 * n), scored / (n * len(ids))


def test_forest_recall_and_scores(spark):
    e = prefix_forest.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    for options in ({}, {"block": 512, "query_block": 30}):
        recall, share = forest_recall(e, **options)
        print("isotropic", options, recall, share)
        assert recall >= 0.9


def test_forest_on_clusters(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((150, 64))
    x = centres[r.integers(0, 150, 8_000)] + 0.15 * r.standard_normal((8_000, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    recall, share = forest_recall(prefix_forest.usable(rows), block=1024, query_block=64)
    print("clusters", recall, share)
    assert recall >= 0.9 and share < 0.15


def test_forest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5])]
    e = prefix_forest.usable(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in prefix_forest.nearest(e, e.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0), (20, 3, 2, -2.0)]
    assert prefix_forest.nearest(e.where("false"), e).count() == 0


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline as c

    kept, docs = [], documents
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        kept.append(rows)
        if name != c.STAGES[-1][0]:
            assert out.columns == documents.columns
            docs = spark.createDataFrame(rows, documents.schema)
    network = quality_cnn.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in quality_cnn.score_quality(documents, network).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept[0]} == good == {r["doc_id"] for r in kept[1]}
    classes = brute_classes([(r["doc_id"], r["text"]) for r in kept[1]])
    assert {r["doc_id"] for r in kept[2]} == {label for _, label in classes.values()}
    words = lambda r: len((r["text"] or "").split())
    assert sum(map(words, kept[3])) == pytest.approx(1.5 * sum(map(words, kept[2])), rel=0.1) and max(sum(x["doc_id"] == i for x in kept[3]) for i in {r["doc_id"] for r in kept[3]}) <= 2
    assert len(kept[4]) == len(kept[3]) and all(r["decoded_ok"] for r in kept[4])
    assert c.run(spark, sf_dir).count() == len(kept[4]) and c.ORACLE_SQL is None


def test_pipeline_on_odd_rows(spark, odd, sf_dir):
    """All five stages. What the first keeps is compared with its scores; the others get all odd rows, as so few rows train no network."""
    import corpus_pipeline as c

    docs = odd.select("doc_id", "text", "lang", "source", F.col("n_chars"))
    ids = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    kept = c.quality(spark, docs, sf_dir)
    network = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.columns == docs.columns and ids(kept.collect()) == ids(quality_cnn.score_quality(docs, network).where("predicted = 1").collect())
    assert c.quality(spark, docs.where("false"), sf_dir).count() == 0
    out = {}
    for name, stage in c.STAGES[1:]:
        df = stage(spark, docs, sf_dir)
        rows = df.collect()
        out[name], docs = rows, spark.createDataFrame(rows, df.schema)
    given = odd.collect()
    lined = {r["doc_id"]: r["text"] for r in out["line dedup"]}
    assert ids(out["line dedup"]) == ids(given) and lined[8] == "tie tie" and lined[9] == "a b" and lined[1] is None and lined[2] == ""
    one = ids(out["n-gram Jaccard join"])
    assert one == [i for i in ids(given) if i != "10"]
    mixed = out["mixing sources to target weights"]
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in out["n-gram Jaccard join"]}
    assert set(ids(mixed)) <= set(one) and not {"1", "2", "3"} & set(ids(mixed)) and all(ids(mixed).count(i) <= 2 * one.count(i) for i in one)
    assert sum(sizes[r["doc_id"]] for r in mixed) > 0
    tokens = out["SentencePiece encoding and decoding"]
    assert ids(tokens) == ids(mixed) and all(r["decoded_ok"] for r in tokens)
