import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.llm import middle_fill, period_runs, shuffle_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- shards


def in_order(df, **options):
    rows = shuffle_shards.places(df, **options).orderBy("shard", "slot").collect()
    return [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows]


def check_shards(docs, got, shards=8):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter(r[:3] for r in got) == want
    counts = Counter(r[3] for r in got)
    assert all(0 <= s < shards for s in counts) and max(counts.get(s, 0) for s in range(shards)) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert [r[4] for r in got if r[3] == s] == list(range(counts[s]))


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 100_000}, {"bucket_bytes": 999, "seed": 7, "shards": 3}])
def test_shards_hold_all_rows_evenly(spark, documents, options):
    docs = documents.select("doc_id", "text")
    got = in_order(docs, **options)
    check_shards(docs.collect(), got, options.get("shards", 8))
    assert in_order(docs.repartition(7), **options) == got
    other = in_order(docs, **(options | {"seed": 1234}))
    assert [r[0] for r in other] != [r[0] for r in got] and Counter(r[0] for r in other) == Counter(r[0] for r in got)


def test_shards_by_brute_force(spark, documents):
    """The whole method again in plain Python, on the records' hashes as Spark gives them."""
    import xxhash

    docs = documents.select("doc_id", "text")
    rows = shuffle_shards.records(docs, seed=5).collect()
    n_buckets = -(-sum(r["size"] for r in rows) // 50_000)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    buckets = {}
    for r in rows:
        key = xxhash.xxh64_intdigest((5).to_bytes(4, "little"), 42)
        for v in (r["__a"], r["__b"], r["__nth"]):
            key = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), key)
        assert signed(key) == r["__key"]
        buckets.setdefault(r["__key"] % n_buckets, []).append((r["__key"], r["doc_id"]))
    order = []
    for b in sorted(buckets):
        held = sorted(buckets[b])
        place = np.arange(len(held))
        np.random.default_rng([5, b]).shuffle(place)
        order += [d for _, (_, d) in sorted(zip(place.tolist(), held))]
    assert [r[0] for r in in_order(docs, seed=5, bucket_bytes=50_000)] == order


def test_shards_scatter_repeated_rows_and_hot_keys(spark):
    rows = [(7, "the same row")] * 12_000 + [(i, "one text of many") for i in range(100, 6_100)] + [(i, f"text {i}") for i in range(10_000, 16_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = shuffle_shards.places(df, bucket_bytes=20_000)
    sizes = [r["count"] for r in placed.groupBy("__bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1.3 * 24_000 / len(sizes)
    got = in_order(df, bucket_bytes=20_000)
    check_shards(df.collect(), got)
    # each kind is spread over the shards as chance would have it
    for kind in (lambda d: d == 7, lambda d: 100 <= d < 6_100):
        per = Counter(s for d, _, _, s, _ in got if kind(d))
        mean = sum(per.values()) / 8
        assert all(abs(per[s] - mean) < 6 * mean**0.5 for s in range(8))


def test_shards_of_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text")
    check_shards(docs.collect(), in_order(docs))
    assert in_order(empty) == []
    whole = shuffle_shards.shard_rows(odd.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))))
    assert [c for c in whole.columns if c not in odd.columns] == ["m", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter(whole.select("doc_id", "text", "lang").collect()) == Counter(odd.select("doc_id", "text", "lang").collect())


def test_written_shards(spark, documents, tmp_path):
    docs = documents.unionByName(documents.limit(30)).unionByName(documents.limit(30))
    shuffle_shards.write_shards(docs, str(tmp_path / "a"), bucket_bytes=100_000)
    shuffle_shards.write_shards(docs.repartition(3), str(tmp_path / "b"), bucket_bytes=100_000)
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == docs.count()
    assert sorted(map(str, a.select(*documents.columns).collect())) == sorted(map(str, docs.collect()))
    for k in range(8):
        slots = [r["slot"] for r in spark.read.parquet(str(tmp_path / "a" / f"shard={k}")).coalesce(1).collect()]
        assert slots == list(range(len(slots)))


# --- runs


def brute_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [r.choice("abcdefg"[: r.choice([1, 2, 3, 5, 7])]) for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            a, p = r.randrange(len(w) + 1), r.randint(1, 1 + len(w) // 4)
            w[a:a] = (w[a : a + p] or ["z"]) * r.randint(2, 7)
        out.append(r.choice([" ", "\n", "\t  "]).join(w))
    return out


def check_collapsed(text, n, runs, collapsed, **options):
    w = WORD.findall(text or "")
    want = brute_runs(w, **options)
    gone = {x for s, size, q in want for x in range(s + q, s + size)}
    assert (n, runs, collapsed) == (len(w), want, " ".join(x for i, x in enumerate(w) if i not in gone))


def test_cover_has_every_difference():
    assert all(any((a - b) % period_runs.MODULUS == d for a in period_runs.COVER for b in period_runs.COVER) for d in range(period_runs.MODULUS))


def test_extensions_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(40):
        w = np.r_[np.tile(r.integers(1, 4, r.integers(1, 90)), r.integers(1, 9)), r.integers(1, 3, r.integers(1, 200))]
        x = period_runs.Extensions(w, len(w))
        i, j = r.integers(0, len(w), 300), r.integers(0, len(w), 300)
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k])) for a, b in zip(i, j)]
        assert x(i, j).tolist() == want


@pytest.mark.parametrize("options", [{}, {"exponent": 2, "least": 2}, {"exponent": 3, "least": 1}])
def test_runs_by_brute_force(options):
    r = random.Random(2)
    for seed in range(30):
        texts = random_texts(seed, r.randint(1, 9))
        for text, row in zip(texts, period_runs.batch_runs(texts, **options)):
            check_collapsed(text, *row, **options)


def test_runs_of_long_texts_take_linear_room():
    text = "a b c " * 100_000 + " ".join(map(str, range(100_000)))
    assert period_runs.batch_runs(["x", text, None])[1][1] == [(0, 300_000, 3)]


def test_runs_of_odd_rows(odd, empty, documents):
    for docs in (odd, documents):
        got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in period_runs.periodic_runs(docs).collect()), key=str)
        assert len(got) == docs.count()
        texts = {}
        for r in docs.collect():
            texts.setdefault(r["doc_id"], set()).add(r["text"])
        for doc_id, *row in got:
            if len(texts[doc_id]) == 1 and row[0] < 5_000:
                check_collapsed(next(iter(texts[doc_id])), *row)
    assert period_runs.periodic_runs(empty).count() == 0


def test_query_of_runs(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in period_runs.op12_period_runs(spark, sf_dir).collect()}
    assert len(got) == documents.count()
    planted = 0
    for r in documents.collect():
        w = WORD.findall(r["text"] or "")
        n, (g, rest) = len(w), divmod(zlib.crc32(str(r["doc_id"]).encode()), 10)
        if rest == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        if n > 3_000:
            continue
        runs = brute_runs(w)
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        gone = {x for s, size, q in runs for x in range(s + q, s + size)}
        want = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        x = got[r["doc_id"]]
        assert (x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"]) == want
        assert x["runs_sha256"] == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)) and x["collapsed_sha256"] == sha(" ".join(v for i, v in enumerate(w) if i not in gone))
    assert planted


def test_planting_of_odd_rows(odd, empty):
    assert period_runs.planted(odd).count() == odd.count() and period_runs.planted(empty).count() == 0
    assert {r["text"] for r in period_runs.planted(odd).where("doc_id is null").collect()} == {r["text"] for r in odd.where("doc_id is null").collect()}


# --- middles


def test_boundaries_by_brute_force():
    r = random.Random(5)
    kinds = set()
    for t in range(120):
        top = r.choice([10, 5_000, 70_000, 300_000])
        offsets = {r.randrange(top * r.choice([1, 3])) for _ in range(r.choice([1, 5, top // 2]))}
        if t % 3 == 0:
            offsets |= set(range(1_000, 1_000 + r.randint(1, 150_000)))
        offsets = np.array(sorted(offsets))
        b = middle_fill.Boundaries(offsets)
        kinds |= {c[0] for c in b.containers}
        assert len(b) == len(offsets)
        assert all(b.select(k) == offsets[k] for k in [0, len(offsets) - 1, *(r.randrange(len(offsets)) for _ in range(20))])
    assert kinds == {middle_fill.ARRAY, middle_fill.BITMAP, middle_fill.RUNS}


def test_unit_ends_by_pattern():
    r = random.Random(6)
    unit = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    for _ in range(500):
        t = "".join(r.choice("ab \n\té😀 ") for _ in range(r.randint(0, 30)))
        assert middle_fill.unit_ends(t).tolist() == [m.end() for m in unit.finditer(t)]
        assert middle_fill.unit_ends(t, "chars").tolist() == list(range(1, len(t) + 1))


def plain_cut(text, doc_id):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    key, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h1, h2, h3, h4 = (int(key[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_of_odd_rows(spark, odd, empty):
    more = spark.createDataFrame([(i, t) for i in range(20, 60) for t in ("<", "<P", "S> <S a<M b>", "a <P> b", "<S", "x <S <M> y", " lead trail ", "long " * 30_000)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = middle_fill.fill_in_middle(docs, keep=("doc_id", "text")).withColumn("back", middle_fill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count() and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_cut(r["text"] or "", r["doc_id"]) and r["back"] == (r["text"] or "")
    assert middle_fill.fill_in_middle(empty).count() == 0
    chars = middle_fill.fill_in_middle(docs, units="chars", rate=100, spm=0, keep=("text", "doc_id")).withColumn("back", middle_fill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") and r["n"] == len(r["text"] or "") for r in chars)
    clash = odd.withColumn("n", F.lit("x")).withColumn("form", F.lit("y"))
    assert middle_fill.fill_in_middle(clash).columns == ["doc_id", *middle_fill.RESULT]
