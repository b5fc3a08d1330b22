import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.operators import samples
from wayframe.sources import io, lines, mat

# --- a writer of MATLAB files for the tests, byte by byte, apart from that of the library


def element(kind, data, order="<", small=True):
    if small and 0 < len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(content, order="<", name=b"", kind=6, shape=None):
    head = element(6, struct.pack(order + "II", kind, 0), order) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name, order)
    return element(14, head + content, order, small=False)


def doubles(v, order="<", name=b"", stored=9):
    """A matrix of doubles, stored as given: 9 doubles, 2 bytes, 3 signed shorts."""
    m = np.atleast_2d(np.array(v, dtype=float))
    return matrix(element(stored, m.astype({9: "f8", 2: "u1", 3: "i2"}[stored]).astype(np.dtype({9: "f8", 2: "u1", 3: "i2"}[stored]).newbyteorder(order)).tobytes(order="F"), order), order, name, 6, m.shape)


def chars(text, order="<", name=b"", kind=17):
    data = text.encode({16: "utf-8", 17: {"<": "utf-16-le", ">": "utf-16-be"}[order]}[kind])
    return matrix(element(kind, data, order), order, name, 4, (1, len(text)))


def structs(rows, order="<", name=b"", shape=None):
    names = list(rows[0])
    labels = b"".join(n.encode().ljust(32, b"\0") for n in names)
    fields = element(5, struct.pack(order + "i", 32), order) + element(1, labels, order)
    return matrix(fields + b"".join(r[n] for r in rows for n in names), order, name, 2, shape or (1, len(rows)))


def cells(items, order="<", name=b""):
    return matrix(b"".join(items), order, name, 1, (len(items), 1))


def mat_file(*variables, order="<", compress=False):
    if compress:
        variables = [struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, variables)]
    return b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack(order + "H", 0x0100) + {"<": b"IM", ">": b"MI"}[order] + b"".join(variables)


def sample(i, order="<"):
    m = [[i + r, 10 * r + 0.5] for r in range(3)]
    ctx = structs([{"ego": doubles(m, order), "phys_tl": doubles(np.zeros((0, 0)), order)}], order)
    return {
        "traj_id": doubles(i, order, stored=2), "lane_status": cells([cells([doubles(i % 3, order)], order)], order), "x_hist": doubles(m, order),
        "name": chars(f"sé-{i}", order), "ctx": ctx, "y_future": doubles([[9999.0, i]], order, stored=3), "skipped": doubles(np.arange(500), order),
    }


SCHEMA = "traj_id double, lane_status int, x_hist array<array<double>>, name string, ctx struct<ego: array<array<double>>, phys_tl: array<array<double>>, none: double>, absent string"


def wanted(i):
    m = [[float(i + r), 10 * r + 0.5] for r in range(3)]
    return (float(i), i % 3, m, f"sé-{i}", (m, None, None), None)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("partition_bytes", [1 << 20, 3000])
def test_mat_structs_by_ranges(spark, tmp_path, order, compress, partition_bytes):
    rows = [sample(i, order) for i in range(40)]
    other = doubles(np.arange(2000), order, b"other")
    (tmp_path / "a.mat").write_bytes(mat_file(other, structs(rows, order, b"samples", (4, 10)), doubles(1, order, b"last"), order=order, compress=compress))
    df = mat.read_mat(spark, str(tmp_path / "a.mat"), SCHEMA, "samples", partition_bytes=partition_bytes)
    got = sorted((r[mat.PLACE], tuple(r)[:-2]) for r in df.collect())
    assert got == [(i, wanted(i)) for i in range(40)]
    assert partition_bytes > 3000 or df.rdd.getNumPartitions() > 1


def test_mat_keys(spark, tmp_path):
    a, b = structs([sample(i) for i in range(3)], name=b"first"), structs([sample(7)], name=b"second")
    (tmp_path / "two.mat").write_bytes(mat_file(a, b))
    (tmp_path / "one.mat").write_bytes(mat_file(b, compress=True))
    read = lambda name, **o: [r["traj_id"] for r in mat.read_mat(spark, str(tmp_path / name), SCHEMA, **o).orderBy(mat.PLACE).collect()]
    assert read("two.mat", key="second") == [7.0] and read("one.mat") == [7.0] and read("two.mat", key="none", missing_key="first") == [0.0, 1.0, 2.0]
    with pytest.raises(Exception, match="no variable samples; it has \\['first', 'second'\\]"):
        read("two.mat", key="samples")
    with pytest.raises(Exception, match="name one of the variables"):
        read("two.mat")
    with pytest.raises(Exception, match="FileNotFoundError|not found|no .mat"):
        read("three.mat", key="x")
    with pytest.raises(Exception, match="neither structs nor cells"):
        (tmp_path / "numbers.mat").write_bytes(mat_file(doubles([1, 2], name=b"x")))
        read("numbers.mat", key="x")
    with pytest.raises(Exception, match="level 5"):
        (tmp_path / "bad.mat").write_bytes(b"x" * 200)
        read("bad.mat", key="x")
    with pytest.raises(Exception, match="ends within"):
        (tmp_path / "cut.mat").write_bytes(mat_file(a)[:900])
        read("cut.mat", key="first")


def test_mat_limit_is_ordered_and_fields_are_chosen(spark, tmp_path):
    for k, name in enumerate(("b", "a", "c")):
        (tmp_path / f"{name}.mat").write_bytes(mat_file(structs([sample(10 * k + i) for i in range(10)], name=b"s"), compress=k == 1))
    read = lambda limit: [r["traj_id"] for r in mat.read_mat(spark, str(tmp_path), "traj_id double", "s", limit=limit, partition_bytes=2000).collect()]
    assert read(13) == [10.0 + i for i in range(10)] + [0.0, 1.0, 2.0] and len(read(0)) == 30 and len(read(99)) == 30
    decoded = []
    reader = mat.MatReader(mat.T.StructType([mat.T.StructField("traj_id", mat.T.DoubleType())]), {"path": str(tmp_path / "a.mat"), "key": "s"})
    real = mat.Decoder.value
    try:
        mat.Decoder.value = lambda self, raw, kind: decoded.append(1) or real(self, raw, kind)
        (part,) = reader.partitions()
        reader.schema = mat.T.StructType([*reader.schema.fields, mat.T.StructField(mat.FILE, mat.T.StringType()), mat.T.StructField(mat.PLACE, mat.T.LongType())])
        assert sum(b.num_rows for b in reader.read(part)) == 10 and len(decoded) == 10
    finally:
        mat.Decoder.value = real


def test_mat_values_of_odd_kinds(spark, tmp_path):
    row = {
        "n": doubles([[float("nan")]]), "i": doubles([[2.0]]), "t": chars("text", kind=16), "bytes": matrix(element(2, "é".encode()), kind=9, shape=(1, 2)), "id": doubles([[12.0]]), "half": doubles([[1.5]]),
        "many": doubles([[1.0, 2.0]]), "none": element(14, b"", small=False), "list": cells([structs([{"a": doubles([[1.0]])}]), structs([{"a": doubles([[2.0]])}])]), "flag": doubles([[1.0]], stored=2),
        "grid": matrix(element(17, "abcdef".encode("utf-16-le")), kind=4, shape=(2, 3)), "map": structs([{"x": doubles([[1.0, 2.0]]), "y": chars("no")}]), "column": doubles([[1.0], [2.0], [3.0]]),
    }
    (tmp_path / "odd.mat").write_bytes(mat_file(cells([structs([row]), doubles([[5.0]])], name=b"s")))
    schema = "n double, i long, t string, bytes string, id string, half string, many double, none string, list array<struct<a: double>>, flag boolean, grid string, map map<string, array<array<double>>>, column array<long>"
    first, second = mat.read_mat(spark, str(tmp_path / "odd.mat"), schema).orderBy(mat.PLACE).collect()
    assert math.isnan(first["n"]) and tuple(first)[1:-2] == (2, "text", "é", "12", "1.5", None, None, [(1.0,), (2.0,)], True, "acebdf", {"x": [[1.0, 2.0]], "y": None}, [1, 2, 3])
    assert tuple(second)[:-2] == (None,) * 13


def test_mat_round_trip_into_adapted_samples(spark, tmp_path):
    steps, ego = 10, [[float(v) for v in (7, 4, 100 + t, t, 0, 2, 2, *[0] * 9, 10, 0, 0)] for t in range(10)]
    hist = [[float(v) for v in (t, 0, 10, 0, 0, 0)] for t in range(steps)]
    lead = [[float(v) for v in (11, 3, t + 12, 3, 8, 0, 0, 0)] for t in range(steps)]
    rows = [(5.0, float(i), 1.0, -1.0, hist, (ego, lead, None, None, None, None, None), [[float(i), 1.0]] * 50) for i in range(30)]
    raw = spark.createDataFrame(rows, samples.RAW)
    for compress in (True, False):
        path = str(tmp_path / f"out-{compress}")
        mat.write_mat(raw.repartition(3), path, compress=compress)
        back = mat.read_mat(spark, path, samples.RAW, "samples").drop(mat.FILE, mat.PLACE)
        assert sorted(map(str, back.collect())) == sorted(map(str, raw.collect()))
        made = samples.adapted(back)
        assert {r["error"] for r in made.select("error").collect()} == {None} and made.select("sample_id").distinct().count() == 30
    with pytest.raises(Exception, match="FileExists|exists"):
        mat.write_mat(raw, path)
    mat.write_mat(raw.limit(4).coalesce(1), path, overwrite=True)
    assert mat.read_mat(spark, path, "traj_id double", "samples").count() == 4


def test_failed_parts_leave_nothing(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 50, F.raise_error(F.lit("broken row"))).otherwise("x").alias("x"))
    with pytest.raises(Exception, match="broken row"):
        mat.write_mat(rows, str(path))
    assert not path.exists() or list(path.iterdir()) == []


# --- lines


def written(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def plain_lines(files):
    return [(name, k, line) for name in sorted(files) for k, line in enumerate(files[name].splitlines(), 1)]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_numbers_of_lines_in_many_splits(spark, tmp_path, size):
    r = np.random.default_rng(1)
    files = {f"{n}.jsonl": "\n".join("x" * int(k) if k % 5 else " " * int(k % 3) for k in r.integers(1, 60, 200)) + "\n" * (n == "b") for n in "cab"}
    path, everything = written(tmp_path, files), plain_lines(files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert size > 64 or lines.numbered_lines(spark, path).select("_file").rdd.getNumPartitions() > 0 and spark.read.text(path).rdd.getNumPartitions() > 20
        for limit in (None, 1, 7, 160, 161, 10_000):
            got = sorted((r["_overall"], r["_file"].rsplit("/", 1)[1], r["_line"], r["value"]) for r in lines.numbered_lines(spark, path, limit).collect())
            want = [(i, name, k, text) for i, (name, k, text) in enumerate(everything, 1) if text.strip()][:limit]
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_fault_is_named_by_line(spark, tmp_path):
    schema = mat.T.StructType([mat.T.StructField("sample_id", mat.T.StringType()), mat.T.StructField("n", mat.T.LongType())])
    good = "\n".join(f'{{"sample_id": "s{i}", "n": {i}}}' for i in range(500))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cases = {
        "ok": ("", None), "json": ('\n\n{"sample_id": "x", "n": \n{"sample_id": " "}', "a.jsonl:502: json"), "key": ('\n{"n": 3}\nbad', "a.jsonl:501: key"),
        "repeated": ('\n{"sample_id": "t"}\n{"sample_id": "s7"}\nbad', "a.jsonl:502: repeated"), "list": ("\n[1]", None),
    }
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
        for name, (more, error) in cases.items():
            (tmp_path / name).mkdir()
            path = written(tmp_path / name, {"a.jsonl": good + more})
            rows = lines.read_jsonl(spark, path, schema)
            if error:
                with pytest.raises(ValueError, match=error):
                    lines.valid_jsonl(rows)
                with pytest.raises(ValueError, match=error):
                    lines.resume_ids(spark, path)
            assert lines.valid_jsonl(lines.read_jsonl(spark, path, schema, limit=500)).count() == 500
        assert lines.resume_ids(spark, str(tmp_path / "ok")).count() == 500 and lines.resume_ids(spark, str(tmp_path / "absent")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no lines"):
        lines.valid_jsonl(lines.read_jsonl(spark, written(tmp_path / "empty", {"a.jsonl": "\n \n"}), schema))


def test_no_number_that_is_not_finite_is_written(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    kind = "sample_id string, a array<struct<x: double, y: struct<z: float>>>, b array<array<double>>, m map<string, array<double>>, s struct<t: string, d: double>"
    good = [("p", [(1.0, (2.0,)), None], [[1.0], None, [None]], {"k": [1.0, None]}, ("t", 1.0)), ("q", None, None, None, None), ("r", [(None, None)], [], {}, (None, None))]
    io.write_jsonl(spark.createDataFrame(good, kind), str(tmp_path / "good"))
    for bad in ([(nan, (2.0,))], None, None, None), ([(1.0, (inf,))], None, None, None), (None, [[1.0], [-inf]], None, None), (None, None, {"k": [nan]}, None), (None, None, None, ("t", nan)):
        with pytest.raises(ValueError, match="finite"):
            io.write_jsonl(spark.createDataFrame([*good, ("z", *bad)], kind), str(tmp_path / "bad"))
