"""Vectors in numpy files as a Spark data source: parts with ids and vectors, written in two phases, and the pair ids.npy and c.npy.

    spark.dataSource.register(ArraySource)
    spark.read.format("vectors").option("width", 30).load(path)

A reader checks what it loads: numbers of one kind, two dimensions, the width, as many ids as vectors, and that all numbers are finite.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import PartWriter, files_of, opened

SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
#: Rows of a pair of files that a task reads at once.
ROWS = 200_000


class Broken(ValueError):
    """A file whose content is not what it should be."""


@dataclass
class Part(InputPartition):
    """A file of a part, or the rows from start to end of a pair of files."""

    path: str
    start: int = 0
    end: int = -1


def npy_head(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the numbers of an .npy file."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1 or kind.hasobject:
        raise Broken("an array of objects, or stored by columns")
    return shape, kind, f.tell()


def checked(path: str, ids: np.ndarray, vectors: np.ndarray, width: int) -> None:
    if vectors.ndim != 2 or vectors.dtype.kind != "f" or ids.ndim != 1:
        raise Broken(f"{path}: ids of {ids.ndim} and vectors of {vectors.ndim} dimensions, {vectors.dtype}")
    if len(ids) != len(vectors):
        raise Broken(f"{path}: {len(ids)} ids for {len(vectors)} vectors")
    if width and vectors.shape[1] != width:
        raise Broken(f"{path}: vectors of width {vectors.shape[1]}, not {width}")
    if not np.isfinite(vectors).all():
        raise Broken(f"{path}: numbers that are not finite")


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"].rstrip("/"), int(options.get("width", 0))

    def partitions(self) -> list[Part]:
        names = [p for p, _ in files_of(self.path, ".npz")]
        pair = [p for p, _ in files_of(self.path, ".npy")]
        out = [Part(p) for p in names]
        if pair:
            if sorted(p.rsplit("/", 1)[1] for p in pair) != ["c.npy", "ids.npy"]:
                raise Broken(f"{self.path}: .npy files other than ids.npy and c.npy")
            system, at = opened(self.path)
            with system.open_input_file(f"{at}/c.npy") as f:
                shape = npy_head(f)[0]
            out += [Part(self.path, a, min(a + ROWS, shape[0])) for a in range(0, shape[0], ROWS)] if shape else [Part(self.path, 0, 0)]
        if not out:
            raise FileNotFoundError(f"no vectors in {self.path}")
        return out

    def rows_of(self, f, start: int, end: int) -> np.ndarray:
        """The rows from start to end of an .npy file."""
        shape, kind, at = npy_head(f)
        size = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
        f.seek(at + start * size)
        count = min(end, shape[0]) - start
        raw = f.read(count * size)
        if len(raw) < count * size:
            raise Broken(f"{self.path}: the file ends early")
        return np.frombuffer(raw, dtype=kind).reshape(count, *shape[1:])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, at = opened(partition.path)
        if partition.end < 0:
            with system.open_input_file(at) as f:
                try:
                    with np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
                        ids, vectors = z["ids"], z["c"]
                except Exception as e:
                    raise Broken(f"{partition.path}: {e}") from e
        else:
            with system.open_input_file(f"{at}/ids.npy") as f, system.open_input_file(f"{at}/c.npy") as g:
                if npy_head(f)[0][:1] != npy_head(g)[0][:1]:
                    raise Broken(f"{self.path}: ids and vectors differ in number")
                f.seek(0), g.seek(0)
                ids, vectors = self.rows_of(f, partition.start, partition.end), self.rows_of(g, partition.start, partition.end)
        checked(partition.path, ids, vectors, self.width)
        for a in range(0, len(ids), 10_000):
            part = vectors[a : a + 10_000].astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids[a : a + 10_000].tolist()]), lists], names=["sample_id", "vector"])


class ArrayWriter(PartWriter):
    """Files of a part with ids and vectors, and summary.json with their numbers once all are published."""

    suffix = ".npz"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.width = int(options.get("width", 0))

    def encode(self, batches: Iterator[pa.RecordBatch]) -> tuple[bytes, dict] | None:
        ids, parts = [], []
        for b in batches:
            ids += b.column("sample_id").to_pylist()
            vectors = [np.array(v, dtype=np.float32) for v in b.column("vector").to_pylist()]
            if any(v.ndim != 1 or len(v) != len(vectors[0]) for v in vectors):
                raise Broken("vectors of several widths")
            parts += [np.stack(vectors)] if vectors else []
        if not ids:
            return None
        whole = np.concatenate(parts)
        checked("rows to write", np.array(ids), whole, self.width)
        out = io.BytesIO()
        np.savez(out, ids=np.array(ids, dtype=np.str_), c=whole)
        return out.getvalue(), {"rows": len(ids), "width": whole.shape[1]}

    def finish(self, facts: list[dict]) -> dict[str, bytes]:
        widths = sorted({f["width"] for f in facts})
        if len(widths) > 1:
            raise Broken(f"vectors of widths {widths}")
        return {"summary.json": json.dumps({"parsed": sum(f["rows"] for f in facts), "parts": len(facts), "c_dim": widths[0] if widths else None}, indent=2).encode()}


class ArraySource(DataSource):
    """Format "vectors". Option: width, which all vectors must have."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), overwrite)


def write_arrays(rows: DataFrame, path: str, width: int = 0, overwrite: bool = False) -> None:
    """(sample_id, vector) as files of parts, published together. Vectors of several widths or with numbers that are not finite are refused, and then nothing
    is published."""
    rows.sparkSession.dataSource.register(ArraySource)
    given = rows.select(rows["sample_id"].cast("string").alias("sample_id"), rows["vector"].cast("array<float>").alias("vector"))
    given.write.format("vectors").mode("overwrite" if overwrite else "append").option("width", width).save(path)


def read_arrays(spark: SparkSession, path: str, width: int = 0) -> DataFrame:
    """(sample_id, vector) of files that write_arrays made, or of ids.npy and c.npy, by ranges of rows. Broken files are an error."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("vectors").option("width", width).load(path)


def put_json(path: str, value: dict) -> None:
    """A small JSON file, as a summary or vocabulary."""
    system, at = opened(path)
    system.create_dir(at.rsplit("/", 1)[0])
    with system.open_output_stream(at) as out:
        out.write(json.dumps(value, ensure_ascii=False, indent=2).encode("utf-8"))


