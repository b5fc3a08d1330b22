"""MATLAB files (level 5) as a Spark data source: struct arrays to rows of a schema, read by ranges of elements, and back.

    spark.dataSource.register(MatSource)
    spark.read.format("mat").schema(RAW).option("key", "samples").load(path)

The format is public: a header of 128 bytes, then elements of a type, a size and data, compressed ones as zlib streams. A task reads one range of the elements
of one file: it passes over what comes before by the sizes alone, and decodes only the fields that the schema has.
`read_mat` and `write_mat` wrap the source.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import PartWriter, files_of, opened

#: Fixed values of the format: types of data elements as numpy types, and classes of arrays.
STORED = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
CELL, STRUCT, CHAR, DOUBLE = 1, 2, 4, 6
NUMBERS = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
#: Columns that a schema may name besides fields: the file, and the place of the element in it, from 0.
FILE, PLACE = "_file", "_pos"


class Inflated(io.RawIOBase):
    """A zlib stream of a file, read forward as it is needed."""

    def __init__(self, source: BinaryIO, size: int):
        self.source, self.left, self.unzip, self.held = source, size, zlib.decompressobj(), b""

    def read(self, n: int = -1) -> bytes:
        parts, got = [self.held], len(self.held)
        while got < n and (self.left or self.unzip.unconsumed_tail):
            raw = self.unzip.unconsumed_tail
            if not raw:
                raw = self.source.read(min(self.left, 1 << 16))
                if not raw:
                    break
                self.left -= len(raw)
            parts.append(self.unzip.decompress(raw, max(1 << 16, n - got)))
            got += len(parts[-1])
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.read(min(n, 1 << 20))) or n


class Plain:
    """A file, or bytes, read forward with skips that read nothing."""

    def __init__(self, source: BinaryIO):
        self.source = source

    def read(self, n: int) -> bytes:
        return self.source.read(n)

    def skip(self, n: int) -> None:
        self.source.seek(n, io.SEEK_CUR)


@dataclass
class Head:
    """What stands before the content of an array."""

    kind: int
    shape: tuple[int, ...]
    name: str
    fields: tuple[str, ...]
    taken: int

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))


class Decoder:
    def __init__(self, order: str):
        self.order = order

    def tag(self, s) -> tuple[int, int, bytes | None, int]:
        """(type, size, data of a small element or None, bytes taken)."""
        raw = s.read(8)
        if len(raw) < 8:
            raise EOFError("the file ends within an element")
        kind, size = struct.unpack(self.order + "II", raw)
        if kind >> 16:
            return kind & 0xFFFF, kind >> 16, raw[4 : 4 + (kind >> 16)], 8
        return kind, size, None, 8

    def part(self, s) -> tuple[int, bytes, int]:
        """(type, data, bytes taken) of an element that holds no others."""
        kind, size, data, taken = self.tag(s)
        if data is None:
            pad = -size % 8
            data = s.read(size)
            if len(data) < size:
                raise EOFError("the file ends within an element")
            s.skip(pad)
            taken += size + pad
        return kind, data, taken

    def numbers(self, kind: int, data: bytes) -> np.ndarray:
        if kind not in STORED:
            raise ValueError(f"element of type {kind} where numbers were due")
        return np.frombuffer(data, dtype=np.dtype(STORED[kind]).newbyteorder(self.order))

    def head(self, s) -> Head:
        """The head of an array whose tag has been read."""
        _, flags, a = self.part(s)
        kind = struct.unpack(self.order + "I", flags[:4])[0] & 0xFF
        k, dims, b = self.part(s)
        _, name, c = self.part(s)
        shape, taken, fields = tuple(int(x) for x in self.numbers(k, dims)), a + b + c, ()
        if kind == STRUCT:
            k, width, d = self.part(s)
            _, names, e = self.part(s)
            n = int(self.numbers(k, width)[0])
            fields = tuple(names[i : i + n].split(b"\0")[0].decode("ascii") for i in range(0, len(names) - len(names) % n, n))
            taken += d + e
        return Head(kind, shape, name.decode("ascii"), fields, taken)

    def array(self, raw: bytes) -> Any:
        """An array of bytes without its tag: numpy array, str, list of cells, or list of dicts of undecoded fields. An empty element is none."""
        if not raw:
            return np.zeros((0, 0))
        s = Plain(io.BytesIO(raw))
        h = self.head(s)
        if h.kind in NUMBERS:
            k, data, _ = self.part(s)
            return self.numbers(k, data).astype(NUMBERS[h.kind]).reshape(h.shape, order="F")
        if h.kind == CHAR:
            k, data, _ = self.part(s)
            text = data.decode(TEXTS[k] + ("" if k == 16 else {"<": "-le", ">": "-be"}[self.order])) if k in TEXTS else "".join(map(chr, self.numbers(k, data)))
            # stored by columns: of a matrix of characters the rows are read one after another
            return text if len(h.shape) != 2 or h.shape[0] <= 1 else "".join(text[r :: h.shape[0]] for r in range(h.shape[0]))
        if h.kind == CELL:
            return [self.raw(s) for _ in range(h.size)]
        if h.kind == STRUCT:
            return [{f: self.raw(s) for f in h.fields} for _ in range(h.size)]
        raise ValueError(f"array of class {h.kind}, which is not read here")

    def raw(self, s) -> bytes:
        """The bytes of the next array, without its tag."""
        kind, size, data, _ = self.tag(s)
        if kind != MATRIX:
            raise ValueError(f"element of type {kind} where an array was due")
        return data if data is not None else s.read(size)

    def value(self, raw: bytes | Any, kind: T.DataType) -> Any:
        """An array as a value of a Spark type, through cells and structs of one element; None where it is empty or of another kind."""
        v = self.array(raw) if isinstance(raw, bytes) else raw
        while isinstance(v, list) and len(v) == 1 and isinstance(v[0], bytes):
            v = self.array(v[0])
        if isinstance(kind, T.StructType):
            one = v[0] if isinstance(v, list) and len(v) == 1 and isinstance(v[0], dict) else None
            return None if one is None else {f.name: self.value(one[f.name], f.dataType) if f.name in one else None for f in kind.fields}
        if isinstance(kind, T.MapType):
            one = v[0] if isinstance(v, list) and len(v) == 1 and isinstance(v[0], dict) else {}
            return {k: self.value(x, kind.valueType) for k, x in one.items()}
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.NumericType):
            if isinstance(v, np.ndarray):
                rows = v.reshape(v.shape[0], -1) if v.size else ()
                return [self.value(r, kind.elementType) for r in rows] if isinstance(kind.elementType, T.ArrayType) and v.size else None
            return [self.value([x] if isinstance(x, dict) else x, kind.elementType) for x in v] if isinstance(v, list) and v else None
        if isinstance(kind, T.ArrayType):
            return v.ravel(order="F").astype(kind_of(kind.elementType)).tolist() if isinstance(v, np.ndarray) and v.size else None
        if isinstance(kind, T.StringType):
            if isinstance(v, np.ndarray) and v.size == 1:
                x = v.ravel()[0]
                return str(int(x)) if np.isfinite(x) and float(x) == int(x) else str(float(x))
            if isinstance(v, np.ndarray) and v.size and v.dtype == np.uint8:
                return v.ravel(order="F").tobytes().decode("utf-8", "replace")
            return v if isinstance(v, str) else None
        if not isinstance(v, np.ndarray) or v.size != 1:
            return None
        x = v.ravel()[0]
        if isinstance(kind, T.BooleanType):
            return bool(x)
        return (int(x) if np.isfinite(x) else None) if isinstance(kind, T.IntegralType) else float(x)


def kind_of(t: T.DataType) -> type:
    return np.int64 if isinstance(t, T.IntegralType) else np.float64


@dataclass
class Range(InputPartition):
    """Part `part` of `parts` of the elements of a file."""

    path: str
    part: int
    parts: int


def variables(f: BinaryIO, size: int) -> Iterator[tuple[Head, Any, Decoder]]:
    """(head, stream after the head, decoder) of the arrays of a file, one after another."""
    head = f.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("no level 5 MATLAB file")
    decoder = Decoder("<" if head[126:128] == b"IM" else ">")
    at = 128
    while at + 8 <= size:
        f.seek(at)
        kind, length, data, _ = decoder.tag(f)
        at += 8 + (0 if data is not None else length) + (0 if kind == COMPRESSED or data is not None else -length % 8)
        if kind == COMPRESSED:
            s = Inflated(f, length)
            if decoder.tag(s)[0] != MATRIX:
                continue
        elif kind == MATRIX:
            s = Plain(f)
        else:
            continue
        yield decoder.head(s), s, decoder


class MatReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.key, self.missing = options.get("key"), options.get("missingkey", "error")
        if self.missing not in ("error", "first"):
            raise ValueError(f"missingKey is error or first, not {self.missing}")
        self.limit = int(options.get("limit", 0))
        self.bytes = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        files = files_of(self.path, ".mat")
        if not files:
            raise FileNotFoundError(f"no .mat file in {self.path}")
        return [Range(path, i, n) for path, size in files for n in [max(1, -(-size // self.bytes))] for i in range(n)]

    def chosen(self, f: BinaryIO, size: int, path: str) -> tuple[Head, Any, Decoder]:
        """The variable of the key; without a key the only one, and with missingKey=first the first in the file if there is none of the key."""
        names, first = [], None
        for h, s, d in variables(f, size):
            if h.name == self.key:
                return h, s, d
            names.append(h.name)
            first = first if first is not None else h.name
        shown = sorted(names)
        wanted = first if names and (self.missing == "first" or (self.key is None and len(names) == 1)) else None
        if wanted is None:
            raise KeyError(f"{path}: no variable {self.key}; it has {shown}" if self.key is not None else f"{path}: name one of the variables {shown}")
        f.seek(0)
        return next(v for v in variables(f, size) if v[0].name == wanted)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, at = opened(partition.path)
        schema = arrow_schema(self.schema)
        with system.open_input_file(at) as f:
            h, s, d = self.chosen(f, f.size(), partition.path)
            if h.kind not in (STRUCT, CELL):
                raise ValueError(f"{partition.path}: {h.name} is neither structs nor cells")
            n = h.size
            start, end = (n * k // partition.parts for k in (partition.part, partition.part + 1))
            end = min(end, self.limit) if self.limit > 0 else end
            rows, held = [], 0
            for i in range(end):
                names = h.fields if h.kind == STRUCT else ("",)
                if i < start:
                    for _ in names:
                        kind, size, data, _ = d.tag(s)
                        s.skip(0 if data is not None else size)
                    continue
                element, size = self.element(d, s, names)
                values = self.row(d, element, names)
                rows.append(values | {FILE: partition.path, PLACE: i})
                held += size
                if held > 8 << 20 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def element(self, d: Decoder, s, names: tuple[str, ...]) -> tuple[dict[str, bytes], int]:
        """The fields of the next element that the schema has, undecoded; others are passed over."""
        wanted, out, taken = set(self.schema.names), {}, 0
        for name in names:
            kind, size, data, _ = d.tag(s)
            if name and name not in wanted:
                s.skip(0 if data is not None else size)
                continue
            out[name] = data if data is not None else s.read(size)
            taken += len(out[name])
        return out, taken

    def row(self, d: Decoder, element: dict[str, bytes], names: tuple[str, ...]) -> dict:
        if names == ("",):  # a cell, which holds a struct
            v = d.array(element[""])
            element = v[0] if isinstance(v, list) and len(v) == 1 and isinstance(v[0], dict) else {}
        return {f.name: d.value(element[f.name], f.dataType) if f.name in element else None for f in self.schema.fields}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class MatSource(DataSource):
    """Format "mat". Options: key, missingKey (error or first), limit (elements of a file), partitionBytes; of writers key, compress."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> T.StructType:
        raise ValueError("name the fields in a schema")

    def reader(self, schema: T.StructType) -> MatReader:
        return MatReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> MatWriter:
        return MatWriter(schema, dict(self.options), overwrite)


def element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array_of(v: Any, name: bytes = b"") -> bytes:
    """A value as an array of the format: numbers, texts, rows of numbers, dicts as structs, lists of others as cells, and null as empty."""
    if isinstance(v, dict):
        return structs([v], list(v), name)
    if isinstance(v, str):
        return headed(CHAR, (1, len(v)), name) + element(17, v.encode("utf-16-le"))
    if isinstance(v, (list, tuple)) and v and not all(isinstance(x, (int, float, list, tuple)) for x in v):
        return headed(CELL, (len(v), 1), name) + b"".join(element(MATRIX, array_of(x)) for x in v)
    m = np.zeros((0, 0)) if v is None else np.atleast_2d(np.array(v, dtype=np.float64))
    return headed(DOUBLE, m.shape, name) + element(9, m.astype("<f8").tobytes(order="F"))


def headed(kind: int, shape: tuple[int, ...], name: bytes) -> bytes:
    return element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name)


def structs(rows: list[dict], names: list[str], name: bytes) -> bytes:
    """An array of structs."""
    labels = b"".join(n.encode("ascii")[:31].ljust(32, b"\0") for n in names)
    fields = element(5, struct.pack("<i", 32)) + element(1, labels)
    return headed(STRUCT, (1, len(rows)), name) + fields + b"".join(element(MATRIX, array_of(r[n])) for r in rows for n in names)


class MatWriter(PartWriter):
    """A file per task with one array of structs. A file of more than 2 GB is beyond the format, so partition the rows well below that."""

    suffix = ".mat"

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.names, self.key, self.compress = schema.names, options.get("key", "samples"), options.get("compress", "true") == "true"

    def encode(self, batches: Iterator[pa.RecordBatch]) -> tuple[bytes, dict] | None:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return None
        whole = element(MATRIX, structs(rows, self.names, self.key.encode("ascii")))
        if self.compress:
            packed = zlib.compress(whole, 3)
            whole = struct.pack("<II", COMPRESSED, len(packed)) + packed
        return b"MATLAB 5.0 MAT-file, written by tasks".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM" + whole, {"rows": len(rows)}


def read_mat(spark: SparkSession, path: str, schema: str | T.StructType, key: str | None = None, missing_key: str = "error", limit: int | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """The elements of a variable as rows of schema, with FILE and PLACE. limit: the first n by file name and place.

    Fields that are absent, empty or of another kind are null, and those that the schema lacks are not decoded. A missing key is an error that names the
    variables there are (`error`), or the file's first variable is taken (`first`); without a key there must be one variable only.
    """
    spark.dataSource.register(MatSource)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    wide = T.StructType([*fields, T.StructField(FILE, T.StringType()), T.StructField(PLACE, T.LongType())])
    reader = spark.read.format("mat").schema(wide).option("missingKey", missing_key).option("partitionBytes", partition_bytes)
    if key is not None:
        reader = reader.option("key", key)
    if limit is None or limit <= 0:
        return reader.load(path)
    return reader.option("limit", limit).load(path).orderBy(FILE, PLACE).limit(limit)


def write_mat(rows: DataFrame, path: str, key: str = "samples", compress: bool = True, overwrite: bool = False) -> None:
    """rows as MATLAB files, one per partition, published together."""
    rows.sparkSession.dataSource.register(MatSource)
    rows.write.format("mat").mode("overwrite" if overwrite else "append").option("key", key).option("compress", str(compress).lower()).save(path)
