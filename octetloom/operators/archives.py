"""Hashed archives as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.codec import archive
from octetloom.errors import DecodeError, either, error
from octetloom.functions import hashes as H
from octetloom.functions import primitives as P
from octetloom.schemas import ERROR
from octetloom.types import arrow_type


def header(b: Column) -> Column:
    """struct<ok, value, error>: the mark at byte 6 decides the byte order of the length before it too."""
    mark = F.substring(b, 7, 2)
    endian = F.when(mark == F.lit(b"\xfe\xff"), "BE").when(mark == F.lit(b"\xff\xfe"), "LE")
    get = lambda at, kind: P.decode(F.substring(b, at + 1, P.TYPES[kind][0]), kind, endian)
    word = get(16, "u16")
    value = F.struct(endian.alias("endian"), get(8, "u32").alias("size"), get(12, "u32").alias("data_offset"), F.array(F.shiftright(word, 8), word.bitwiseAND(255)).alias("version"))
    code = F.when(F.length(b) < archive.HEADER_LENGTH, "exhausted").when(F.substring(b, 1, 4) != F.lit(archive.MAGIC), "bad_magic").when(endian.isNull(), "bad_byte_order_mark").when(get(4, "u16") != archive.HEADER_LENGTH, "bad_header_length")
    return either(code.isNotNull(), value, error(code, "archive.header", F.lit(0), F.lit(archive.HEADER_LENGTH), F.length(b)))


def table_header(b: Column, at: int = archive.HEADER_LENGTH, endian: str | Column = "BE") -> Column:
    """struct<ok, value, error> of the entry table: count and multiplier."""
    get = lambda o, kind: P.decode(F.substring(b, at + o + 1, P.TYPES[kind][0]), kind, endian)
    code = F.when(F.length(b) < at + archive.TABLE_HEADER_LENGTH, "exhausted").when(F.substring(b, at + 1, 4) != F.lit(archive.TABLE_MAGIC), "bad_magic")
    value = F.struct(get(6, "u16").alias("count"), get(8, "u32").alias("multiplier"))
    return either(code.isNotNull(), value, error(code, "archive.table", F.lit(at), F.lit(archive.TABLE_HEADER_LENGTH), F.length(b)))


def members(files: DataFrame, content: str = "content", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per member: ``keys``, idx, name, filename_hash, sequence, data and error. A faulty archive gives one row with its error."""
    names = ["idx", "name", "filename_hash", "sequence", "data", "error"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int16(), pa.binary(), arrow_type(ERROR)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(content).to_pylist()):
                if raw is None:
                    continue
                try:
                    rows = [(k, n, e.filename_hash, e.sequence, d, None) for k, (e, n, d) in enumerate(archive.members(raw))]
                except DecodeError as e:
                    rows = [(None, None, None, None, None, e.row())]
                if rows:
                    own = [pa.array([b.column(k)[i].as_py()] * len(rows), b.column(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays(own + [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [*keys, *names])

    kind = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + ["idx int, name binary, filename_hash bigint, sequence smallint, data binary", f"error {ERROR}"])
    return files.select(*keys, content).mapInArrow(run, kind)


def packed(names: Column, contents: Column, endian: str = "BE") -> Column:
    """An archive of an array of names and one of contents, both bytes."""

    @F.arrow_udf("binary")
    def run(n: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else archive.packed(dict(zip(map(bytes, x), map(bytes, y))), endian=endian) for x, y in zip(n.to_pylist(), c.to_pylist())], pa.binary())

    return run(names, contents)


def find(table: DataFrame, name: str | Column, multiplier: int = H.MULTIPLIER) -> DataFrame:
    """Entries that a name may stand for, by its hash."""
    name = F.lit(name) if isinstance(name, str) else name
    return table.where(F.col("filename_hash") == H.name_hash(name.cast("binary"), multiplier))
