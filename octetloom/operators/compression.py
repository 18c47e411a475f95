"""The Yaz0 codec as columns and rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.codec import lz
from octetloom.errors import DecodeError, either, error
from octetloom.functions import primitives as P
from octetloom.functions import text as T
from octetloom.schemas import LZ_OPS, result
from octetloom.types import arrow_type

_RESULT = result("binary")
#: Operations that go to Spark in one batch, unless one file has more.
OPS_TOGETHER = 50_000


def _each(fn: Callable[..., object], kind: str):
    """An Arrow function of ``fn`` over rows: its value, or its DecodeError as data. Null in any argument gives null."""

    to = arrow_type(kind)

    @F.arrow_udf(kind)
    def run(*cols: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in cols)):
            if any(x is None for x in row):
                out.append(None)
                continue
            try:
                out.append({"ok": True, "value": fn(*row), "error": None})
            except DecodeError as e:
                out.append({"ok": False, "value": None, "error": e.row()})
        return pa.array(out, to)

    return run


def decompressed(b: Column, endian: str = "BE", limit: int = lz.OUTPUT_LIMIT) -> Column:
    """struct<ok, value, error>: the decoded bytes, cut at the declared size."""
    return _each(lambda raw: lz.decode(raw, endian, limit).data, _RESULT)(b)


def decompressed_range(b: Column, offset: Column, length: Column, endian: str = "BE") -> Column:
    """struct<ok, value, error>: some decoded bytes; decoding stops behind them."""
    return _each(lambda raw, o, n: lz.decode_range(raw, o, n, endian), _RESULT)(b, offset.cast("bigint"), length.cast("bigint"))


def compressed(b: Column, alignment: int = 0, endian: str = "BE") -> Column:
    """The encoded file; deterministic."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(lz.encode_all(col.to_pylist(), alignment, endian), pa.binary())

    return run(b)


def spliced(b: Column, offset: Column, length: Column, new: Column, endian: str = "BE") -> Column:
    """struct<ok, value, error>: the file with decoded bytes replaced."""
    return _each(lambda raw, o, n, x: lz.splice(raw, o, n, x, endian), _RESULT)(b, offset.cast("bigint"), length.cast("bigint"), new)


def header(b: Column, endian: str = "BE") -> Column:
    """struct<ok, value, error> of the header, by built-in expressions alone."""
    word = lambda at: P.decode(F.substring(b, at + 1, 4), "u32", endian)
    value = F.struct(word(4).alias("decompressed_size"), word(8).alias("alignment"), word(12).alias("unused"))
    failed = (F.length(b) < lz.HEADER_SIZE) | (F.substring(b, 1, 4) != F.lit(lz.MAGIC))
    return either(failed, value, error(F.when(F.length(b) < lz.HEADER_SIZE, "exhausted").otherwise("bad_magic"), "yaz0.header", F.lit(0), F.lit(lz.HEADER_SIZE), F.length(b)))


def with_header(b: Column, decompressed_size: Column | None = None, alignment: Column | None = None, endian: str = "BE") -> Column:
    """The file with header fields set; the others stay."""
    for at, v in ((5, decompressed_size), (9, alignment)):
        if v is not None:
            b = F.overlay(b, P.encode(v, "u32", endian), F.lit(at), F.lit(4))
    return b


def _op_columns(ops: list[tuple]) -> list[pa.Array]:
    block, number, literal, distance, length, at = zip(*ops)
    literal, distance, length = pa.array(literal, pa.int16()), np.array(distance, np.int32), np.array(length, np.int32)
    kind = np.where(distance == 0, 0, np.where(length < lz.LONG_FROM, 1, 2))
    kinds = pa.array(["literal", "short", "long"]).take(pa.array(kind))
    return [pa.array(block, pa.int64()), pa.array(number, pa.int32()), kinds, literal, pa.array(distance, mask=distance == 0), pa.array(length), pa.array(at, pa.int64())]


def operations(files: DataFrame, content: str = "content", keys: tuple[str, ...] = (), endian: str = "BE") -> DataFrame:
    """One row per operation of every file: ``keys`` and the operation. Operations before a fault in the blocks are kept."""
    names = [c.split()[0] for c in LZ_OPS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ops, files, upto = [], [], []
            for i in range(b.num_rows):
                raw = b.column(content)[i].as_py()
                if raw is not None:
                    try:
                        c = lz.Cursor(raw, endian)
                        lz.parse(c, lz.read_header(c).decompressed_size, ops)
                    except DecodeError:
                        pass
                    files.append(i)
                    upto.append(len(ops))
                if ops and (len(ops) >= OPS_TOGETHER or i + 1 == b.num_rows):
                    of = pa.array(np.repeat(files, np.diff(upto, prepend=0)))
                    yield pa.RecordBatch.from_arrays([b.column(k).take(of) for k in keys] + _op_columns(ops), [*keys, *names])
                    ops, files, upto = [], [], []

    kind = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + [LZ_OPS])
    return files.select(*keys, content).mapInArrow(run, kind)


def is_compressed(b: Column) -> Column:
    return T.magic(b, lz.MAGIC, "yaz0.magic")["ok"]
