"""The decoders under SQL names: ``yaz0_decode``, ``yaz0_encode``, ``name_hash32``, ``tree_string_list``, ``yaz0_op_list`` and the table functions ``tree_strings`` and ``yaz0_ops`` made of the last two.

A Python table function holds all rows of a file as objects, so these are SQL
functions over Arrow lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from octetloom.codec import archive, lz, tree
from octetloom.errors import DecodeError
from octetloom.schemas import LZ_OPS
from octetloom.types import arrow_type

STRING_COLUMNS = "idx int, offset bigint, raw binary, value string"
OP_COLUMNS = LZ_OPS
#: Rows that are Python objects at a time.
ROWS_TOGETHER = 10_000


def _fields(columns: str) -> str:
    return ", ".join(": ".join(c.split()) for c in columns.split(", "))


def _lists(files: Iterator[Iterator[tuple]], kind: pa.StructType) -> pa.Array:
    """The rows of every file as a list of structs; only ROWS_TOGETHER of them are objects at a time."""
    parts, ends = [], [0]
    for rows in files:
        ends.append(ends[-1])
        for some in iter(lambda: list(islice(rows, ROWS_TOGETHER)), []):  # noqa: B023
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], fields=list(kind)))
            ends[-1] += len(some)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], kind))


def _strings(content: bytes | None, which: str | None) -> Iterator[tuple]:
    try:
        for idx, offset, raw, _ in tree.table_strings(content or b"", which):
            yield idx, offset, raw, raw.decode("ISO-8859-1")
    except DecodeError:
        return


def _operations(content: bytes | None) -> Iterator[tuple]:
    ops: list = []
    c = lz.Cursor(content or b"")
    try:
        lz.parse(c, lz.read_header(c).decompressed_size, ops)
    except DecodeError:
        pass
    for block, i, literal, distance, n, at in ops:
        yield block, i, "literal" if literal is not None else "short" if n < lz.LONG_FROM else "long", literal, distance or None, n, at


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session. A faulty file decodes to null, or to the rows before the fault."""

    @arrow_udf("binary")
    def yaz0_decode(b: pa.Array) -> pa.Array:
        out = []
        for raw in b.to_pylist():
            try:
                out.append(None if raw is None else lz.decode(raw).data)
            except DecodeError:
                out.append(None)
        return pa.array(out, pa.binary())

    @arrow_udf("binary")
    def yaz0_encode(b: pa.Array) -> pa.Array:
        return pa.array(lz.encode_all(b.to_pylist()), pa.binary())

    @arrow_udf("bigint")
    def name_hash32(b: pa.Array) -> pa.Array:
        return pa.array([None if raw is None else archive.name_hash(raw) for raw in b.to_pylist()], pa.int64())

    strings, operations = (arrow_type(f"struct<{_fields(c)}>") for c in (STRING_COLUMNS, OP_COLUMNS))

    @arrow_udf(f"array<struct<{_fields(STRING_COLUMNS)}>>")
    def tree_string_list(content: pa.Array, which: pa.Array) -> pa.Array:
        return _lists((_strings(c.as_py(), w.as_py()) for c, w in zip(content, which)), strings)

    @arrow_udf(f"array<struct<{_fields(OP_COLUMNS)}>>")
    def yaz0_op_list(content: pa.Array) -> pa.Array:
        return _lists((_operations(c.as_py()) for c in content), operations)

    for f in (yaz0_decode, yaz0_encode, name_hash32, tree_string_list, yaz0_op_list):
        spark.udf.register(f.__name__, f)
    for name, given, call, rows in (("tree_strings", "content BINARY, which STRING", "tree_string_list(content, which)", STRING_COLUMNS), ("yaz0_ops", "content BINARY", "yaz0_op_list(content)", OP_COLUMNS)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({rows}) RETURN SELECT inline({call})")
