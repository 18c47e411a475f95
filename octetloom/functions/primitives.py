"""Fixed-width primitives between bytes and Spark types, as built-in expressions.

Unsigned types widen to the next signed one (u64: decimal(20,0)); 128-bit
integers stay 16 bytes, most significant first. Only floats, whose bits no
built-in exposes, take an Arrow function.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType

from octetloom.functions.slices import written

#: Width in bytes and Spark type.
TYPES = {
    "u8": (1, "smallint"), "i8": (1, "tinyint"), "u16": (2, "int"), "i16": (2, "smallint"), "u24": (3, "int"), "u32": (4, "bigint"), "i32": (4, "int"),
    "u64": (8, "decimal(20,0)"), "i64": (8, "bigint"), "u128": (16, "binary"), "i128": (16, "binary"), "f32": (4, "float"), "f64": (8, "double"), "bool": (1, "boolean"),
}


def swap(endian: Column) -> Column:
    """The other byte order."""
    return F.when(endian == "LE", "BE").when(endian == "BE", "LE")


def reversed_bytes(b: Column, n: int) -> Column:
    """The first ``n`` bytes, last first. (``reverse`` would reverse characters.)"""
    return F.concat(*(F.substring(b, i, 1) for i in range(n, 0, -1)))


def _big_first(b: Column, n: int, endian: str | Column) -> Column:
    cut = F.substring(b, 1, n)
    if isinstance(endian, str):
        return cut if endian == "BE" or n == 1 else reversed_bytes(b, n)
    return cut if n == 1 else F.when(endian == "BE", cut).otherwise(reversed_bytes(b, n))


@F.arrow_udf(FloatType())
def _bits_f32(b: pa.Array) -> pa.Array:
    return _bits(b, 4, pa.float32())


@F.arrow_udf(DoubleType())
def _bits_f64(b: pa.Array) -> pa.Array:
    return _bits(b, 8, pa.float64())


def _bits(b: pa.Array, n: int, kind: pa.DataType) -> pa.Array:
    ok = pc.equal(pc.binary_length(b), n)
    good = pc.if_else(pc.fill_null(ok, False), b, pa.scalar(b"\0" * n, b.type))
    raw = b"".join(x[::-1] for x in good.to_pylist())
    return pc.if_else(pc.fill_null(ok, False), pa.Array.from_buffers(kind, len(b), [None, pa.py_buffer(raw)]), pa.scalar(None, kind))


def decode(b: Column, kind: str, endian: str | Column = "BE") -> Column:
    """The value of the first bytes of ``b``; null where there are too few."""
    n, spark = TYPES[kind]
    big = F.when(F.length(b) >= n, _big_first(b, n, endian))
    if kind == "bool":
        return big != F.lit(b"\0")
    if kind[0] == "f":
        return (_bits_f32 if kind == "f32" else _bits_f64)(big)
    if n == 16:
        return big
    number = F.conv(F.hex(big), 16, 10)
    if n < 8:
        number = number.cast("bigint")
        top = F.lit(1 << (8 * n - 1))
        return (number.bitwiseXOR(top) - top if kind[0] == "i" else number).cast(spark)
    number = number.cast("decimal(20,0)")
    if kind[0] == "i":
        number = F.when(number >= F.lit(Decimal(1 << (8 * n - 1))), number - F.lit(Decimal(1 << (8 * n)))).otherwise(number)
    return number.cast(spark)


def put(b: Column, position: int | Column, value: Column, kind: str, endian: str | Column = "BE") -> Column:
    """struct<bytes, position> after a primitive is written at a cursor, which moves behind it."""
    return written(b, position, encode(value, kind, endian))


@F.arrow_udf(BinaryType())
def _f32_bits(v: pa.Array) -> pa.Array:
    return _own_bits(v, 4, pa.float32())


@F.arrow_udf(BinaryType())
def _f64_bits(v: pa.Array) -> pa.Array:
    return _own_bits(v, 8, pa.float64())


def _own_bits(v: pa.Array, n: int, kind: pa.DataType) -> pa.Array:
    raw = pc.fill_null(v.cast(kind), 0.0).to_numpy(zero_copy_only=False).tobytes()
    out = pa.array([raw[i : i + n][::-1] for i in range(0, len(raw), n)], pa.binary())
    return pc.if_else(v.is_valid(), out, pa.scalar(None, pa.binary()))


def encode(v: Column, kind: str, endian: str | Column = "BE") -> Column:
    """The bytes of a value: the inverse of decode(). Values out of range keep their low bits."""
    n, _ = TYPES[kind]
    if kind == "bool":
        big = F.when(v, F.lit(b"\1")).otherwise(F.when(v.isNotNull(), F.lit(b"\0")))
    elif kind[0] == "f":
        big = (_f32_bits if kind == "f32" else _f64_bits)(v.cast(TYPES[kind][1]))
    elif n == 16:
        big = v
    else:
        hexed = F.conv(v.cast("string"), 10, 16) if kind == "u64" else F.hex(v.cast("bigint"))
        big = F.unhex(F.right(F.lpad(hexed, 16, "0"), F.lit(2 * n)))
    return _big_first(big, n, endian)
