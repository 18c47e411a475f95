"""Name hashes, packed attributes and bit fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIER = 0x65
_WRAP = 1 << 32


def _wide_hash(multiplier: int, signed: bool):
    @F.arrow_udf("bigint")
    def run(b: pa.Array) -> pa.Array:
        out = []
        for raw in b.to_pylist():
            h = 0
            for c in raw or b"":
                h = (h * multiplier + (c - 256 if signed and c > 127 else c)) % _WRAP
            out.append(None if raw is None else h)
        return pa.array(out, pa.int64())

    return run


def name_hash(b: Column, multiplier: int = MULTIPLIER, signed: bool = True) -> Column:
    """``h = h * multiplier + byte`` modulo 2^32 over the bytes of a name, bytes taken as signed or not.

    Up to 2^30 the products fit a bigint and stay in the engine; a larger
    multiplier takes an Arrow function.
    """
    if multiplier >= 1 << 30:
        return _wide_hash(multiplier, signed)(b)
    at = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.when(b.isNotNull(), F.array().cast("array<int>")))
    byte = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("bigint")
    own = (lambda x: F.when(x > 127, x - 256).otherwise(x)) if signed else (lambda x: x)
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda h, i: F.pmod(h * multiplier + own(byte(i)), F.lit(_WRAP)))


def text_hash(b: Column, multiplier: int = MULTIPLIER, signed: bool = True) -> Column:
    """The same for long values, whose bytes are weighed by powers of the multiplier in an Arrow function; 32-bit numbers wrap by themselves."""

    @F.arrow_udf("bigint")
    def run(values: pa.Array) -> pa.Array:
        size = 4096
        powers = np.array([pow(multiplier, i, _WRAP) for i in range(size, -1, -1)], np.uint32)
        out = []
        for raw in values.to_pylist():
            h = 0
            for at in range(0, len(raw or b""), size):
                part = np.frombuffer(raw, np.int8 if signed else np.uint8, min(size, len(raw) - at), at).astype(np.int32).view(np.uint32)
                h = (h * int(powers[size - len(part)]) + int((part * powers[size + 1 - len(part) :]).sum(dtype=np.uint32))) % _WRAP
            out.append(None if raw is None else h)
        return pa.array(out, pa.int64())

    return run(b)


def unpacked_attributes(word: Column) -> Column:
    """struct<sequence, index, error> of a name attribute: 0 is none; the top byte is a sequence from 1, the rest an index."""
    word = word.cast("bigint")
    sequence, index = F.shiftright(word, 24), word.bitwiseAND(0xFFFFFF)
    some = word != 0
    return F.struct(
        F.when(some & (sequence != 0), sequence).cast("smallint").alias("sequence"),
        F.when(some & (sequence != 0), index).cast("int").alias("index"),
        F.when(some & (sequence == 0), "zero_sequence").alias("error"),
    )


def packed_attributes(sequence: Column, index: Column) -> Column:
    return F.coalesce(F.shiftleft(sequence.cast("bigint"), 24).bitwiseOR(index.cast("bigint")), F.lit(0).cast("bigint"))


def bit(byte: Column, i: int | Column) -> Column:
    """Bit ``i`` of a byte, the most significant first."""
    return F.getbit(byte, F.lit(7) - i)
