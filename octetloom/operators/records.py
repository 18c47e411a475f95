"""Runs of fixed-width records within a byte column, as rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.functions import hashes as H
from octetloom.functions import primitives as P
from octetloom.functions.slices import _cut


def packed_record(fields: Mapping[str, tuple[Column, str]], endian: str = "BE") -> Column:
    """The bytes of one record from its fields: name to (value, primitive)."""
    return F.concat(*(P.encode(v, kind, endian) for v, kind in fields.values()))


def packed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Mapping[str, tuple[Column, str]], endian: str = "BE") -> DataFrame:
    """``keys`` and ``content``: the records of each key's rows one after another, in the order of the columns ``order``.

    A row with a null field gives no record; a key without records has null
    content. Rows alike in ``order`` come in any order. The bytes of one key are
    gathered in one task, as they make one value.
    """
    by = [f"__by{i}" for i in range(len(order))]
    cut = rows.select(*keys, *(F.col(c).alias(b) for c, b in zip(order, by)), packed_record(fields, endian).alias("__record"))
    return cut.groupBy(*keys).agg(F.expr(f"listagg(__record) WITHIN GROUP (ORDER BY {', '.join(by)})").alias("content"))


def records(
    rows: DataFrame, content: str, fields: Mapping[str, str], endian: str | Column = "BE", first: int = 0, count: int | None = None, start: int | Column = 0
) -> DataFrame:
    """One row per record: the other columns, idx and the fields (name to primitive).

    ``start`` is where the records begin. Whole records only: bytes left over at
    the end give no row. ``first`` and ``count`` pick a range of them by number
    before anything is decoded, so records outside it cost nothing.
    """
    width = sum(P.TYPES[k][0] for k in fields.values())
    start = F.lit(start) if isinstance(start, int) else start
    n = F.floor((F.length(content) - start) / width).cast("int")
    last = n if count is None else F.when(n.isNotNull(), F.least(n, F.lit(first + count)))
    idx = F.when(last > first, F.sequence(F.lit(first), last - 1))
    # Each record is cut out before rows multiply, so that no copy of the content goes with them.
    cut = F.transform(idx, lambda i: F.struct(i.alias("idx"), _cut(F.col(content), start + i * width, F.lit(width)).alias("__record")))
    out = rows.select(*(c for c in rows.columns if c != content), F.inline(cut))
    at = 0
    cols = []
    for name, kind in fields.items():
        size = P.TYPES[kind][0]
        cols.append(P.decode(F.substring("__record", at + 1, size), kind, endian).alias(name))
        at += size
    return out.select(*(c for c in rows.columns if c != content), "idx", *cols)


def edited(content: Column, fields: Mapping[str, str], changes: Mapping[str, Callable[[Column], Column]], endian: str = "BE", first: int = 0, count: int | None = None) -> Column:
    """The bytes with fields of their records changed in place: each record is decoded as far as needed, edited and encoded again.

    ``changes`` maps a field to a function of its value. Records outside ``first``
    and ``count``, other fields and bytes left over at the end stay.
    """
    widths = {k: P.TYPES[t][0] for k, t in fields.items()}
    width = sum(widths.values())
    n = F.floor(F.length(content) / width).cast("int")
    last = n if count is None else F.least(n, F.lit(first + count))

    def one(i: Column) -> Column:
        at, parts = i * width, []
        for name, kind in fields.items():
            raw = _cut(content, at, F.lit(widths[name]))
            parts.append(P.encode(changes[name](P.decode(raw, kind, endian)), kind, endian) if name in changes else raw)
            at = at + widths[name]
        return F.hex(F.concat(*parts))

    begin = F.least(n, F.lit(first))
    middle = F.when(last > begin, F.unhex(F.array_join(F.transform(F.sequence(begin, last - 1), one), ""))).otherwise(F.lit(b""))
    return F.concat(_cut(content, F.lit(0), begin * width), middle, _cut(content, F.greatest(last, begin) * width))


def viewed(rows: DataFrame, content: str, fields: Mapping[str, str], endian: str | Column = "BE", start: int = 0) -> DataFrame:
    """Records as ``value`` structs beside the place that each was read from: ``offset`` and ``size``, so that an edit can go back there."""
    width = sum(P.TYPES[k][0] for k in fields.values())
    out = records(rows, content, fields, endian, start=start)
    keep = [c for c in out.columns if c not in fields]
    return out.select(*keep, (F.lit(start) + F.col("idx") * width).cast("bigint").alias("offset"), F.lit(width).alias("size"), F.struct(*fields).alias("value"))


#: The entry of an archive's table.
ENTRY_FIELDS = {"filename_hash": "u32", "attributes": "u32", "start_offset": "u32", "end_offset": "u32"}


def entries(rows: DataFrame, content: str, endian: str | Column = "BE", start: int | Column = 0, count: int | None = None) -> DataFrame:
    """Table entries as rows, their attributes unpacked to sequence and hash_index; attribute_error where the sequence is 0."""
    out = records(rows, content, ENTRY_FIELDS, endian, count=count, start=start)
    a = H.unpacked_attributes(F.col("attributes"))
    keep = [c for c in out.columns if c not in ENTRY_FIELDS]
    return out.select(*keep, "filename_hash", a["sequence"].alias("sequence"), a["index"].alias("hash_index"), a["error"].alias("attribute_error"), "start_offset", "end_offset")


def by_name(table: DataFrame, names: DataFrame, name: str = "name", keys: tuple[str, ...] = (), multiplier: int = H.MULTIPLIER, signed: bool = True) -> DataFrame:
    """Entries joined to names by hash (and ``keys``): a name matches every entry of its hash."""
    hashed = names.withColumn("filename_hash", H.name_hash(F.col(name).cast("binary"), multiplier, signed))
    return table.join(hashed, [*keys, "filename_hash"])


def hex_dump(rows: DataFrame, content: str, width: int = 16) -> DataFrame:
    """The other columns, row number, its label in hex, and the bytes of each line in hex."""
    n = F.ceil(F.length(content) / width).cast("int")
    out = rows.withColumn("row", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    line = F.substring(content, F.col("row") * width + 1, F.lit(width))
    keep = [c for c in rows.columns if c != content]
    return out.select(*keep, "row", F.hex("row").alias("label"), F.hex(line).alias("bytes"))
