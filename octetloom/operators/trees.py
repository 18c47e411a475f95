"""Tagged trees: header, tables and nodes as columns and rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.codec import tree
from octetloom.errors import DecodeError, either, error
from octetloom.functions import primitives as P
from octetloom.functions.text import ENCODINGS
from octetloom.operators.compression import _each
from octetloom.schemas import ERROR, result
from octetloom.types import arrow_type


def header(b: Column, binary_table: bool = False) -> Column:
    """struct<ok, value, error>: the byte order comes from the mark, offset 0 is null."""
    endian = F.when(F.substring(b, 1, 2) == F.lit(tree.MARK), "BE").when(F.substring(b, 1, 2) == F.lit(tree.MARK[::-1]), "LE")
    word = lambda at: F.nullif(P.decode(F.substring(b, at + 1, 4), "u32", endian), F.lit(0).cast("bigint"))
    none, size = F.lit(None).cast("bigint"), 20 if binary_table else 16
    value = F.struct(
        endian.alias("endian"),
        P.decode(F.substring(b, 3, 2), "u16", endian).alias("version"),
        word(4).alias("key_table_offset"),
        word(8).alias("string_table_offset"),
        (word(12) if binary_table else none).alias("binary_data_table_offset"),
        word(size - 4).alias("root_data_offset"),
    )
    short = F.length(b) < size
    return either(short | endian.isNull(), value, error(F.when(short, "exhausted").otherwise("bad_byte_order_mark"), "tree.header", F.lit(0), F.lit(size), F.length(b)))


def strings(files: DataFrame, content: str = "content", which: str = "key", keys: tuple[str, ...] = (), encoding: str = "latin1") -> DataFrame:
    """One row per string: ``keys``, idx, offset, raw, value, unterminated and error.

    A faulty file gives the strings before the fault and one row with the error; an
    absent table gives none. Files are decoded one at a time and rows leave in
    batches as they come.
    """
    charset, most = ENCODINGS[encoding], 4096
    names = ["idx", "offset", "raw", "value", "unterminated", "error"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), arrow_type(ERROR)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            at = pa.array([r[0] for r in rows], pa.int64())
            own = [b.column(k).take(at) for k in keys]
            return pa.RecordBatch.from_arrays(own + [pa.array([r[j + 1] for r in rows], k) for j, k in enumerate(kinds)], [*keys, *names])

        for b in batches:
            rows: list = []
            for i, raw in enumerate(b.column(content).to_pylist()):
                if raw is None:
                    continue
                try:
                    for idx, offset, s, ended in tree.table_strings(raw, which):
                        rows.append((i, idx, offset, s, s.decode(charset, "replace"), not ended, None))
                        if len(rows) >= most:
                            yield out(b, rows)
                            rows = []
                except DecodeError as e:
                    rows.append((i, None, None, None, None, None, e.row()))
            if rows:
                yield out(b, rows)

    kind = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + ["idx int, offset bigint, raw binary, value string, unterminated boolean", f"error {ERROR}"])
    return files.select(*keys, content).mapInArrow(run, kind)


def string_at(b: Column, index: Column, which: str = "key") -> Column:
    """struct<ok, value, error>: one string of a table, read without the others."""
    return _each(lambda raw, i: tree.string_at(raw, i, which), result("binary"))(b, index.cast("int"))


def packed(items: Column, endian: str = "BE", version: int = 1) -> Column:
    """A tree file whose key table holds an array of byte strings."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else tree.packed([bytes(s) for s in x], None, version, endian) for x in col.to_pylist()], pa.binary())

    return run(items)


def node_kind(tag: Column, version: Column, binary_table: bool = False) -> Column:
    """struct<ok, value, error>: the node kind of a tag if the version has it; an unknown tag and one from a later version differ."""
    name, first = None, None
    for t, (n, v) in tree.TAGS.items():
        v = 1 if binary_table and t in (0xA1, 0xC3) else 1 << 30 if v is None else v
        name = F.when(tag == t, n) if name is None else name.when(tag == t, n)
        first = F.when(tag == t, v) if first is None else first.when(tag == t, v)
    code = F.when(name.isNull(), "unknown_tag").when(version < first, "tag_needs_newer_version")
    return either(code.isNotNull() & tag.isNotNull(), name, error(code, "tree.tag", tag))


def node_value(kind: Column, word: Column) -> Column:
    """struct of the value of a scalar node by kind: long for strings' indexes and numbers, boolean, float."""
    signed = F.when(word >= 1 << 31, word - (1 << 32)).otherwise(word)
    return F.struct(
        F.when(kind.isin("String", "UnsignedInteger32"), word).when(kind == "Integer32", signed).cast("bigint").alias("number"),
        F.when(kind == "Bool", word != 0).alias("bool"),
        F.when(kind == "Float32", P.decode(P.encode(word, "u32"), "f32")).alias("float"),
        (~kind.isin(*tree.IN_PLACE)).alias("not_constructible"),
    )
