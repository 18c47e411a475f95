"""Queries over windows, cursors, in-place edits, block edits and error notes, with SQL that says the same of the table itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from octetloom import errors
from octetloom.codec import lz
from octetloom.codec.cursor import Cursor
from octetloom.errors import DecodeError
from octetloom.functions import hashes as H
from octetloom.functions import primitives as P
from octetloom.functions import slices as S
from octetloom.operators import compression, provenance, records
from octetloom.plans.containers import CODED_SHORT, _bytes, _code, _order_records, _table
from octetloom.session import spread


def window_nested(spark, sf_dir):
    """A window of a window, fixed and by a column; the inner one may not leave the outer."""
    outer = S.window(_bytes("p_type"), 1, 4)
    inner, past = S.window(outer["value"], 1, F.col("p_size") % 7), S.window(outer["value"], F.col("p_size") % 9)
    return _table(spark, sf_dir, "part").select("p_partkey", outer["value"].cast("string").alias("outer"), inner["value"].cast("string").alias("inner"), _code(inner).alias("inner_code"), past["value"].cast("string").alias("rest"), _code(past).alias("rest_code"))


NESTED = """SELECT p_partkey, p_type[2:5] AS "outer", CASE WHEN p_size % 7 <= 3 THEN substr(p_type, 3, (p_size % 7)::BIGINT) END AS "inner", CASE WHEN p_size % 7 > 3 THEN 'out_of_bounds' END AS inner_code,
  CASE WHEN p_size % 9 <= 4 THEN substr(p_type[2:5], (p_size % 9 + 1)::BIGINT) END AS rest, CASE WHEN p_size % 9 > 4 THEN 'out_of_bounds' END AS rest_code FROM part"""


def head_and_tail(spark, sf_dir):
    """Both halves edited and joined again; the tail resized."""
    b = _bytes("c_mktsegment")
    up = lambda x: _bytes(F.lower(x.cast("string")))
    both = S.part_edited(b, 3, up, lambda x: F.concat(x, _bytes(F.lit("!"))))
    longer = S.part_edited(b, 3, lambda x: F.concat(x, x))
    tail = S.tail_resized(b, 4, F.col("c_custkey") % 6)
    return _table(spark, sf_dir, "customer").select("c_custkey", both["value"].cast("string").alias("edited"), _code(longer).alias("longer_code"), F.hex(tail["value"]).alias("tail"))


HALVES = """SELECT c_custkey, lower(c_mktsegment[1:3]) || c_mktsegment[4:] || '!' AS edited, 'out_of_bounds' AS longer_code,
  hex(encode(c_mktsegment[1:4] || substr(c_mktsegment[5:], 1, (c_custkey % 6)::BIGINT))) || repeat('00', greatest(0, c_custkey % 6 - (length(c_mktsegment) - 4))::BIGINT) AS tail FROM customer"""


def write_and_advance(spark, sf_dir):
    """Two primitives written one after the other at a cursor, and a window edited in place."""
    t = _table(spark, sf_dir, "customer").withColumn("one", P.put(_bytes("c_name"), 2, F.col("c_custkey"), "u32", "LE")["value"])
    t = t.withColumn("two", P.put(F.col("one.bytes"), F.col("one.position"), F.col("c_nationkey"), "u16")["value"])
    past = P.put(_bytes("c_name"), F.length("c_name") - 1, F.col("c_custkey"), "u32")
    edit = S.edited_window(_bytes("c_name"), 0, 4, lambda x: F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)))
    return t.select("c_custkey", F.hex("two.bytes").alias("bytes"), F.col("two.position").alias("position"), _code(past).alias("code"), edit["value"].cast("string").alias("window"))


WRITTEN = """SELECT c_custkey, hex(encode(c_name[1:2])) || printf('%02X%02X%02X%02X', c_custkey % 256, c_custkey // 256 % 256, c_custkey // 65536 % 256, c_custkey // 16777216)
  || printf('%04X', c_nationkey) || hex(encode(c_name[9:])) AS bytes, 8::BIGINT AS position, 'out_of_bounds' AS code, c_name[3:4] || c_name[1:2] || c_name[5:] AS "window" FROM customer"""


def records_edited(spark, sf_dir):
    """A field of the second and later records of each table edited in place, and all read again with their places."""
    t = _order_records(spark, sf_dir)
    new = t.select("l_orderkey", records.edited(F.col("content"), records.ENTRY_FIELDS, {"start_offset": lambda x: x * 2 + 1}, "LE", first=1).alias("content"))
    out = records.viewed(new, "content", records.ENTRY_FIELDS, "LE")
    end = S.table_end(F.col("offset"), 16, 2, F.lit(40))
    return out.select("l_orderkey", "idx", "offset", "size", F.col("value")["start_offset"].alias("start_offset"), F.col("value")["filename_hash"].alias("filename_hash"), end.alias("finish"))


EDITED = """SELECT l_orderkey, n::INTEGER AS idx, (16 * n)::BIGINT AS "offset", 16 AS size, (CASE WHEN n > 0 THEN trunc(l_quantity) * 2 + 1 ELSE trunc(l_quantity) END)::BIGINT AS start_offset, l_partkey AS filename_hash, least(16 * n + 32, 40)::BIGINT AS finish
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS n FROM lineitem)"""


def cursor_reads(spark, sf_dir):
    """What a cursor reads of a text: skip, rewind, snapshot and restore, fork, partition with its true place, named part, read until, and the fault beyond the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = Cursor(raw)
                first = c.read(2)
                mark = c.snapshot()
                c.skip(3)
                c.rewind(1)
                middle = c.read(1)
                c.restore(mark)
                fork = c.fork()
                fork.skip(1)
                left, right = fork.partition(2, "two")
                left.skip(1)
                word, ended = c.until(b"-")
                try:
                    right.named("rest").skip(len(raw))
                    code, at, part = None, None, None
                except DecodeError as e:
                    code, at, part = e.code, e.offset, e.path[-1][0]
                out.append((key, first.decode(), middle.decode(), fork.place, left.place, left.read(1).decode(), right.place, word.decode(), ended, c.remaining, code, at, part))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], NAMES)

    kinds = "long, string, string, long, long, string, long, string, boolean, long, string, long, string".split(", ")
    return _table(spark, sf_dir, "orders").select("o_orderkey", _bytes("o_orderpriority").alias("b")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))


NAMES = ["o_orderkey", "first", "middle", "forked", "part_place", "part_bytes", "rest_place", "word", "ended", "remaining", "code", "fault_offset", "fault_part"]
CURSOR = """SELECT o_orderkey, p[1:2] AS "first", p[5:5] AS middle, 3::BIGINT AS forked, 4::BIGINT AS part_place, p[5:5] AS part_bytes, 5::BIGINT AS rest_place,
  split_part(p[3:], '-', 1) AS word, contains(p[3:], '-') AS ended, CASE WHEN contains(p[3:], '-') THEN length(p) - 2 - instr(p[3:], '-') ELSE 0 END::BIGINT AS remaining,
  'out_of_bounds' AS code, 5::BIGINT AS fault_offset, 'rest' AS fault_part FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders)"""


def bits(spark, sf_dir):
    t = _table(spark, sf_dir, "part").withColumn("byte", F.col("p_partkey") % 256)
    return t.select("p_partkey", *(H.bit(F.col("byte"), i).cast("int").alias(f"bit{i}") for i in range(8)))


BITS = "SELECT p_partkey, " + ", ".join(f"((p_partkey % 256) >> {7 - i} & 1)::INTEGER AS bit{i}" for i in range(8)) + " FROM part"


def yaz0_range(spark, sf_dir):
    r = compression.decompressed_range(compression.compressed(_bytes(F.concat("p_name", "p_type", "p_name"))), F.col("p_size") % 30, F.lit(9))
    return spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), CODED_SHORT).select("p_partkey", r["value"].cast("string").alias("value"), _code(r).alias("code"))


RANGE = """SELECT p_partkey, CASE WHEN p_size % 30 + 9 <= length(w) THEN substr(w, (p_size % 30 + 1)::BIGINT, 9) END AS value, CASE WHEN p_size % 30 + 9 > length(w) THEN 'out_of_bounds' END AS code
FROM (SELECT *, p_name || p_type || p_name AS w FROM part)"""


def _block_edits(b: Column) -> Column:
    @F.arrow_udf("struct<split_at: long, decoded: binary, wide: long, replaced: binary, size: long>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        texts = col.to_pylist()
        for raw, data in zip(texts, lz.encode_all(texts)):
            header, blocks, _ = lz.ops_of(data)
            ops = [op for b in blocks for op in b]
            left, right = lz.split_ops(ops, len(raw) // 2, b"")
            wide = lz.inflated(ops, len(ops) + 1, b"")
            again = lz.decode(header.pack() + lz.packed_ops(wide or left + right)).data
            new = lz.decode(lz.with_blocks(data, 0, len(blocks), [(x, 0, 1) for x in raw[::-1]]))
            out.append({"split_at": sum(n for *_, n in left), "decoded": again, "wide": len(wide or []) - len(ops) if wide else 1, "replaced": new.data, "size": new.header.decompressed_size})
        return pa.array(out, pa.struct([("split_at", pa.int64()), ("decoded", pa.binary()), ("wide", pa.int64()), ("replaced", pa.binary()), ("size", pa.int64())]))

    return run(b)


def yaz0_block_edits(spark, sf_dir):
    """Operations split at half, made one more by a literal, and all blocks replaced: what they decode to."""
    t = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), CODED_SHORT).withColumn("e", _block_edits(_bytes(F.concat("p_name", "p_name"))))
    return t.select("p_partkey", F.col("e.split_at").alias("split_at"), F.col("e.decoded").cast("string").alias("decoded"), F.col("e.wide").alias("wide"), F.col("e.replaced").cast("string").alias("replaced"), F.col("e.size").alias("size"))


BLOCKS = "SELECT p_partkey, length(p_name)::BIGINT AS split_at, p_name || p_name AS decoded, 1::BIGINT AS wide, reverse(p_name || p_name) AS replaced, (2 * length(p_name))::BIGINT AS size FROM part"


#: Texts whose operations are plain to see: each as (literal or copy of length from distance) in the SQL below.
VECTORS = {"aaaa": "aaaa", "abcabc": "abcabcabcX", "none": "abcdefghij", "run": "z" * 300, "far": "abcd" + "." * 20 + "abcd"}


def yaz0_vectors(spark, sf_dir):
    files = spark.createDataFrame(list(VECTORS.items()), "name string, text string").select("name", compression.compressed(_bytes("text")).alias("content"))
    return compression.operations(files, keys=("name",)).select("name", "out_start", "kind", "byte", "offset", "length")


def _vectors_sql() -> str:
    rows = [("aaaa", 0, "literal", 97, None, 1), ("aaaa", 1, "short", None, 1, 3)]
    rows += [("abcabc", i, "literal", 97 + i, None, 1) for i in range(3)] + [("abcabc", 3, "short", None, 3, 6), ("abcabc", 9, "literal", 88, None, 1)]
    rows += [("none", i, "literal", 97 + i, None, 1) for i in range(10)]
    rows += [("run", 0, "literal", 122, None, 1), ("run", 1, "long", None, 1, 273), ("run", 274, "long", None, 274, 26)]
    rows += [("far", i, "literal", 97 + i, None, 1) for i in range(4)] + [("far", 4, "literal", 46, None, 1), ("far", 5, "long", None, 1, 19), ("far", 24, "short", None, 24, 4)]
    say = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join(f"({', '.join(map(say, r))})" for r in rows)
    return f"SELECT name, out_start::BIGINT AS out_start, kind, byte::SMALLINT AS byte, dist::INTEGER AS \"offset\", length::INTEGER AS length FROM (VALUES {values}) t(name, out_start, kind, byte, dist, length)"


def error_notes(spark, sf_dir):
    """Faults with notes: plain, with a value that may be missing, and only where a condition holds."""
    r = S.read_at(_bytes("o_orderpriority"), F.col("o_custkey") % 20, 4, "priority")
    key = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))
    noted = errors.annotated(errors.annotated(errors.annotated(r, "reading"), "customer", key), "late", when=F.col("o_custkey") % 20 > 15)
    return _table(spark, sf_dir, "orders").select("o_orderkey", noted["error"]["component"].alias("component"), noted["ok"].alias("ok"))


NOTES = """SELECT o_orderkey, CASE WHEN o_custkey % 20 + 4 > length(o_orderpriority) THEN 'priority (reading) (customer: ' || CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'unknown' END || ')' || CASE WHEN o_custkey % 20 > 15 THEN ' (late)' ELSE '' END END AS component,
  o_custkey % 20 + 4 <= length(o_orderpriority) AS ok FROM orders"""


def report_lines(spark, sf_dir):
    """The sample reports as lines."""
    return spark.createDataFrame(provenance.rendered(provenance.GALLERY, 60), "name string, number int, line string")


def _report_sql() -> str:
    lines = {
        "truncated file": [
            "truncated: the compressed data ends early",
            "  - offset 20",
            "  - length 50",
            "  - container length 11",
            "  - operation: copy",
            "  ! some diagnostics failed to load",
            "  └─ file @0 (99 bytes)",
            "     └─ blocks @16 (83 bytes)",
            "         ~~~~~",
            "         ╰──▶ yaz0.blocks",
        ],
        "unknown tag": [
            "unknown_tag: the tag names no node kind",
            "  - offset 20",
            "  - container length 64",
            "  └─ file @0 (64 bytes)",
            "     └─ key_table @16 (48 bytes)",
            "         ~~~~~~~~",
            "         ╰──▶ tag 0x13",
        ],
    }
    values = ", ".join(f"('{n}', {i}, '{x}')" for n, xs in lines.items() for i, x in enumerate(xs))
    return f"SELECT name, number::INTEGER AS number, line FROM (VALUES {values}) t(name, number, line)"


ALL = {
    "window_nested": (window_nested, NESTED),
    "head_and_tail": (head_and_tail, HALVES),
    "write_and_advance": (write_and_advance, WRITTEN),
    "records_edited": (records_edited, EDITED),
    "cursor_reads": (cursor_reads, CURSOR),
    "bits": (bits, BITS),
    "yaz0_range": (yaz0_range, RANGE),
    "yaz0_block_edits": (yaz0_block_edits, BLOCKS),
    "yaz0_vectors": (yaz0_vectors, _vectors_sql()),
    "error_notes": (error_notes, NOTES),
    "report_lines": (report_lines, _report_sql()),
}
