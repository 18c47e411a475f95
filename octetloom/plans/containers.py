"""Queries over the test tables: columns packed into containers and read back by the operators.

Each has SQL that computes the same from the table itself, so a fault in an
encoder and its decoder cannot cancel out unseen where the two orders differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octetloom.functions import hashes as H
from octetloom.functions import primitives as P
from octetloom.functions import slices as S
from octetloom.functions import text as T
from octetloom.operators import archives, compression, provenance, records, trees
from octetloom.session import spread


#: Rows that a task encodes: whole texts, and short columns.
CODED, CODED_SHORT = 2_000, 20_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def _code(r: Column) -> Column:
    return r["error"]["code"]


def swapped_u32(kind: str, wrote: str, reads: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir, "lineitem")
        return t.select("l_orderkey", "l_linenumber", P.decode(P.encode(F.col("l_orderkey"), "u32", wrote), kind, reads).alias("value"))

    return run


SWAP = """SELECT l_orderkey, l_linenumber,
  (l_orderkey % 256 * 16777216 + l_orderkey // 256 % 256 * 65536 + l_orderkey // 65536 % 256 * 256 + l_orderkey // 16777216 % 256)::BIGINT AS value FROM lineitem"""


def u24_decode(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    raw = P.encode(F.col("l_partkey") * 1001, "u32", "LE")
    return t.select("l_orderkey", "l_linenumber", P.decode(F.substring(raw, 1, 3), "u24", "LE").alias("value"))


U24 = "SELECT l_orderkey, l_linenumber, (l_partkey * 1001 % 16777216)::INTEGER AS value FROM lineitem"


def signed_decode(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    low = lambda k, e: P.decode(P.encode(cents, k, e), k, e)
    return t.select("c_custkey", *(low(k, e).cast("bigint").alias(k) for k, e in (("i8", "BE"), ("i16", "LE"), ("i32", "BE"), ("i64", "LE"))), P.decode(P.encode(cents, "i64"), "u64").cast("string").alias("u64"))


SIGNED = """WITH c AS (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS v FROM customer)
SELECT c_custkey, (((v % 256 + 384) % 256) - 128)::BIGINT AS i8, (((v % 65536 + 98304) % 65536) - 32768)::BIGINT AS i16, v AS i32, v AS i64,
  (CASE WHEN v < 0 THEN v::HUGEINT + 18446744073709551616 ELSE v::HUGEINT END)::VARCHAR AS u64 FROM c"""


def float_bits(spark, sf_dir):
    """Decoded floats as their class and, where finite, their value: balances beside NaN, infinities, subnormals and minus zero."""
    odd = F.element_at(F.array(*(F.lit(x).cast("double") for x in ("NaN", "Infinity", "-Infinity", "1e-310", "-1e-42", "-0.0"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    t = _table(spark, sf_dir, "supplier").withColumn("v", F.when(F.col("s_suppkey") % 2 == 0, odd).otherwise(F.col("s_acctbal")))
    cols = []
    for k in ("f32", "f64"):
        for e in ("BE", "LE"):
            x = P.decode(P.encode(F.col("v"), k, e), k, e).cast("double")
            finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
            cols += [F.when(F.isnan(x), "nan").when(~finite, F.when(x > 0, "inf").otherwise("-inf")).alias(f"{k}_{e.lower()}_odd"), F.when(finite, x).alias(f"{k}_{e.lower()}")]
    sign = F.hex(F.substring(P.encode(F.col("v"), "f64"), 1, 1)).alias("first_byte")
    return t.select("s_suppkey", *cols, F.when(~F.isnan("v"), sign).alias("first_byte"), P.decode(P.encode(F.col("s_acctbal") > 0, "bool"), "bool").alias("positive"))


def _floats_sql() -> str:
    cols = []
    for k, kind in (("f32", "FLOAT"), ("f64", "DOUBLE")):
        for e in ("be", "le"):
            x = f"v::{kind}::DOUBLE"
            cols.append(f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END END AS {k}_{e}_odd, CASE WHEN isfinite({x}) THEN {x} END AS {k}_{e}")
    odd = "(['NaN'::DOUBLE, 'Infinity'::DOUBLE, '-Infinity'::DOUBLE, 1e-310, -1e-42, -0.0::DOUBLE])[(s_suppkey % 6 + 1)::BIGINT]"
    # Of a finite double other than these, the first byte follows from its sign and the binary exponent.
    first = """CASE WHEN NOT isnan(v) THEN CASE WHEN isinf(v) THEN CASE WHEN v > 0 THEN '7F' ELSE 'FF' END WHEN s_suppkey % 6 = 4 AND s_suppkey % 2 = 0 THEN 'B7'
      WHEN abs(v) < 1e-300 THEN CASE WHEN signbit(v) THEN '80' ELSE '00' END
      ELSE printf('%02X', (CASE WHEN v < 0 THEN 128 ELSE 0 END + (floor(log2(abs(v)))::BIGINT + 1023) // 16)::BIGINT) END END AS first_byte"""
    return f"SELECT s_suppkey, {', '.join(cols)}, {first}, s_acctbal > 0 AS positive FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN {odd} ELSE s_acctbal END AS v FROM supplier)"


FLOATS = _floats_sql()


def slice_bounds(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    r = S.read_at(_bytes("o_orderpriority"), F.col("o_custkey") % 20, 4)
    return t.select("o_orderkey", r["value"].cast("string").alias("value"), _code(r).alias("code"))


BOUNDS = """SELECT o_orderkey, CASE WHEN o_custkey % 20 + 4 <= length(o_orderpriority) THEN substr(o_orderpriority, (o_custkey % 20 + 1)::BIGINT, 4) END AS value,
  CASE WHEN o_custkey % 20 + 4 > length(o_orderpriority) THEN 'out_of_bounds' END AS code FROM orders"""


def cursor_moves(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").join(F.broadcast(_table(spark, sf_dir, "region").where("r_regionkey = 0")))
    n = F.length(_bytes("l_returnflag")) + F.length(_bytes("r_name"))
    skip = S.moved(F.lit(3), F.col("l_linenumber"), n)
    back = S.rewound(F.col("l_linenumber"), 4)
    seek = S.sought(F.col("l_linenumber") * 2, n)
    restore = S.restored(F.col("l_linenumber"), F.lit(4))
    return t.select("l_orderkey", "l_linenumber", (n - skip["value"]).alias("remaining"), _code(skip).alias("skip_code"), back["value"].alias("rewound"), _code(back).alias("rewind_code"), seek["value"].alias("sought"), _code(seek).alias("seek_code"), restore["value"].alias("restored"), _code(restore).alias("restore_code"))


MOVES = """WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS k, (length(l_returnflag) + length(r_name))::BIGINT AS n FROM lineitem, region WHERE r_regionkey = 0)
SELECT l_orderkey, l_linenumber, CASE WHEN 3 + k <= n THEN n - 3 - k END AS remaining, CASE WHEN 3 + k > n THEN 'out_of_bounds' END AS skip_code,
  CASE WHEN k >= 4 THEN k - 4 END AS rewound, CASE WHEN k < 4 THEN 'offset_underflow' END AS rewind_code,
  CASE WHEN 2 * k <= n THEN 2 * k END AS sought, CASE WHEN 2 * k > n THEN 'out_of_bounds' END AS seek_code,
  CASE WHEN 4 <= k THEN 4::BIGINT END AS restored, CASE WHEN 4 > k THEN 'restore_forwards' END AS restore_code FROM t"""


def partition_split(spark, sf_dir):
    r = S.parted(_bytes("p_type"), 3)
    return _table(spark, sf_dir, "part").select("p_partkey", r["value"]["left"].cast("string").alias("head"), r["value"]["right"].cast("string").alias("tail"), F.length(r["value"]["right"]).alias("tail_bytes"))


PARTED = "SELECT p_partkey, p_type[1:3] AS head, p_type[4:] AS tail, (length(p_type) - 3)::INTEGER AS tail_bytes FROM part"


def region_resize(spark, sf_dir):
    grow, shrink, past = (S.resized(_bytes("p_brand"), *a) for a in ((1, 2, 5), (0, 4, 2), (4, 3 + F.col("p_size"), 1)))
    return _table(spark, sf_dir, "part").select("p_partkey", F.hex(grow["value"]).alias("grown"), F.hex(shrink["value"]).alias("shrunk"), _code(past).alias("code"))


RESIZE = """SELECT p_partkey, hex(encode(p_brand[1:3])) || '000000' || hex(encode(p_brand[4:])) AS grown, hex(encode(p_brand[1:2] || p_brand[5:])) AS shrunk,
  CASE WHEN 7 + p_size > length(p_brand) THEN 'out_of_bounds' END AS code FROM part"""


def region_overlay(spark, sf_dir):
    same = S.mutated(_bytes("c_mktsegment"), 2, _bytes(F.lit("xy")))
    other = S.overwritten(_bytes("c_mktsegment"), 1, 3, _bytes(F.col("c_name")))
    kept = S.committed(F.col("c_acctbal") > 0, same["value"], _bytes("c_mktsegment"))
    return _table(spark, sf_dir, "customer").select("c_custkey", same["value"].cast("string").alias("mutated"), other["value"].cast("string").alias("overwritten"), kept.cast("string").alias("committed"))


OVERLAY = """SELECT c_custkey, c_mktsegment[1:2] || 'xy' || c_mktsegment[5:] AS mutated, c_mktsegment[1:1] || c_name || c_mktsegment[5:] AS overwritten,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment[1:2] || 'xy' || c_mktsegment[5:] ELSE c_mktsegment END AS committed FROM customer"""


def magic_check(spark, sf_dir):
    brand, kind = T.magic(_bytes("p_brand"), b"Brand"), T.magic(_bytes("p_type"), b"STAND")
    return _table(spark, sf_dir, "part").select("p_partkey", brand["ok"].alias("brand"), kind["ok"].alias("standard"), _code(kind).alias("code"))


MAGIC = "SELECT p_partkey, starts_with(p_brand, 'Brand') AS brand, starts_with(p_type, 'STAND') AS standard, CASE WHEN length(p_type) < 5 THEN 'exhausted' WHEN NOT starts_with(p_type, 'STAND') THEN 'bad_magic' END AS code FROM part"


def bom_detect(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    r = T.byte_order(F.when(k == 0, F.lit(b"\xfe\xff")).when(k == 1, F.lit(b"\xff\xfe")).when(k == 2, F.lit(b"\xfe")).otherwise(F.lit(b"BY")))
    return _table(spark, sf_dir, "nation").select("n_nationkey", r["value"].alias("endian"), P.swap(r["value"]).alias("swapped"), _code(r).alias("code"))


BOM = """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'BE' WHEN 1 THEN 'LE' END AS endian, CASE n_nationkey % 4 WHEN 0 THEN 'LE' WHEN 1 THEN 'BE' END AS swapped,
  CASE n_nationkey % 4 WHEN 2 THEN 'exhausted' WHEN 3 THEN 'bad_byte_order_mark' END AS code FROM nation"""


def read_until(spark, sf_dir):
    r, none = S.until(_bytes("c_name"), _bytes(F.lit("#"))), S.until(_bytes("c_name"), F.lit(b"\0"), 2)
    return _table(spark, sf_dir, "customer").select("c_custkey", r["value"].cast("string").alias("head"), r["terminated"].alias("terminated"), none["value"].cast("string").alias("rest"), none["terminated"].alias("rest_terminated"))


UNTIL = "SELECT c_custkey, split_part(c_name, '#', 1) AS head, contains(c_name, '#') AS terminated, c_name[3:] AS rest, false AS rest_terminated FROM customer"


def latin1_len(spark, sf_dir):
    r = T.encoded(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(r["value"]).cast("bigint").alias("n_bytes"), F.md5(_bytes(T.decoded(r["value"]))).alias("md5"), _code(r).alias("code"))


LATIN1 = """SELECT doc_id, CASE WHEN NOT wide THEN length(text) END::BIGINT AS n_bytes, CASE WHEN NOT wide THEN md5(text) END AS md5, CASE WHEN wide THEN 'unmappable_character' END AS code
FROM (SELECT *, regexp_matches(text, '[^\\x{00}-\\x{FF}]') AS wide FROM documents)"""


def name_hash(signed: bool):
    """The hash of the whole text and source, and of the source by a multiplier near 2^32."""

    def run(spark, sf_dir):
        t = spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
        return t.select("doc_id", H.text_hash(_bytes(F.concat("text", "source")), signed=signed).alias("hash"), H.name_hash(_bytes("source"), 0xFFFFFFFF, signed).alias("wide"))

    return run


def _hash_sql(signed: bool) -> str:
    """Each byte times the multiplier to the power of how many follow, summed; powers by their binary digits, each step modulo 2^32."""

    def one(raw: str, m: int) -> str:
        byte = "('0x' || hexed)::BIGINT"
        byte = f"CASE WHEN {byte} > 127 THEN {byte} - 256 ELSE {byte} END" if signed else byte
        power = "1::HUGEINT"
        for i in range(24):
            power = f"({power} * CASE WHEN later >> {i} & 1 = 1 THEN {pow(m, 1 << i, 1 << 32)} ELSE 1 END % 4294967296)"
        parts = f"SELECT doc_id, len(b) AS n, unnest(b) AS hexed, len(b) - generate_subscripts(b, 1) AS later FROM (SELECT doc_id, regexp_extract_all(hex(encode({raw})), '..') AS b FROM documents)"
        return f"(SELECT doc_id, ((sum(({byte}) * {power}) % 4294967296 + 4294967296) % 4294967296)::BIGINT AS h FROM ({parts}) GROUP BY doc_id)"

    return f"""SELECT doc_id, CASE WHEN text IS NOT NULL AND source IS NOT NULL THEN coalesce(a.h, 0) END AS hash, CASE WHEN source IS NOT NULL THEN coalesce(b.h, 0) END AS wide
FROM documents LEFT JOIN {one('(text || source)', 101)} a USING (doc_id) LEFT JOIN {one('source', 4294967295)} b USING (doc_id)"""


def name_hash_text(signed: bool):
    """Only the hash of the whole text and source."""
    return lambda spark, sf_dir: name_hash(signed)(spark, sf_dir).select("doc_id", "hash")


def name_hash_collisions(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select("p_name", H.name_hash(_bytes("p_name"), 1).alias("hash")).distinct()
    return t.groupBy("hash").agg(F.count("*").alias("names"), F.min("p_name").alias("first")).where("names > 1")


COLLISIONS = """WITH h AS (SELECT DISTINCT p_name, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, octet_length(encode(p_name)) + 1), lambda i: ('0x' || hex(encode(p_name))[2 * i - 1:2 * i])::HUGEINT)), lambda h, x: (h + x) % 4294967296)::BIGINT AS hash FROM part)
SELECT hash, count(*) AS names, min(p_name) AS first FROM h GROUP BY hash HAVING count(*) > 1"""


def attr_unpack(spark, sf_dir):
    word = (F.col("l_linenumber") - 1) * 16777216 + F.col("l_partkey")
    a = H.unpacked_attributes(F.when(F.col("l_linenumber") == 2, F.lit(0)).otherwise(word))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a["sequence"].cast("int").alias("sequence"), a["index"].alias("hash_index"), a["error"].alias("code"))


ATTRS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_linenumber - 1 END::INTEGER AS sequence, CASE WHEN l_linenumber > 2 THEN l_partkey END::INTEGER AS hash_index,
  CASE WHEN l_linenumber = 1 AND l_partkey > 0 THEN 'zero_sequence' END AS code FROM lineitem"""


def _order_records(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    fields = {"filename_hash": (F.col("l_partkey"), "u32"), "attributes": (F.col("l_linenumber") * 16777216 + F.col("l_suppkey"), "u32"), "start_offset": (F.col("l_quantity").cast("bigint"), "u32"), "end_offset": (F.lit(7), "u32")}
    return records.packed(t, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], fields, "LE")


def fixed_record_scan(spark, sf_dir):
    out = records.entries(_order_records(spark, sf_dir), "content", "LE")
    return out.select("l_orderkey", "idx", "filename_hash", F.col("sequence").cast("int").alias("sequence"), "hash_index", "start_offset", "end_offset")


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS n FROM lineitem"
SCAN = f"""SELECT l_orderkey, n::INTEGER AS idx, l_partkey AS filename_hash, l_linenumber::INTEGER AS sequence, l_suppkey::INTEGER AS hash_index, trunc(l_quantity)::BIGINT AS start_offset, 7::BIGINT AS end_offset FROM ({_NUMBERED})"""


def fixed_record_window(spark, sf_dir):
    return records.records(_order_records(spark, sf_dir), "content", records.ENTRY_FIELDS, "LE", first=2, count=2).select("l_orderkey", "idx", "filename_hash")


WINDOW = f"SELECT l_orderkey, n::INTEGER AS idx, l_partkey AS filename_hash FROM ({_NUMBERED}) WHERE n IN (2, 3)"


def _archives(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("f"))
    names = F.transform("f", lambda x: _bytes(x["n_name"]))
    return t.select("n_regionkey", archives.packed(names, F.transform("f", lambda x: _bytes(F.repeat(x["n_name"], x["n_nationkey"])))).alias("content"))


def hash_lookup_join(spark, sf_dir):
    table = records.entries(_archives(spark, sf_dir), "content", start=32, count=None)
    table = table.where("end_offset >= start_offset AND hash_index IS NOT NULL AND sequence = 1")
    names = _table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("name"))
    return records.by_name(table, names, keys=("n_regionkey",)).select("n_regionkey", "name", (F.col("end_offset") - F.col("start_offset")).alias("size"))


LOOKUP = "SELECT n_regionkey, n_name AS name, (length(n_name) * n_nationkey)::BIGINT AS size FROM nation"


def archive_members(spark, sf_dir):
    files = _archives(spark, sf_dir)
    out = archives.members(files, keys=("n_regionkey",)).where("error IS NULL")
    return out.select("n_regionkey", F.col("name").cast("string").alias("name"), F.col("data").cast("string").alias("data"))


MEMBERS = "SELECT n_regionkey, n_name AS name, repeat(n_name, n_nationkey::BIGINT) AS data FROM nation"


def archive_headers(spark, sf_dir):
    files = _archives(spark, sf_dir)
    h, t = archives.header(F.col("content")), archives.table_header(F.col("content"))
    return files.select("n_regionkey", h["value"]["endian"].alias("endian"), T.version_text(h["value"]["version"]).alias("version"), (h["value"]["size"] - h["value"]["data_offset"]).alias("data_bytes"), t["value"]["count"].alias("entries"), t["value"]["multiplier"].alias("multiplier"))


HEADERS = "SELECT n_regionkey, 'BE' AS endian, 'v1.0' AS version, sum(length(n_name) * n_nationkey)::BIGINT AS data_bytes, count(*)::INTEGER AS entries, 101::BIGINT AS multiplier FROM nation GROUP BY n_regionkey"


def _nation_trees(spark, sf_dir, endian: str = "BE") -> DataFrame:
    t = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_name")).alias("names"))
    return t.select("c_nationkey", trees.packed(F.transform("names", _bytes), endian).alias("content"))


def string_table_explode(spark, sf_dir):
    out = trees.strings(_nation_trees(spark, sf_dir, "LE"), keys=("c_nationkey",))
    return out.where("error IS NULL").select("c_nationkey", "idx", "value", "unterminated")


STRINGS = "SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS idx, c_name AS value, false AS unterminated FROM customer"


def string_table_lookup(spark, sf_dir):
    files = _nation_trees(spark, sf_dir)
    r = trees.string_at(F.col("content"), F.col("c_nationkey") * 4)
    return files.select("c_nationkey", T.decoded(r["value"]).alias("value"), _code(r).alias("code"))


TABLE_AT = """WITH s AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS idx, c_name FROM customer)
SELECT c_nationkey, max(c_name) FILTER (idx = c_nationkey * 4) AS value, CASE WHEN count(*) <= c_nationkey * 4 THEN 'index_out_of_range' END AS code FROM s GROUP BY c_nationkey"""


def tree_headers(spark, sf_dir):
    be, le = _nation_trees(spark, sf_dir), _nation_trees(spark, sf_dir, "LE")
    h = trees.header(F.col("content"))["value"]
    return be.unionByName(le).select("c_nationkey", h["endian"].alias("endian"), h["version"].alias("version"), h["key_table_offset"].alias("key_table_offset"), h["string_table_offset"].alias("string_table_offset"))


TREE_HEADERS = "SELECT DISTINCT c_nationkey, e AS endian, 1 AS version, 16::BIGINT AS key_table_offset, NULL::BIGINT AS string_table_offset FROM customer, (VALUES ('BE'), ('LE')) t(e)"


def tag_version_gate(spark, sf_dir):
    tags = F.element_at(F.array(*(F.lit(t) for t in (0xA0, 0xA1, 0xA2, 0xD3, 0xD4, 0xFF, 0x00, 0xC3))), (F.col("p_partkey") % 8 + 1).cast("int"))
    r = trees.node_kind(tags, F.col("p_size") % 6)
    return _table(spark, sf_dir, "part").select("p_partkey", r["value"].alias("node"), _code(r).alias("code"))


GATE = """WITH t(k, name, first) AS (VALUES (0, 'String', 1), (1, 'BinaryData', 4), (2, 'BinaryDataWithParameter', 5), (3, 'UnsignedInteger32', 2), (4, 'Integer64', 3), (5, 'Null', 1), (6, NULL, 0), (7, 'BinaryDataTable', 99))
SELECT p_partkey, CASE WHEN p_size % 6 >= first THEN name END AS node, CASE WHEN name IS NULL THEN 'unknown_tag' WHEN p_size % 6 < first THEN 'tag_needs_newer_version' END AS code FROM part JOIN t ON p_partkey % 8 = k"""


def node_scalars(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("String", "Bool", "Integer32", "UnsignedInteger32", "Null", "Array"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    v = trees.node_value(kinds, F.pmod(F.lit(2147483648) + F.col("o_custkey") * (F.col("o_orderkey") % 3), F.lit(4294967296)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", v["number"].alias("number"), v["bool"].alias("bool"), v["not_constructible"].alias("not_constructible"))


SCALARS = """WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, (2147483648 + o_custkey * (o_orderkey % 3)) % 4294967296 AS w FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 3) THEN w WHEN k = 2 THEN w - 4294967296 END::BIGINT AS number, CASE WHEN k = 1 THEN w <> 0 END AS bool, k = 5 AS not_constructible FROM t"""


def yaz0_roundtrip(spark, sf_dir):
    r = compression.decompressed(compression.compressed(_bytes("text"), 64))
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), CODED).select("doc_id", F.length(r["value"]).cast("bigint").alias("n_bytes"), F.md5(r["value"]).alias("md5"))


ROUND = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS md5 FROM documents"


def yaz0_splice(spark, sf_dir):
    t = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), CODED_SHORT).withColumn("raw", _bytes(F.concat("p_name", "p_type")))
    r = compression.spliced(compression.compressed(F.col("raw")), F.lit(2), F.lit(5), _bytes("p_brand"))
    back = compression.decompressed(r["value"])
    return t.select("p_partkey", back["value"].cast("string").alias("value"))


SPLICE = "SELECT p_partkey, p_name[1:2] || p_brand || (p_name || p_type)[8:] AS value FROM part"


def yaz0_headers(spark, sf_dir):
    t = spread(_table(spark, sf_dir, "documents").select("doc_id", "source"), CODED_SHORT).withColumn("raw", compression.compressed(_bytes("source"), 32, "LE"))
    h = compression.header(compression.with_header(F.col("raw"), alignment=F.col("doc_id"), endian="LE"), "LE")["value"]
    return t.select("doc_id", h["decompressed_size"].alias("decompressed_size"), h["alignment"].alias("alignment"), compression.is_compressed(F.col("raw")).alias("is_compressed"))


LZ_HEADERS = "SELECT doc_id, octet_length(encode(source))::BIGINT AS decompressed_size, doc_id AS alignment, true AS is_compressed FROM documents"


def yaz0_op_stats(spark, sf_dir):
    t = spread(_table(spark, sf_dir, "pages").select("page_id", "html"), CODED).select("page_id", compression.compressed(_bytes("html")).alias("content"))
    out = compression.operations(t, keys=("page_id",))
    return out.groupBy("page_id").agg(F.sum("length").alias("n_bytes"), *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("literal", "short", "long")))


def hex_format(spark, sf_dir):
    k = F.col("o_orderkey") * 7919
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.formatted(k, 16, 10, prefix="0x").alias("hexed"), T.formatted(k, 10, group=3, separator=",").alias("grouped"), T.formatted(k, 2, upper=False).alias("binary"), T.version_text(T.version_word(F.pmod(k, F.lit(65536)))).alias("version"))


FORMATS = """SELECT o_orderkey, '0x' || lpad(upper(to_hex(o_orderkey * 7919)), greatest(10, length(to_hex(o_orderkey * 7919)))::INTEGER, '0') AS hexed, format('{:,}', o_orderkey * 7919) AS grouped,
  to_base(o_orderkey * 7919, 2) AS binary, 'v' || (o_orderkey * 7919 % 65536 // 256) || '.' || (o_orderkey * 7919 % 256) AS version FROM orders"""


def raw_render(spark, sf_dir):
    b = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(b"\xff"), _bytes("c_name"))).otherwise(_bytes("c_name"))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.raw_text(b).alias("rendered"))


RAW = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0xFF' || hex(encode(c_name)) ELSE 'b''' || c_name || '''' END AS rendered FROM customer"


def hexdump_rows(spark, sf_dir):
    return records.hex_dump(_table(spark, sf_dir, "part").select("p_partkey", _bytes("p_name").alias("content")), "content")


HEXDUMP = "SELECT p_partkey, r::INTEGER AS row, upper(to_hex(r)) AS label, hex(encode(p_name[16 * r + 1:16 * r + 16])) AS bytes FROM (SELECT *, unnest(range(0, (length(p_name) + 15) // 16)) AS r FROM part)"


def _places(spark, sf_dir) -> DataFrame:
    r = _table(spark, sf_dir, "region").select((-F.col("r_regionkey") - 1).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent"))
    n = _table(spark, sf_dir, "nation").select((1_000_000_000 + F.col("n_nationkey")).cast("bigint").alias("id"), (-F.col("n_regionkey") - 1).cast("bigint").alias("parent"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (1_000_000_000 + F.col("c_nationkey")).cast("bigint").alias("parent"))
    return r.unionByName(n).unionByName(c)


def ancestor_path(spark, sf_dir):
    return provenance.ancestors(_places(spark, sf_dir))


ANCESTORS = """WITH RECURSIVE nodes AS (
  SELECT (-r_regionkey - 1)::BIGINT AS id, NULL::BIGINT AS parent FROM region UNION ALL
  SELECT (1000000000 + n_nationkey)::BIGINT, (-n_regionkey - 1)::BIGINT FROM nation UNION ALL
  SELECT c_custkey, (1000000000 + c_nationkey)::BIGINT FROM customer),
up AS (SELECT id, id AS ancestor, 0 AS distance FROM nodes UNION ALL
  SELECT up.id, n.parent, up.distance + 1 FROM up JOIN nodes n ON up.ancestor = n.id WHERE n.parent IS NOT NULL)
SELECT id, ancestor, distance FROM up"""


def _torn(spark, sf_dir) -> DataFrame:
    """The same places with a third of the customers hanging on others, some of which are missing."""
    own = _places(spark, sf_dir)
    c = F.col("id")
    return own.select("id", F.when((c > 0) & (c < 1_000_000_000) & (c % 3 == 0), c - 1 - (c % 2) * 500_000_000).otherwise(F.col("parent")).alias("parent"))


_NODES = ANCESTORS.split("up AS")[0]
_TORN = _NODES.replace("nodes AS (", "whole AS (").rstrip().rstrip(",") + """,
nodes AS (SELECT id, CASE WHEN id > 0 AND id < 1000000000 AND id % 3 = 0 THEN id - 1 - (id % 2) * 500000000 ELSE parent END AS parent FROM whole),
"""


def lineage(spark, sf_dir):
    return provenance.lineage(_torn(spark, sf_dir))


LINEAGE = _TORN + """up AS (SELECT id, id AS at, 0 AS depth FROM nodes UNION ALL
  SELECT up.id, p.id, up.depth + 1 FROM up JOIN nodes n ON up.at = n.id JOIN nodes p ON n.parent = p.id)
SELECT up.id, arg_max(up.at, up.depth) AS root, max(up.depth)::BIGINT AS depth, arg_max(n.parent IS NULL, up.depth) AS family_exists FROM up JOIN nodes n ON up.at = n.id GROUP BY up.id"""


def parent_exists(spark, sf_dir):
    return provenance.parents(_torn(spark, sf_dir))


PARENTS = _TORN.rstrip().rstrip(",") + """
SELECT n.id, n.parent, p.id IS NOT NULL AS exists FROM nodes n LEFT JOIN nodes p ON n.parent = p.id WHERE n.parent IS NOT NULL"""


def value_paths(spark, sf_dir):
    path = provenance.child(provenance.child(provenance.child(None, "file"), F.col("o_orderstatus"), F.col("o_custkey"), F.lit(8)), provenance.index_name(F.col("o_orderkey") % 200), F.col("o_orderkey") % 7)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(path, lambda p: p["name"]), "/").alias("path"), provenance.absolute_offset(path).alias("offset"), provenance.clipped_name(F.col("o_orderpriority"), 6).alias("clipped"))


PATHS = """SELECT o_orderkey, 'file/' || o_orderstatus || '/[' || (o_orderkey % 200) || ']' AS path, (o_custkey + o_orderkey % 7)::BIGINT AS "offset",
  CASE WHEN length(o_orderpriority) > 6 THEN o_orderpriority[1:5] || '…' ELSE o_orderpriority END AS clipped FROM orders"""


def end_to_end(spark, sf_dir):
    """Compressed tree containers, one per brand, decoded to one row per string."""
    t = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("items"))
    files = t.select("p_brand", compression.compressed(trees.packed(F.transform("items", lambda x: _bytes(x["p_name"])))).alias("packed"))
    decoded = compression.decompressed(F.col("packed"))
    opened = files.select("p_brand", decoded["value"].alias("content"))
    return trees.strings(opened, keys=("p_brand",)).where("error IS NULL").select("p_brand", "idx", "value")


END_TO_END = "SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) - 1)::INTEGER AS idx, p_name AS value FROM part"

#: Name to query and SQL (None: beyond SQL; tested against vectors).
ALL = {
    "u32_be_decode": (swapped_u32("u32", "LE", "BE"), SWAP),
    "u32_le_decode": (swapped_u32("u32", "BE", "LE"), SWAP),
    "u24_decode": (u24_decode, U24),
    "signed_decode": (signed_decode, SIGNED),
    "float_bits": (float_bits, FLOATS),
    "slice_bounds": (slice_bounds, BOUNDS),
    "cursor_moves": (cursor_moves, MOVES),
    "partition_split": (partition_split, PARTED),
    "region_resize": (region_resize, RESIZE),
    "region_overlay": (region_overlay, OVERLAY),
    "magic_check": (magic_check, MAGIC),
    "bom_detect": (bom_detect, BOM),
    "read_until": (read_until, UNTIL),
    "latin1_len": (latin1_len, LATIN1),
    "name_hash_signed": (name_hash(True), _hash_sql(True)),
    "name_hash_unsigned": (name_hash(False), _hash_sql(False)),
    "name_hash_text_signed": (name_hash_text(True), f"SELECT doc_id, hash FROM ({_hash_sql(True)})"),
    "name_hash_text_unsigned": (name_hash_text(False), f"SELECT doc_id, hash FROM ({_hash_sql(False)})"),
    "name_hash_collisions": (name_hash_collisions, COLLISIONS),
    "attr_unpack": (attr_unpack, ATTRS),
    "fixed_record_scan": (fixed_record_scan, SCAN),
    "fixed_record_window": (fixed_record_window, WINDOW),
    "hash_lookup_join": (hash_lookup_join, LOOKUP),
    "archive_members": (archive_members, MEMBERS),
    "archive_headers": (archive_headers, HEADERS),
    "string_table_explode": (string_table_explode, STRINGS),
    "string_table_lookup": (string_table_lookup, TABLE_AT),
    "tree_headers": (tree_headers, TREE_HEADERS),
    "tag_version_gate": (tag_version_gate, GATE),
    "node_scalars": (node_scalars, SCALARS),
    "yaz0_roundtrip": (yaz0_roundtrip, ROUND),
    "yaz0_splice": (yaz0_splice, SPLICE),
    "yaz0_headers": (yaz0_headers, LZ_HEADERS),
    "yaz0_op_stats": (yaz0_op_stats, None),
    "hex_format": (hex_format, FORMATS),
    "raw_render": (raw_render, RAW),
    "hexdump_rows": (hexdump_rows, HEXDUMP),
    "ancestor_path": (ancestor_path, ANCESTORS),
    "lineage": (lineage, LINEAGE),
    "parent_exists": (parent_exists, PARENTS),
    "value_paths": (value_paths, PATHS),
    "end_to_end": (end_to_end, END_TO_END),
}
