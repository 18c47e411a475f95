"""Every registered query outside the optional subpackage agrees with its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from octetloom.codec import archive, lz
from octetloom.errors import DecodeError, strict
from octetloom.functions import primitives as P
from octetloom.functions import slices as S
from octetloom.functions import text as T
from octetloom.operators import archives, compression, provenance, records, trees
from octetloom.plans import containers, edits, registry

TABLES = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(TABLES))
    want = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*cols).collect()]
    assert sorted(rows, key=str) == sorted([tuple(map(plain, r)) for r in want.fetchall()], key=str)


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} binary" if isinstance(v, bytes | None.__class__) else f"{k} int" for k, v in values.items()))
    return row.select(*cols).first()


# Plain inputs and results of byte-buffer edits, as FIXTURES.md §1 lists them.
BUFFER = bytes(range(10, 16))


@pytest.mark.parametrize(
    "raw,args,want",
    [
        (b"ABCDE", (2, 3, 3), b"ABCDE"),
        (bytes([0, 1, 2, 10, 11, 3, 4, 5, 6]), (3, 2, 5), bytes([0, 1, 2, 10, 11, 0, 0, 0, 3, 4, 5, 6])),
        (bytes([0, 1, 2, 10, 11, 12, 13, 14, 3, 4, 5]), (3, 5, 2), bytes([0, 1, 2, 10, 11, 3, 4, 5])),
        (bytes([9, 8, 7, 6]), (0, 1, 4), bytes([9, 0, 0, 0, 8, 7, 6])),
        (bytes([1, 2, 3, 4, 5]), (0, 4, 2), bytes([1, 2, 5])),
        (bytes([1, 2, 3, 4]), (3, 1, 3), bytes([1, 2, 3, 4, 0, 0])),
        (bytes([1, 2, 3, 4, 5, 6]), (2, 4, 1), bytes([1, 2, 3])),
        (bytes([1, 2, 3, 4]), (3, 2, 4), None),
    ],
)
def test_resize(spark, raw, args, want):
    r = one(spark, S.resized(F.col("b"), *args).alias("r"), b=raw).r
    assert (None if r.value is None else bytes(r.value)) == want and r.ok == (want is not None)


def test_reads_windows_and_edits(spark):
    b = F.col("b")
    r = one(spark, S.read_at(b, 3, 3).alias("a"), S.read_at(b, 4, 3).alias("past"), S.read_at(b, 6, 0).alias("end"), S.window(S.window(b, 1, 4)["value"], 2).alias("w"), S.mutated(b, 2, F.lit(b"\x09\x08")).alias("m"), S.mutated(b, 4, F.lit(b"123")).alias("mp"), S.read_at(b, (1 << 62), (1 << 62)).alias("big"), b=BUFFER)
    assert bytes(r.a.value) == BUFFER[3:] and r.past.error.code == "out_of_bounds" and bytes(r.end.value) == b"" and bytes(r.w.value) == BUFFER[3:5]
    assert bytes(r.m.value) == BUFFER[:2] + b"\x09\x08" + BUFFER[4:] and r.mp.value is None and r.big.error.code == "out_of_bounds"
    null = one(spark, S.read_at(F.col("b"), 0, 1).alias("a"), T.magic(F.col("b"), b"x").alias("m"), compression.decompressed(F.col("b")).alias("d"), b=None)
    assert null.a.value is null.m.value is None and null.d is None


def test_short_bytes_decode_to_null(spark):
    kinds = list(P.TYPES)
    r = one(spark, *(P.decode(F.col("b"), k).alias(k) for k in kinds if k not in ("u8", "i8", "bool")), P.decode(F.col("b"), "i8").alias("i8"), b=b"\x80")
    assert r.i8 == -128 and all(r[k] is None for k in kinds if k not in ("u8", "i8", "bool"))


def test_wide_integers_keep_their_bytes(spark):
    raw = bytes(range(16))
    r = one(spark, P.decode(F.col("b"), "u128").alias("be"), P.decode(F.col("b"), "u128", "LE").alias("le"), P.decode(F.col("b"), "u64").alias("u64"), b=raw)
    assert bytes(r.be) == raw and bytes(r.le) == raw[::-1] and int(r.u64) == int.from_bytes(raw[:8], "big")


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="out_of_bounds"):
        one(spark, strict(S.read_at(F.col("b"), 9, 9)), b=BUFFER)


def test_faulty_containers_are_rows(spark):
    df = spark.createDataFrame([(1, b"YB"), (2, b"BY" + bytes(14)), (3, None), (4, b"BY\0\1\0\0\0\x10" + bytes(8) + b"\xc2\0\0\1")], "id int, content binary")
    got = {r.id: (r.error and r.error.code) for r in trees.strings(df, keys=("id",)).collect()}
    assert got == {1: "exhausted", 4: "exhausted"}
    assert [r.error.code for r in archives.members(df.where("id = 1"), keys=("id",)).collect()] == ["exhausted"]
    heads = df.where("id = 2").select(trees.header(F.col("content")).alias("t"), archives.header(F.col("content")).alias("a"), compression.header(F.col("content")).alias("z")).first()
    assert heads.t.value.key_table_offset is None and heads.a.error.code == "exhausted" and heads.z.error.code == "bad_magic"
    assert compression.operations(df, keys=("id",)).count() == 0


def test_operation_rows_follow_the_blocks(spark):
    from octetloom.codec import lz

    body = lz.packed_ops([(65, 0, 1), (None, 1, 5), (None, 1, 40)])
    df = spark.createDataFrame([(7, lz.Header(46).pack() + body)], "id int, content binary")
    rows = [(r.kind, r.byte, r.offset, r.length, r.out_start) for r in compression.operations(df, keys=("id",)).orderBy("out_start").collect()]
    assert rows == [("literal", 65, None, 1, 0), ("short", None, 1, 5, 1), ("long", None, 1, 40, 6)]


def test_records_skip_what_is_outside(spark):
    df = spark.createDataFrame([(1, bytes(range(10))), (2, b""), (3, None)], "id int, content binary")
    got = records.records(df, "content", {"a": "u16", "b": "u8"}, first=1, count=5)
    assert [(r.id, r.idx, r.a, r.b) for r in got.orderBy("idx").collect()] == [(1, 1, 0x0304, 5), (1, 2, 0x0607, 8)]


def test_reports_render(spark):
    e = DecodeError("truncated", "yaz0.blocks", 20, 50, 11, (("file", "physical", 0, 99), ("blocks", "physical", 16, 83)))
    lines = provenance.Report.of(e).render(40).splitlines()
    assert lines[0] == "truncated: the compressed data ends" and max(map(len, lines)) <= 40 and any("blocks @16" in x for x in lines)
    assert "<b>" in provenance.Report.of(e).render(style="html")


def test_number_formats(spark):
    f = lambda v, **k: T.formatted(F.lit(v), **k)
    r = spark.range(1).select(*(f(v, group=3, separator=",").alias(f"v{v}") for v in (0, 12, 123, 1234, 123456, 1234567)), f(255, base=36, upper=False).alias("z")).first()
    assert list(r) == ["0", "12", "123", "1,234", "123,456", "1,234,567", "73"]


def test_entry_has_rows(spark):
    out = registry.flagship(spark, str(TABLES))
    assert out.columns == ["p_brand", "idx", "value"] and out.count() == 200


def test_plans_push_down(spark):
    plan = containers.u24_decode(spark, str(TABLES))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in plan and "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("signed", [True, False])
def test_whole_texts_are_hashed(spark, tmp_path, signed):
    head = "one head of more than twenty-four points "
    texts = [head + "a", head + "b", head + "é" * 5000, "x" * 4096, "y" * 8191, "", None]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in registry.queries()["name_hash_text_signed" if signed else "name_hash_text_unsigned"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else archive.name_hash((t + "web").encode(), signed=signed) for i, t in enumerate(texts)}


def test_walks_have_no_limit_of_rows_or_depth(spark):
    wide = spark.range(1, 2_000_001).selectExpr("id", "CASE WHEN id > 1 THEN (id + 998) DIV 1000 END AS parent")
    chain = spark.range(3_000_000, 3_000_501).selectExpr("id", "CASE WHEN id > 3000000 THEN id - 1 END AS parent")
    nodes = wide.unionByName(chain)
    out = provenance.ancestors(nodes)
    assert out.where("id >= 3000000").count() == 501 * 502 // 2 and out.where("id < 3000000").count() > 5_900_000
    tops = provenance.lineage(nodes)
    assert tops.where("id = 3000500").first()["depth"] == 500 and tops.where("root NOT IN (1, 3000000) OR NOT family_exists").count() == 0
    ring = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    for walk in (provenance.ancestors, provenance.lineage):
        with pytest.raises(ValueError, match="cycle"):
            walk(ring)


@pytest.mark.parametrize("name", ["yaz0_roundtrip", "yaz0_op_stats", "yaz0_splice", "yaz0_range", "yaz0_block_edits"])
def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch, name):
    texts = [f"some text {i % 10}" for i in range(4000)]
    pq.write_table(pa.table({"doc_id": range(4000), "text": texts}), tmp_path / "documents.parquet", row_group_size=4000)
    pq.write_table(pa.table({"page_id": range(4000), "html": texts}), tmp_path / "pages.parquet", row_group_size=4000)
    pq.write_table(pa.table({"p_partkey": range(4000), "p_name": texts, "p_type": texts, "p_brand": texts, "p_size": range(4000)}), tmp_path / "part.parquet", row_group_size=4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    monkeypatch.setattr(containers, "CODED", 500, raising=False)
    for where in (containers, edits):
        monkeypatch.setattr(where, "CODED_SHORT", 500, raising=False)
    try:
        # What comes out of the coding step itself, before any aggregate.
        seen = []
        monkeypatch.setattr(containers.compression, "operations", lambda t, **_: seen.append(t) or compression_operations(t, **_))
        out = registry.queries()[name](spark, str(tmp_path))
        step = seen[0] if seen else out
        assert step.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 700
        assert step.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


compression_operations = compression.operations


def test_operations_of_many_files_share_batches(spark):
    files = spark.createDataFrame([(i, bytes(lz.encode(bytes([i % 50]) * (i % 40)))) for i in range(300)], "k int, content binary").coalesce(1)
    want = {i: sum(n for *_, n in lz.compressed_ops(bytes([i % 50]) * (i % 40))) for i in range(300) if i % 40}
    rows = compression.operations(files, keys=("k",))
    assert {r.k: r.n for r in rows.groupBy("k").agg(F.sum("length").alias("n")).collect()} == want
    ops = [(0, 0, 65, 0, 1, 0), (0, 1, None, 1, 17, 1), (0, 2, None, 4096, 18, 18)]
    assert [c.to_pylist() for c in compression._op_columns(ops)] == [[0] * 3, [0, 1, 2], ["literal", "short", "long"], [65, None, None], [None, 1, 4096], [1, 17, 18], [0, 1, 18]]
