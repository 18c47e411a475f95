import pytest
from pyspark.sql import functions as F

from octetloom import errors
from octetloom.codec import lz, tree
from octetloom.errors import Context
from octetloom.functions import slices, sql
from octetloom.operators import compression, provenance, records


def test_sql_names(spark):
    sql.register(spark)
    spark.createDataFrame([(1, lz.encode(tree.packed([b"x", b"yy"])))], "id int, content binary").createOrReplaceTempView("files")
    rows = spark.sql("SELECT id, s.idx, s.value FROM files, LATERAL tree_strings(yaz0_decode(content), 'key') s ORDER BY idx").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "x"), (1, 1, "yy")]
    assert spark.sql("SELECT name_hash32(CAST('test' AS BINARY)) h, yaz0_decode(X'00') d, yaz0_decode(yaz0_encode(X'0102')) r").first() == (120556948, None, b"\1\2")
    assert spark.sql("SELECT sum(o.length) FROM files, LATERAL yaz0_ops(content) o").first()[0] == len(tree.packed([b"x", b"yy"]))


def test_ranges_decode_no_further(spark):
    raw = lz.encode(bytes(range(200)) * 3)
    df = spark.createDataFrame([(raw[:-1],)], "b binary")
    r = df.select(compression.decompressed_range(F.col("b"), F.lit(150), F.lit(60)).alias("a"), compression.decompressed(F.col("b")).alias("all"), compression.decompressed_range(F.col("b"), F.lit(590), F.lit(60)).alias("past")).first()
    assert bytes(r.a.value) == (bytes(range(200)) * 2)[150:210] and r.all.error.code == "truncated" and r.past.error.code == "out_of_bounds"


def test_text_for_people():
    assert provenance.display_width("日本é") == 5 and provenance.clipped("日本語", 5) == "日本…" and provenance.clipped("abc", 3) == "abc"
    assert Context().note("a", 1).note("b", None).lines() == ["a: 1", "some diagnostics failed to load"]
    report = provenance.Report("two places", notes=[("here", (("f", "physical", 0, 9), ("x", "physical", 1, 2))), ("there", (("f", "physical", 0, 9), ("y", "logical", None, None)))])
    assert report.render().splitlines() == ["two places", "  └─ f @0 (9 bytes)", "     ├─ x @1 (2 bytes)", "     │   ~", "     │   ╰──▶ here", "     └─ y", "         ~", "         ╰──▶ there"]
    assert all(r.render() and r.render(style="ansi") for r in provenance.GALLERY.values())
    with pytest.raises(RuntimeError, match="bad_magic"):
        provenance.unwrapped(lz.decode, b"Yaz1" + bytes(20))


def test_records_are_packed_by_key(spark):
    rows = spark.createDataFrame([(1, 2, 20), (1, 1, 10), (2, 1, None), (None, 1, 5), (None, 1, 5)], "key int, by int, v bigint")
    fields = {"v": (F.col("v"), "u16"), "by": (F.col("by"), "u8")}
    out = {r.key: r.content and bytes(r.content) for r in records.packed(rows, ["key"], ["by"], fields).collect()}
    assert out == {1: b"\0\x0a\1\0\x14\2", 2: None, None: b"\0\5\1" * 2}
    back = records.records(records.packed(rows, ["key"], ["by"], fields), "content", {"v": "u16", "by": "u8"}).where("key = 1").orderBy("idx")
    assert [tuple(r) for r in back.collect()] == [(1, 0, 10, 1), (1, 1, 20, 2)]
    assert records.packed(rows.limit(0), ["key"], ["by"], fields).collect() == []


def test_many_notes_keep_the_expression_small(spark):
    r = slices.read_at(F.col("b"), F.col("at"), 2, "part")
    for i in range(8):
        r = errors.annotated(r, f"n{i}", when=F.lit(i % 2 == 0))
    rows = spark.createDataFrame([(bytearray(b"abc"), 1), (bytearray(b"abc"), 2)], "b binary, at int").select("at", r["error"]["component"].alias("c"), r["value"].alias("v"))
    assert [(x.c, x.v and bytes(x.v)) for x in rows.orderBy("at").collect()] == [(None, b"bc"), ("part (n0) (n2) (n4) (n6)", None)]


def test_table_functions_hold_few_rows_as_objects(spark, monkeypatch):
    live, most = 0, 0

    class Row(bytes):
        def __new__(cls, x):
            nonlocal live, most
            live += 1
            most = max(most, live)
            return super().__new__(cls, x)

        def __del__(self):
            nonlocal live
            live -= 1

    monkeypatch.setattr(sql, "ROWS_TOGETHER", 100)
    kind = sql.arrow_type(f"struct<{sql._fields(sql.STRING_COLUMNS)}>")
    out = sql._lists(iter([((i, 4 * i, Row(b"x"), "x") for i in range(n)) for n in (1000, 0, 50)]), kind)
    assert [len(x) for x in out.to_pylist()] == [1000, 0, 50] and out[0].as_py()[999] == {"idx": 999, "offset": 3996, "raw": b"x", "value": "x"}
    assert most <= 300 and live == 0
    sql.register(spark)
    plan = spark.sql("SELECT s.value FROM (SELECT X'00' AS content), LATERAL tree_strings(content, 'key') s")._jdf.queryExecution().toString()
    assert "TreeStrings" not in plan and "BatchEvalPythonUDTF" not in plan
