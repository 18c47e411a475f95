import random
import struct
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octetloom.codec import archive, lz, tree
from octetloom.codec.cursor import Cursor
from octetloom.sources import containers
from octetloom.sources.containers import register
from octetloom.streaming.decoding import arriving_strings


def put(folder, **files):
    for name, data in files.items():
        (folder / name.replace("_", ".")).write_bytes(data)
    return str(folder)


def test_files_are_decoded_and_faults_are_rows(spark, tmp_path):
    register(spark)
    where = put(tmp_path, a_szs=lz.encode(b"abc" * 50), b_szs=b"nonsense, not a file")
    rows = spark.read.format("yaz0").load(where).orderBy("path").collect()
    assert [(r.decompressed_size, r.error) for r in rows] == [(150, None), (None, "bad_magic")] and bytes(rows[0].data) == b"abc" * 50
    with pytest.raises(Exception, match="format does"):
        spark.read.format("yaz0").option("mode", "strict").load(where).collect()
    assert spark.read.format("yaz0").load(str(tmp_path / "none*")).count() == 0


def test_trees_and_archives(spark, tmp_path):
    register(spark)
    where = put(tmp_path, t_tree=lz.encode(tree.packed([b"one", b"caf\xe9"])))
    assert [r.value for r in spark.read.format("tree").option("compressed", "true").load(where).orderBy("idx").collect()] == ["one", "café"]
    (tmp_path / "x").mkdir()
    where = put(tmp_path / "x", a_sarc=archive.packed({b"n/1": b"data", b"n/2": b""}))
    assert {(r.name, bytes(r.data)) for r in spark.read.format("archive").load(where).collect()} == {("n/1", b"data"), ("n/2", b"")}


def test_record_ranges_are_read_alone(spark, tmp_path):
    register(spark)
    where = put(tmp_path, r_bin=b"".join(struct.pack("<IhBf", i, -i, i % 256, i / 2) for i in range(1000)) + b"left")
    df = spark.read.format("records").option("fields", "a:u32,b:i16,c:u8,d:f32").option("endian", "LE").option("split_records", 64).load(where)
    assert df.count() == 1000 and df.rdd.getNumPartitions() == 16
    picked = spark.read.format("records").option("fields", "a:u32,b:i16,c:u8,d:f32").option("endian", "LE").option("first", 100).option("count", 30).load(where)
    part = picked.where("idx >= 100 AND idx < 130 AND a % 2 = 0")
    assert [(r.idx, r.a, r.b, r.c, r.d) for r in part.orderBy("idx").collect()] == [(i, i, -i, i % 256, i / 2) for i in range(100, 130, 2)]
    assert part.rdd.getNumPartitions() == 1 and picked.count() == 30
    # A filter of one query must not stay with the next.
    assert df.where("idx = 7").count() == 1 and df.where("idx < 0").count() == 0 and df.count() == 1000


def test_sink_writes_files_that_read_back(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([(f"{i}.szs", bytearray(b"x" * i)) for i in range(9)], "name string, data binary")
    where = str(tmp_path / "out")
    df.write.format("yaz0").option("alignment", "16").mode("overwrite").save(where)
    rows = spark.read.format("yaz0").load(where).collect()
    assert sorted((len(r.data), r.alignment) for r in rows) == [(i, 16) for i in range(9)]


def test_binary_file_stream(spark, tmp_path):
    put(tmp_path, a_bin=tree.packed([b"p", b"q"]), b_bin=lz.encode(tree.packed([b"r"])))
    q = arriving_strings(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.table("arrived").where(F.col("error").isNull()).collect()) == ["p", "q", "r"]


def test_u64_uris_and_ranges(spark, tmp_path):
    register(spark)
    put(tmp_path, q_bin=struct.pack("<QqQ", 2**64 - 1, -(2**63), 2**63) + struct.pack("<QqQ", 0, 1, 7))
    df = spark.read.format("records").option("fields", "a:u64,b:i64,c:u64").option("endian", "LE").option("split_records", 1).load(f"file://{tmp_path}/*.bin")
    assert dict(df.dtypes)["a"] == "decimal(20,0)"
    assert [(int(r.a), r.b, int(r.c)) for r in df.orderBy("idx").collect()] == [(2**64 - 1, -(2**63), 2**63), (0, 1, 7)]
    assert df.where("idx = 1").select("path").first().path == f"file://{tmp_path}/q.bin" and df.rdd.getNumPartitions() == 2


def test_overwrite_leaves_no_old_file(spark, tmp_path):
    register(spark)
    where = f"file://{tmp_path}/out"
    rows = lambda *names: spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "name string, data binary")
    rows("old1", "old2", "kept").write.format("yaz0").mode("overwrite").save(where)
    rows("kept", "new").write.format("yaz0").mode("overwrite").save(where)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["kept", "new"]
    with pytest.raises(Exception, match="out"):
        rows("more").write.format("yaz0").mode("append").save(where)
    assert {bytes(r.data) for r in spark.read.format("yaz0").load(where).collect()} == {b"kept", b"new"}


@pytest.mark.parametrize("endian", ["BE", "LE"])
def test_records_are_decoded_by_columns(spark, tmp_path, endian, monkeypatch):
    register(spark)
    kinds = list(containers.TYPES)
    width = sum(containers.TYPES[k][0] for k in kinds)
    dice = random.Random(4)
    raw = {n: bytes(dice.choices(range(256), k=width * n)) + b"rest" * (n % 2) for n in (0, 1, 7, 150)}
    options = {"path": put(tmp_path, **{f"f{n}_bin": r for n, r in raw.items()}), "fields": ",".join(f"{k}:{k}" for k in kinds), "endian": endian}
    options["path"] = str(tmp_path)
    want = []
    for n, r in sorted(raw.items(), key=lambda x: f"f{x[0]}.bin"):
        c = Cursor(r, endian)
        for i in range(n):
            row = [c.get(k) if containers.TYPES[k][1] != "binary" else (c.read(16) if endian == "BE" else c.read(16)[::-1]) for k in kinds]
            want.append((f"f{n}.bin", i, *(Decimal(x) if k == "u64" else x for x, k in zip(row, kinds))))
    monkeypatch.setattr(containers, "BATCH_RECORDS", 40)
    reader = containers._RecordReader(options)
    # Sizes come from the one listing.
    monkeypatch.setattr(containers, "_store", lambda _: pytest.fail("asked for a file's size"))
    splits = reader.partitions()
    monkeypatch.undo()
    monkeypatch.setattr(containers, "BATCH_RECORDS", 40)
    batches = [b for s in splits for b in reader.read(s)]
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows < 80 for b in batches)
    got = [(p.rpartition("/")[2], *rest) for b in batches for p, *rest in zip(*(c.to_pylist() for c in b.columns))]
    same = lambda a, b: a == b or isinstance(a, float) and a != a and b != b
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
    rows = spark.read.format("records").options(**options).load()
    assert rows.count() == len(want) and rows.agg(F.sum("u64"), F.count("i128")).first() == (sum(w[2 + kinds.index("u64")] for w in want), len(want))
