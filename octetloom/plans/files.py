"""Queries through files: tables written by the sink into the shared folder and read by the data sources, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from octetloom.functions.sql import register as register_functions
from octetloom.operators import compression
from octetloom.operators.records import packed
from octetloom.plans.containers import _archives, _bytes, _nation_trees, _table
from octetloom.session import shared_folder
from octetloom.sources.containers import register
from octetloom.streaming.decoding import arriving_strings


def _written(spark, rows) -> str:
    """The folder that the sink wrote (name, data) to."""
    register(spark)
    folder = shared_folder(spark, "files")
    rows.select("name", "data").write.format("yaz0").mode("overwrite").save(folder)
    return folder


def _key(column: str = "path") -> Column:
    return F.regexp_extract(column, "([0-9]+)[.][a-z]+$", 1).cast("bigint")


def source_yaz0(spark, sf_dir):
    """One compressed file per nation, read back with its header."""
    t = _table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".szs")).alias("name"), _bytes(F.repeat("n_name", F.lit(50))).alias("data"))
    return spark.read.format("yaz0").load(_written(spark, t)).select(_key().alias("n_nationkey"), "decompressed_size", F.col("data").cast("string").alias("data"), "error")


YAZ0 = "SELECT n_nationkey, (50 * length(n_name))::BIGINT AS decompressed_size, repeat(n_name, 50) AS data, NULL::VARCHAR AS error FROM nation"


def source_tree(spark, sf_dir):
    t = _nation_trees(spark, sf_dir).select(F.concat(F.col("c_nationkey").cast("string"), F.lit(".tree")).alias("name"), F.col("content").alias("data"))
    out = spark.read.format("tree").option("compressed", "true").load(_written(spark, t))
    return out.select(_key().alias("c_nationkey"), "idx", "value", "unterminated", "error")


TREE = "SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS idx, c_name AS value, false AS unterminated, NULL::VARCHAR AS error FROM customer"


def _raw(spark, rows) -> str:
    """The folder that the sink for files as they are wrote (name, data) to."""
    register(spark)
    folder = shared_folder(spark, "files")
    rows.select("name", "data").write.format("raw").mode("overwrite").save(folder)
    return folder


def source_archive(spark, sf_dir):
    t = _archives(spark, sf_dir).select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".sarc")).alias("name"), F.col("content").alias("data"))
    out = spark.read.format("archive").load(_raw(spark, t))
    return out.select(_key().alias("n_regionkey"), "sequence", "name", F.col("data").cast("string").alias("data"), "error")


ARCHIVE = "SELECT n_regionkey, 1 AS sequence, n_name AS name, repeat(n_name, n_nationkey::BIGINT) AS data, NULL::VARCHAR AS error FROM nation"


def source_records(spark, sf_dir):
    """One table of records per supplier, read from the second record on."""
    fields = {"hash": (F.col("l_partkey"), "u32"), "order": (F.col("l_orderkey"), "u64"), "quantity": (F.col("l_quantity").cast("bigint"), "u16")}
    t = packed(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], fields, "LE")
    t = t.select("l_suppkey", F.coalesce("content", F.lit(b"")).alias("data"))
    folder = _raw(spark, t.withColumn("name", F.concat(F.col("l_suppkey").cast("string"), F.lit(".bin"))))
    out = spark.read.format("records").option("fields", "hash:u32,order:u64,quantity:u16").option("endian", "LE").option("first", 1).option("split_records", 20_000).load(folder)
    return out.select(_key().alias("l_suppkey"), "idx", "hash", F.col("order").cast("bigint").alias("order_key"), "quantity")


RECORDS = """SELECT l_suppkey, n AS idx, l_partkey AS hash, l_orderkey AS order_key, trunc(l_quantity)::INTEGER AS quantity FROM
(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS n FROM lineitem) WHERE n > 0"""


def stream_strings(spark, sf_dir):
    """Trees that arrive as files, decoded by a stream of one batch and kept as Parquet."""
    t = _nation_trees(spark, sf_dir).select(F.concat(F.col("c_nationkey").cast("string"), F.lit(".tree")).alias("name"), F.col("content").alias("data"))
    folder, out = _written(spark, t), shared_folder(spark, "stream")
    q = arriving_strings(spark, folder).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").where("error IS NULL").select(_key().alias("c_nationkey"), "idx", "value")


STREAM = "SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS idx, c_name AS value FROM customer"


def sql_functions(spark, sf_dir):
    """The decoders under their SQL names, table functions with a lateral join."""
    register_functions(spark)
    trees = _nation_trees(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    packed = trees.select("c_nationkey", compression.compressed(F.col("content")).alias("packed"))
    return spark.sql("SELECT c_nationkey, idx, value, name_hash32(cast(value AS binary)) AS hash FROM {t}, LATERAL tree_strings(yaz0_decode(packed), 'key')", t=packed)


FUNCTIONS = """SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS idx, c_name AS value,
  list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i:i])::HUGEINT)), lambda h, x: (h * 101 + x) % 4294967296)::BIGINT AS hash FROM customer"""

ALL = {
    "source_yaz0": (source_yaz0, YAZ0),
    "source_tree": (source_tree, TREE),
    "source_archive": (source_archive, ARCHIVE),
    "source_records": (source_records, RECORDS),
    "stream_strings": (stream_strings, STREAM),
    "sql_functions": (sql_functions, FUNCTIONS),
}
