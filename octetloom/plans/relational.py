"""Queries that combine decoded rows by Spark's own operators: windows, sorts with limits, set operations, dates, JSON and maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from octetloom.operators import records
from octetloom.plans.containers import _order_records, _table


def _entries(spark, sf_dir):
    return records.entries(_order_records(spark, sf_dir), "content", "LE")


_E = """(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx, l_partkey AS filename_hash, l_suppkey AS hash_index, trunc(l_quantity)::BIGINT AS start_offset FROM lineitem)"""


def windows_over_records(spark, sf_dir):
    """Of each table's records the rank by offset, the running sum and the offset before."""
    own = Window.partitionBy("l_orderkey").orderBy("start_offset", "idx")
    e = _entries(spark, sf_dir)
    return e.select("l_orderkey", "idx", F.row_number().over(own).alias("rank"), F.sum("start_offset").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.lag("start_offset").over(own).alias("before"))


WINDOWS = f"""SELECT l_orderkey, idx::INTEGER AS idx, (row_number() OVER w)::INTEGER AS rank, (sum(start_offset) OVER (PARTITION BY l_orderkey ORDER BY start_offset, idx ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, lag(start_offset) OVER w AS before
FROM {_E} WINDOW w AS (PARTITION BY l_orderkey ORDER BY start_offset, idx)"""


def largest_tables(spark, sf_dir):
    """The twenty tables with the most bytes of records."""
    return _entries(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("start_offset").alias("total"), F.count("*").alias("n"), F.max("hash_index").alias("most")).orderBy(F.desc("total"), "l_orderkey").limit(20)


LARGEST = f"SELECT l_orderkey, sum(start_offset)::BIGINT AS total, count(*) AS n, max(hash_index)::INTEGER AS most FROM {_E} GROUP BY l_orderkey ORDER BY total DESC, l_orderkey LIMIT 20"


def hashes_in_one_only(spark, sf_dir):
    """Names' hashes of even tables that odd ones lack, and those that both have, told apart."""
    e = _entries(spark, sf_dir)
    even, odd = (e.where(F.col("l_orderkey") % 2 == k).select("filename_hash") for k in (0, 1))
    return even.subtract(odd).withColumn("both", F.lit(False)).unionByName(even.intersect(odd).withColumn("both", F.lit(True)))


ONE_ONLY = f"""WITH e AS (SELECT filename_hash FROM {_E} WHERE l_orderkey % 2 = 0), o AS (SELECT filename_hash FROM {_E} WHERE l_orderkey % 2 = 1)
SELECT filename_hash, false AS "both" FROM (SELECT filename_hash FROM e EXCEPT SELECT filename_hash FROM o) UNION ALL SELECT filename_hash, true FROM (SELECT filename_hash FROM e INTERSECT SELECT filename_hash FROM o)"""


def headers_as_json(spark, sf_dir):
    """Decoded fields as JSON and read again, as a map, and a day counted from an offset."""
    e = _entries(spark, sf_dir)
    read = F.from_json(F.to_json(F.struct("filename_hash", "start_offset")), "filename_hash long, start_offset long")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("start_offset").cast("int"))
    m = F.create_map(F.lit("hash"), F.col("filename_hash"), F.lit("at"), F.col("start_offset"))
    return e.select("l_orderkey", "idx", read["filename_hash"].alias("hash"), m["at"].alias("at"), F.date_format(day, "yyyy-MM-dd").alias("day"), F.round(F.sqrt(F.col("start_offset").cast("double")), 6).alias("root"))


JSON = f"SELECT l_orderkey, idx::INTEGER AS idx, filename_hash AS hash, start_offset AS at, strftime(DATE '2000-01-01' + start_offset::INTEGER, '%Y-%m-%d') AS day, round(sqrt(start_offset::DOUBLE), 6) AS root FROM {_E}"


def tables_by_status(spark, sf_dir):
    """Records joined to their orders and rolled up."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return _entries(spark, sf_dir).join(o, "l_orderkey").rollup("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("filename_hash").alias("names"), F.sum("start_offset").alias("total"))


STATUS = f"SELECT o_orderstatus, count(*) AS n, count(DISTINCT filename_hash) AS names, sum(start_offset)::BIGINT AS total FROM {_E} e JOIN orders ON o_orderkey = l_orderkey GROUP BY ROLLUP (o_orderstatus)"

ALL = {
    "windows_over_records": (windows_over_records, WINDOWS),
    "largest_tables": (largest_tables, LARGEST),
    "hashes_in_one_only": (hashes_in_one_only, ONE_ONLY),
    "headers_as_json": (headers_as_json, JSON),
    "tables_by_status": (tables_by_status, STATUS),
}
