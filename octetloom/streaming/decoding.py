"""Decoding files as they arrive: stateless operators over a ``binaryFile`` stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetloom.operators import compression, trees


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """path and content of every file that appears in ``folder``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return stream.load(folder).select("path", "content")


def arriving_strings(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per string of the key table of each arriving file, compressed or not."""
    files = arriving_files(spark, folder, pattern)
    opened = F.when(compression.is_compressed(F.col("content")), compression.decompressed(F.col("content"))["value"]).otherwise(F.col("content"))
    return trees.strings(files.select("path", opened.alias("content")), keys=("path",))
