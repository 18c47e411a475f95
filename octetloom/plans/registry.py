"""Named queries over the test tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from octetloom.plans import containers, edits, files, relational

Query = Callable[[SparkSession, str], DataFrame]
ALL = containers.ALL | edits.ALL | files.ALL | relational.ALL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end-to-end query that ``entry`` runs."""
    return containers.end_to_end(spark, sf_dir)


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, for the queries that SQL can express."""
    return {name: sql for name, (_, sql) in ALL.items() if sql}
