"""Spark types given as text, as Arrow types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(DataType.fromDDL(ddl))
