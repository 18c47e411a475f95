"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not reach it.

    Spark sends the sources to every executor, once per application.
    """
    sc = spark.sparkContext
    reach = [Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if ROOT in reach or getattr(sc, "_octetloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "octetloom_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in [*(ROOT / "octetloom").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._octetloom_shipped = True


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """A table scan dealt out to all cores where its files give fewer tasks; large tables stay as they are.

    A file of one row group is one task, however costly what follows is and
    however many splits the file has. With ``rows`` those of every task are
    counted (from the files' metadata), and no task gets many more than that.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        held = [r["count"] for r in scan.groupBy(F.spark_partition_id()).count().collect()]
        return scan.repartition(max(cores, -(-sum(held) // rows))) if len(held) < cores or max(held) > rows else scan
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, below the one that all executors share; below a local one only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="octetloom-")
    base = base if ":/" in base else f"file://{base}"
    return base.rstrip("/").replace("file:///", "file:/").replace("file:/", "file:///", 1) + f"/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, their lineage and plan cut."""
    sc = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
