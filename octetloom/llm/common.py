"""Helpers that the operators share: words, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these ASCII blanks. ``bytes.split()`` splits at just these.
BLANKS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names; choose one only for a local session without it."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='octetloom-')}")


def materialised(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast only when its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def words(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text; none for null."""
    return text.encode().split() if text else []


class HashCache(dict):
    """XXH64 of each word, kept for words seen again; emptied when it holds ``limit`` of them."""

    def __init__(self, seed: int, limit: int = 300_000) -> None:
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most_bytes``; a larger value comes alone."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > most_bytes:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)
