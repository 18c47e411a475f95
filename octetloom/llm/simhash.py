"""SimHash near-duplicates: fingerprints of word shingles and links within a few bits.

Fingerprints are 64 bits; copies share one, so only distinct fingerprints are
compared. Each is embedded as the numbers of set bits of its segments. As one
flipped bit changes one count by one, the Manhattan distance of two embeddings
is at most their Hamming distance, so fingerprints within ``bits`` of each
other are within ``bits`` in the embedding as well. The counts are cut into
``bits // 2 + 1`` groups of segments: in one of them the Manhattan distance is
at most 1. The grid of each group has one cell per count vector, and a range
join meets each fingerprint with its own cell and the cells one step up. What
meets is verified by the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import materialised
from octetloom.llm.components import connected_components
from octetloom.session import spread

BITS = 3
SHINGLE = 3
SEGMENT_BITS = 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer; 0 without words."""
    ws = text.encode().translate(_LOWER).split() if text else []
    if not ws:
        return 0
    line = b" ".join(ws)
    if len(ws) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, len(starts))
    return int(_majority(h))


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of ``h``: eight byte-wide counters at a time, added up before they can overflow."""
    n, counts = len(h), np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    pad = -n % 255
    rows = np.concatenate([h, np.zeros(pad, np.uint64)]).reshape(-1, 255) if n > 255 else h.reshape(1, -1)
    for b in range(8):
        part = ((rows >> np.uint64(b)) & lanes).sum(axis=1, dtype=np.uint64)
        counts[b::8] = part.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every document, the unsigned fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _counts(fp: str, group: int, per_group: int, segment: int) -> list:
    """The set bits of each of a group's segments."""
    mask = F.lit((1 << segment) - 1).cast("long")
    shifts = range(group * per_group * segment, min(64, (group + 1) * per_group * segment), segment)
    return [F.bit_count(F.shiftrightunsigned(fp, s).bitwiseAND(mask)) for s in shifts]


def links(distinct: DataFrame, bits: int = BITS, segment: int = SEGMENT_BITS) -> DataFrame:
    """(a, b) for all pairs of distinct fingerprints within ``bits`` (``distinct``: fp).

    A cell is its group and its counts as one number in base ``segment + 1``; a
    step up adds one unit to one count. Pairs a step apart meet once, from the
    lower one; pairs in one cell once, by order.
    """
    groups = bits // 2 + 1
    per_group = -(-64 // (segment * groups))
    units = [F.lit((segment + 1) ** i) for i in range(per_group)]
    grid = distinct.select("fp", F.posexplode(F.array(*(F.array(*_counts("fp", g, per_group, segment)) for g in range(groups)))).alias("g", "counts"))
    grid = grid.withColumn("weighed", F.zip_with("counts", F.array(*units), lambda c, u: F.coalesce(c, F.lit(0)) * u.cast("long")))
    grid = grid.select("fp", "g", "counts", F.aggregate("weighed", F.lit(0).cast("long"), lambda x, y: x + y).alias("cell"))
    up = F.transform("counts", lambda c, i: F.when(c < segment, F.col("cell") + F.element_at(F.array(*units), i + 1).cast("long")))
    own = grid.select(F.col("fp").alias("b"), "g", "cell")
    probe = grid.select(F.col("fp").alias("a"), "g", F.col("cell").alias("home"), F.explode(F.concat(F.array("cell"), F.filter(up, lambda c: c.isNotNull()))).alias("cell"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    met = probe.join(own, ["g", "cell"]).where(near & ((F.col("home") != F.col("cell")) | (F.col("a") < F.col("b"))))
    return met.select("a", "b").distinct()


def _placed(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of the documents; and of each distinct fingerprint fp, its least doc_id (first), the root of its component and component_id."""
    fps = materialised(fingerprints(docs))
    nodes = materialised(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = materialised(links(nodes.select("fp"), bits))
    roots = connected_components(found)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps, placed.join(least, "root")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fp (signed long) and component_id.

    ``component_id`` is the smallest doc_id that a chain of links reaches, the
    document itself included. A null or wordless text has fingerprint zero and is
    linked like any other; fewer words than a shingle make one shingle; repeated
    rows are copies; a null doc_id takes part but names no component unless it
    is alone (then null); an empty table gives an empty result. Other columns
    are ignored.
    """
    fps, placed = _placed(docs, bits)
    placed = materialised(placed.select("fp", "component_id"))
    return fps.join(placed, "fp").select("doc_id", "fp", "component_id")


def _own_fingerprint(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t) for t in texts.to_pylist()), np.uint64, len(texts)).view(np.int64))

    return run(text.cast("string"))


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest doc_id (a null after all others) and then fingerprint.

    Components, not ids, are counted: unlike texts that share an id, or have
    none, all stay. Only rows whose id is null or repeated are told apart by
    their fingerprints; of equal ids and fingerprints any one stays.
    """
    fps, placed = _placed(docs, bits)
    winner = placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("w"))
    winner = materialised(winner.select(F.col("w.first").alias("__id"), F.col("w.fp").alias("__fp")))
    shared = materialised(fps.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1)).select(F.col("doc_id").alias("__shared")))
    own = docs["doc_id"].cast("long")
    if shared.isEmpty():
        return docs.join(winner, own == winner["__id"], "left_semi")
    once = docs.join(winner.join(shared, F.col("__id").eqNullSafe(F.col("__shared")), "left_anti"), own == F.col("__id"), "left_semi")
    many = docs.join(shared, own.eqNullSafe(F.col("__shared")), "left_semi").withColumn("__own", _own_fingerprint(F.col("text")))
    many = many.join(winner, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp")), "left_semi")
    return once.unionByName(many.dropDuplicates(["doc_id", "__own"]).drop("__own"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
