"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition packs its pieces by best fit, largest first, and emits the bins
that are nearly full. The underfull bins travel on as items of their fill to
fewer partitions, which again pack them by best fit, until they fit in one task
or in tasks of ``ITEMS`` bins each, where everything is emitted. A task never
holds more than ``ITEMS`` items at once.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import materialised
from octetloom.session import spread

CAPACITY = 2048
SEPARATOR = 0
#: Bins with at most this share of room are emitted in every round.
SLACK = 1 / 64
ITEMS = 200_000
FAN_IN = 8
#: Longest stretch without a blank that the rank encoder takes; its time grows with the square.
LONG = 2000

_PIECE = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("key", "<i8")])


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by the tokenizer file at ``path``.

    A byte-level BPE whose merges come in the order of their ids is the same as a
    ranked vocabulary, which encodes several times faster; texts with very long
    words or with the name of an added token (which is one id, as the file has it),
    and any other tokenizer, go to the tokenizer itself.
    """
    slow = lambda text: np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    spec = json.load(open(path, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    merged = [model["vocab"].get(a + b, -1) for a, b in merges]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or merged != sorted(merged) or model.get("dropout"):
        return slow
    import tiktoken
    from public_tokenizers import PATTERN

    added = [t["content"] for t in spec.get("added_tokens", [])]
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    of = _byte_of()
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG and max(map(len, text.split(" "))) > LONG or "  " in text and " " * LONG in text or any(t in text for t in added):
            return slow(text)
        return np.array(fast(text), np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, doc_id, piece, start, length, ids_crc32 and, on demand, ids.

    A document's ids end with the separator (a null or empty text is that alone).
    Only documents longer than ``capacity`` are cut, into whole sequences but for
    the first piece. ``key`` numbers the pieces of this run; repeated rows are
    documents of their own; a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(SEPARATOR)).astype("<u4")
                starts = range(0, len(ids), capacity) if len(ids) % capacity == 0 else [0, *range(len(ids) % capacity, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((key, doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].tolist()] if with_ids else [])))
                    key += 1
            names = ["key", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            yield from pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names).to_batches()

    kind = "key long, doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, taken in the given order, and the fill of each bin: the open bin with the least room that is enough, else a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, fills = 0, np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i] = b
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, np.array(fills, np.int64)


def _packed(capacity: int, emit_over: int, round_: int, last: bool) -> Callable:
    """A round: items (key, size, members) to bins (sequence_id or null, key, size, members)."""

    def pack(items: list[tuple[int, int, bytes]], number: int) -> pa.RecordBatch:
        items.sort(key=lambda x: (-x[1], x[0]))
        bins, fills = best_fit(np.fromiter((x[1] for x in items), np.int64, len(items)), capacity)
        members: list[list[int]] = [[] for _ in fills]
        for i, b in enumerate(bins.tolist()):
            members[b].append(i)
        ids = [number + b if last or fill > emit_over else None for b, fill in enumerate(fills.tolist())]
        cols = [pa.array(ids, pa.int64()), pa.array([items[m[0]][0] for m in members], pa.int64()), pa.array(fills), pa.array([b"".join(items[i][2] for i in m) for m in members], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["sequence_id", "key", "size", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], round_ << 56 | TaskContext.get().partitionId() << 32
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= ITEMS:
                yield pack(held[:ITEMS], number)
                held, number = held[ITEMS:], number + ITEMS
        if held:
            yield pack(held, number)

    return run


def _as_items(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.zeros(batch.num_rows, _PIECE)
            for name, column in (("key", "key"), ("doc_id", "doc_id"), ("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
                data[name] = batch.column(column).fill_null(0).to_numpy()
            data["known"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            raw, n = data.tobytes(), _PIECE.itemsize
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("length").cast(pa.int64()), pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary())], ["key", "size", "members"])

    return rows.select("key", "doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(run, "key long, size long, members binary")


def _placed(bins: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("members").to_pylist()
            data = np.frombuffer(b"".join(blobs), _PIECE)
            counts = np.fromiter((len(b) // _PIECE.itemsize for b in blobs), np.int64, len(blobs))
            upto = np.cumsum(data["length"], dtype=np.int64) - data["length"]
            firsts = np.cumsum(counts) - counts
            cols = [pa.array(data["key"]), pa.array(data["doc_id"], mask=data["known"] == 0), pa.array(data["piece"]), pa.array(data["start"]), pa.array(data["length"]), pa.array(data["crc"].astype(np.int64))]
            cols += [pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)), pa.array((upto - np.repeat(upto[firsts], counts)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return bins.select("sequence_id", "members").mapInArrow(run, "key long, doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int")


def pack(rows: DataFrame, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """``rows`` of pieces() with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, at most ``capacity`` long.

    The order of packing is by size, then key, so equal sizes and lost tasks don't
    change the result; an empty table gives an empty result.
    """
    bin_kind = "sequence_id long, key long, size long, members binary"
    emit_over = int(capacity * (1 - slack)) - 1
    items, done, round_ = _as_items(rows), [], 1
    left = None
    while True:
        parts = 0 if left is None else left // ITEMS + 1 if left <= ITEMS * FAN_IN else max(left // ITEMS + 1, parts // FAN_IN)
        last = left is not None and (parts == left // ITEMS + 1)
        if left is not None:
            items = items.repartition(parts, "key")
        bins = materialised(items.mapInArrow(_packed(capacity, emit_over, round_, last), bin_kind))
        done.append(bins.where("sequence_id IS NOT NULL"))
        if last:
            break
        under = bins.where("sequence_id IS NULL").select("key", "size", "members")
        left, parts = under.count(), bins.rdd.getNumPartitions()
        if not left:
            break
        items, round_ = under, round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _placed(out)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their places; see pieces() and pack()."""
    import public_tokenizers

    return pack(materialised(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity)), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    out = packed_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
