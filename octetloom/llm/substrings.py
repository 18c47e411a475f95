"""Removal of long word passages that repeat across documents, by difference-cover anchors.

A window is ``window`` consecutive words of one document. Documents are packed
into compressed blocks of a few MB, which move as one value. A block hashes
runs of ``window - period + 1`` words, but only those that start at positions
whose remainder modulo ``period`` is in a difference cover: any two positions
shifted by some amount below ``period`` both fall on the cover, so any two equal
windows share an anchor that starts in them at the same place. Anchors meet by
hash, once per block and hash; those of one document only go. The rest are
extended: every window that holds a shared anchor is hashed in full (96 bits,
from two independent hashes of each word) and meets its equals by hash, again
once per block. A block learns which of its
windows start in a document of another block that comes before all of its own
with that window, and settles the windows that it holds twice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import BLANKS, materialised, small_batches
from octetloom.session import spread

WINDOW = 50
#: A perfect difference cover: every difference modulo 31 occurs among these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 4 << 20
BLOCKS_PER_BUCKET, LEAST_BUCKETS = 16, 64
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = 0xD6E8FEB86659FD93


#: Bytes whose words are hashed at a time.
CHUNK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_BYTES = [np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64) for seed in (1, 2)]
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """The first powers of an odd base, or of its inverse, modulo 2^64."""
    held = _POWERS.get((which, inverse))
    if held is None or len(held) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if n <= 2 * CHUNK:
            _POWERS[which, inverse] = held
    return held


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running sum of random values of bytes times powers, brought to the word's start and mixed with its length."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[which][data] * _powers(which, False, len(data))[: len(data)], dtype=np.uint64)])
    h = (upto[ends] - upto[starts]) * _powers(which, True, len(data))[starts]
    h = (h ^ (h >> np.uint64(32)) ^ (ends - starts).astype(np.uint64)) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


class Block:
    """Documents with their ids: packed for moving, as word hashes for matching. A null id takes part in nothing."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes]) -> None:
        self.ids, self.known, self.texts = ids, known, texts

    def pack(self) -> bytes:
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        head = np.int64(len(self.texts)).tobytes() + _bytes(self.ids) + _bytes(sizes) + _bytes(self.known.astype(np.uint8))
        return zstandard.ZstdCompressor(3).compress(head + b"".join(self.texts))

    @classmethod
    def unpack(cls, blob: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
        known = np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(bool)
        ends = np.cumsum(sizes) + 8 + 17 * n
        return cls(ids, known, [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())])

    def hash(self, twice: bool = False) -> None:
        """Sets ``h`` (a hash of each word; with ``twice`` a second, independent one), ``first`` (each document's first word), ``doc``, ``at`` and ``left`` (words before and from it on)."""
        starts, ends, own, other = [], [], [], []
        data = np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8)
        blank = _BLANK[data]
        at = 0
        while at < len(data):
            stop = min(len(data), at + CHUNK)
            # A chunk ends at a blank, so that no word is cut.
            while stop < len(data) and not blank[stop - 1]:
                more = np.flatnonzero(blank[stop : stop + CHUNK])
                stop = stop + int(more[0]) + 1 if len(more) else min(len(data), stop + CHUNK)
            edge = np.flatnonzero(np.diff(np.concatenate([[True], blank[at:stop]]).astype(np.int8)))
            a, e = edge[::2], edge[1::2]
            starts.append(a + at)
            ends.append(e + at)
            own.append(_word_hashes(data[at:stop], a, e, 0))
            if twice:
                other.append(_word_hashes(data[at:stop], a, e, 1))
            at = stop
        starts = np.concatenate(starts)
        self.h = np.concatenate(own)
        self.h2 = np.concatenate(other) if twice else None
        doc_ends = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)) + 1)
        self.doc = np.searchsorted(doc_ends, starts, "right")
        n = np.bincount(self.doc, minlength=len(self.texts))
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.at = np.arange(len(self.h)) - self.first[:-1][self.doc]
        self.left = n[self.doc] - self.at

    def runs(self, length: int, which: int = 0) -> np.ndarray:
        """A hash of the ``length`` words from each word on (rubbish where they leave the array), by doubling; ``which`` hash of the words."""
        h = self.h2 if which else self.h
        m, n = _MULT[which], len(h)
        out, done, size, part = np.zeros(n, np.uint64), 0, 1, h
        while done < length:
            if length & size:
                shifted = np.zeros(n, np.uint64)
                if done < n:
                    shifted[: n - done] = part[done:]
                out += shifted * np.uint64(pow(m, done, 1 << 64))
                done += size
            if done < length:
                more = part.copy()
                if size < n:
                    more[: n - size] += part[size:] * np.uint64(pow(m, size, 1 << 64))
                part, size = more, size * 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(_MIX)
        return out ^ (out >> np.uint64(29))

    def anchors(self, length: int, period: int, cover: tuple[int, ...], window: int) -> np.ndarray:
        """Where the anchors of documents with a whole window start."""
        on = np.zeros(period, bool)
        on[list(cover)] = True
        return np.flatnonzero(on[self.at % period] & (self.left >= length) & (self.at + self.left >= window) & self.known[self.doc])

    def windows(self, window: int) -> np.ndarray:
        return (self.left >= window) & self.known[self.doc]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in small_batches(batches, "text", BLOCK_BYTES):
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        block = Block(ids.fill_null(0).to_numpy(), known, texts)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block.pack()])], ["block", "blob"])
        number += 1


def _rows(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "bucket": pa.int32()}
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, cols)], names=names)


def _buckets(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The stretches of a sorted array of hashes that share their first bits."""
    if not bits:
        yield 0, slice(0, len(h))
        return
    top = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(h)]]) if len(h) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(top[a]), slice(int(a), int(b))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The starts of the runs of equal values in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def without_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (its other words, joined by a blank).

    A word goes if a window over it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null and empty texts have no words
    and keep the empty text; texts below a window keep all; a document with a
    null doc_id takes no part and keeps all; rows that repeat a doc_id don't
    remove each other; an empty table gives an empty result. Other columns are
    ignored. ``cover`` must meet every difference modulo ``period``, which is at
    most ``window``.
    """
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and period <= window
    length = window - period + 1
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialised(blocks.mapInArrow(_packed, "block long, blob binary"))
    bits = max(LEAST_BUCKETS, blocks.count() // BLOCKS_PER_BUCKET).bit_length() - 1

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = Block.unpack(blob)
                b.hash()
                at = b.anchors(length, period, cover, window)
                h = b.runs(length)[at]
                order = np.argsort(h, kind="stable")
                h, doc = h[order], b.doc[at[order]]
                start = _groups(h)
                ids = b.ids[doc]
                several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start) if len(start) else np.zeros(0, bool)
                h = h[start]
                rows = [(bucket, number, _bytes(h[s]), _bytes(several[s])) for bucket, s in _buckets(h, bits)]
                if rows:
                    yield from _rows(["bucket", "block", "hashes", "several"], rows).to_batches()

    def shared_rows(table: pa.Table) -> pa.Table:
        h, several = _joined(table, "hashes", np.uint64), _joined(table, "several", bool)
        sizes = np.fromiter((len(x) // 8 for x in table.column("hashes").to_pylist()), np.int64)
        order = np.argsort(h, kind="stable")
        start = _groups(h[order])
        count = np.diff(np.append(start, len(h)))
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat((count > 1) | np.logical_or.reduceat(several[order], start), count)
        ends = np.cumsum(sizes)
        rows = [(n, _bytes(h[e - s : e][shared[e - s : e]])) for n, e, s in zip(table.column("block").to_pylist(), ends, sizes)]
        return _rows(["block", "hashes"], [r for r in rows if r[1]])

    def window_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "block", "h1", "h2", "docs"]
        if not right.num_rows or not left.num_rows:
            return _rows(names, [])
        b = Block.unpack(left.column("blob")[0].as_py())
        b.hash(True)
        shared = np.sort(_joined(right, "hashes", np.uint64))
        at = b.anchors(length, period, cover, window)
        h = b.runs(length)[at]
        at = at[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h]
        near = np.zeros(len(b.h) + 1, np.int64)
        np.add.at(near, np.maximum(at - (window - length), b.first[:-1][b.doc[at]]), 1)
        np.add.at(near, at + 1, -1)
        at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & b.windows(window))
        h1, h2, ids = b.runs(window)[at], (b.runs(window, 1)[at] >> np.uint64(32)).astype(np.uint32), b.ids[b.doc[at]]
        order = np.lexsort((ids, h2, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        start = _groups(h1, h2)
        h1, h2, ids = h1[start], h2[start], ids[start]
        squeeze = zstandard.ZstdCompressor(1).compress
        return _rows(names, [(k, left.column("block")[0].as_py(), _bytes(h1[s]), _bytes(h2[s]), squeeze(_bytes(ids[s]))) for k, s in _buckets(h1, bits)])

    def later_rows(table: pa.Table) -> pa.Table:
        h1, h2 = _joined(table, "h1", np.uint64), _joined(table, "h2", np.uint32)
        ids = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in table.column("docs").to_pylist()])
        sizes = np.fromiter((len(x) // 8 for x in table.column("h1").to_pylist()), np.int64)
        order = np.lexsort((ids, h2, h1))
        start = _groups(h1[order], h2[order])
        later = np.zeros(len(h1), bool)
        later[order] = ids[order] > np.repeat(ids[order][start], np.diff(np.append(start, len(h1))))
        ends = np.cumsum(sizes)
        spans = [(n, slice(e - s, e)) for n, e, s in zip(table.column("block").to_pylist(), ends, sizes)]
        return _rows(["block", "h1", "h2"], [(n, _bytes(h1[s][later[s]]), _bytes(h2[s][later[s]])) for n, s in spans if later[s].any()])

    def verdicts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
        b = Block.unpack(left.column("blob")[0].as_py())
        b.hash(True)
        at = np.flatnonzero(b.windows(window))
        h1, h2, ids = b.runs(window)[at], (b.runs(window, 1)[at] >> np.uint64(32)).astype(np.uint32), b.ids[b.doc[at]]
        # Only windows whose first hash comes twice need to be put in full order.
        order = np.argsort(h1)
        start = _groups(h1[order])
        count = np.diff(np.append(start, len(at)))
        twice = order[np.repeat(count > 1, count)]
        order = twice[np.lexsort((ids[twice], h2[twice], h1[twice]))]
        start = _groups(h1[order], h2[order])
        gone = np.zeros(len(at), bool)
        if len(order):
            gone[order] = ids[order] > np.repeat(ids[order][start], np.diff(np.append(start, len(order))))
        if right.num_rows:
            pair = np.dtype([("h1", np.uint64), ("h2", np.uint32)])
            known = np.zeros(len(g1 := _joined(right, "h1", np.uint64)), pair)
            known["h1"], known["h2"] = g1, _joined(right, "h2", np.uint32)
            known = known[np.lexsort((known["h2"], known["h1"]))]
            # Windows whose first hash is known, then compared in both parts along equal first hashes.
            where = np.searchsorted(known["h1"], h1)
            step = 0
            open_ = np.flatnonzero(where < len(known))
            while len(open_):
                spot = where[open_] + step
                open_, spot = open_[spot < len(known)], spot[spot < len(known)]
                same = known["h1"][spot] == h1[open_]
                open_, spot = open_[same], spot[same]
                gone[open_[known["h2"][spot] == h2[open_]]] = True
                step += 1
        cover_ = np.zeros(len(b.h) + 1, np.int64)
        np.add.at(cover_, at[gone], 1)
        np.add.at(cover_, at[gone] + window, -1)
        removed = np.cumsum(cover_[:-1]) > 0
        n_words = np.diff(b.first)
        n_removed = np.bincount(b.doc[removed], minlength=len(n_words))
        kept = []
        for i, t in enumerate(b.texts):
            ws = t.split()
            if n_removed[i]:
                ws = [w for w, r in zip(ws, removed[b.first[i] : b.first[i + 1]].tolist()) if not r]
            kept.append(b" ".join(ws).decode())
        return pa.table([pa.array(b.ids, mask=~b.known), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    anchors = blocks.mapInArrow(anchor_rows, "bucket int, block long, hashes binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_rows, "block long, hashes binary")
    found = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(window_rows, "bucket int, block long, h1 binary, h2 binary, docs binary")
    later = found.groupBy("bucket").applyInArrow(later_rows, "block long, h1 binary, h2 binary")
    return blocks.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(verdicts, "doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What repeats of 50 words leave of every document."""
    out = without_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE doc_id > f),
spots AS (SELECT DISTINCT doc_id, i + k AS p FROM gone, range(50) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(s.p) AS n_removed, string_agg(CASE WHEN s.p IS NULL THEN word END, ' ' ORDER BY words.p) AS text FROM words LEFT JOIN spots s USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
