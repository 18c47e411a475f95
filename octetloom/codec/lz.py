"""The Yaz0 codec: blocks of up to eight operations under a header byte.

Format: ``Yaz0``, then three 32-bit numbers (decoded size, alignment, unused)
in the caller's byte order; then blocks. Bits of a block's header, the most
significant first, tell literals (1: one byte) from copies (0): two bytes
``NR RR`` copy N + 2 bytes, three bytes ``0R RR NN`` copy NN + 18, from RRR + 1
bytes back. A copy may overlap what it writes.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from octetloom.codec.cursor import Cursor
from octetloom.errors import DecodeError

# Fixed values of the format.
MAGIC = b"Yaz0"
HEADER_SIZE = 16
HISTORY = 4096
SHORTEST = 3
LONG_FROM = 0x12
LONGEST = 0x111
OPS_PER_BLOCK = 8

#: Places whose matches are found together, at most and at first; the least number worth it; and the length up to which they are.
TABLE = 1 << 16
TABLE_FIRST = 1 << 13
TABLE_FROM = 512
TABLE_LENGTH = 24
#: Bytes of files that are encoded together; larger files are encoded alone.
TOGETHER = 1 << 16

#: Decoded bytes that a file may claim, unless the caller allows more.
OUTPUT_LIMIT = 1 << 30


@dataclass(frozen=True)
class Header:
    decompressed_size: int
    alignment: int = 0
    unused: int = 0

    def pack(self, endian: str = "BE") -> bytes:
        order = "big" if endian == "BE" else "little"
        return MAGIC + b"".join(x.to_bytes(4, order) for x in (self.decompressed_size, self.alignment, self.unused))


@dataclass
class Decoded:
    """``ops``: (block, number in it, literal byte or None, distance, length, decoded offset)."""

    header: Header
    data: bytes
    overshoot: int = 0
    ops: list[tuple[int, int, int | None, int, int, int]] = field(default_factory=list)


def read_header(c: Cursor) -> Header:
    if c.read(4, "yaz0.magic") != MAGIC:
        c.rewind(4)
        raise c.fail("bad_magic", "yaz0.magic", 4)
    return Header(c.get("u32"), c.get("u32"), c.get("u32"))


def copied(out: bytearray, distance: int, length: int) -> None:
    """``length`` bytes from ``distance`` back, repeating where they overlap."""
    at = len(out) - distance
    if at < 0:
        raise DecodeError("seekback_out_of_bounds", "yaz0.history", distance, length, len(out))
    if distance >= length:
        out += out[at : at + length]
    else:
        piece = bytes(out[at:])
        out += (piece * (length // distance + 1))[:length]


def parse(c: Cursor, size: int | None, ops: list | None = None, out: bytearray | None = None, starts: list | None = None, keep_from: int = 0, reached: list | None = None) -> bytearray | None:
    """Reads blocks until ``size`` decoded bytes (or the end, if None) have come; fills ``ops`` and ``out`` where given.

    ``starts`` gets the packed and decoded offset of each block, ``reached`` the
    number of decoded bytes. Those before ``keep_from`` stay in ``out`` only as
    long as copies may reach them.
    """
    raw, at, end = c.data, c.start + c.offset, c.end
    done, block = 0, 0
    while size is None and at < end or size is not None and done < size:
        if at >= end:
            break
        if starts is not None:
            starts.append((at - c.start, done))
        if out is not None and len(out) > 16 * HISTORY and done < keep_from:
            del out[:-HISTORY]
        bits, at = raw[at], at + 1
        for i in range(OPS_PER_BLOCK):
            if size is not None and done >= size or at >= end and size is None:
                break
            if bits >> (7 - i) & 1:
                if at >= end:
                    break
                if ops is not None:
                    ops.append((block, i, raw[at], 0, 1, done))
                if out is not None:
                    out.append(raw[at])
                at, done = at + 1, done + 1
                continue
            if at + 2 > end or raw[at] < 0x10 and at + 3 > end:
                at = end
                break
            distance, n = ((raw[at] & 15) << 8 | raw[at + 1]) + 1, raw[at] >> 4
            length, at = (n + 2, at + 2) if n else (raw[at + 2] + LONG_FROM, at + 3)
            if ops is not None:
                ops.append((block, i, None, distance, length, done))
            if out is not None:
                copied(out, distance, length)
            done += length
        block += 1
    c.offset = at - c.start
    if reached is not None:
        reached[0] = done
    if size is not None and done < size:
        raise DecodeError("truncated", "yaz0.blocks", c.place, size, done, c.path)
    return out


def decode(data: bytes, endian: str = "BE", limit: int = OUTPUT_LIMIT, with_ops: bool = False) -> Decoded:
    """The decoded bytes, cut at the declared size. ``overshoot`` counts what the last copy wrote beyond it."""
    c = Cursor(data, endian)
    header = read_header(c)
    if header.decompressed_size > limit:
        raise c.fail("output_too_large", "yaz0.header", header.decompressed_size)
    ops: list = []
    out = parse(c.named("blocks"), header.decompressed_size, ops if with_ops else None, bytearray())
    over = len(out) - header.decompressed_size
    return Decoded(header, bytes(out[: header.decompressed_size]), over, ops)


def decode_range(data: bytes, offset: int, length: int, endian: str = "BE", limit: int = OUTPUT_LIMIT) -> bytes:
    """``length`` decoded bytes at ``offset``; blocks behind them are not read."""
    c = Cursor(data, endian)
    size = read_header(c).decompressed_size
    if offset < 0 or length < 0 or offset + length > size:
        raise DecodeError("out_of_bounds", "yaz0.data", offset, length, size)
    if offset + length > limit:
        raise c.fail("output_too_large", "yaz0.header", offset + length)
    out, reached = bytearray(), [0]
    parse(c, offset + length, None, out, keep_from=offset, reached=reached)
    from_end = reached[0] - offset
    return bytes(out[len(out) - from_end : len(out) - from_end + length]) if length else b""


def longest_match(data: bytes, at: int, history: int = HISTORY, end: int | None = None) -> tuple[int, int]:
    """(distance, length) of the longest earlier run equal to what comes at ``at`` (before ``end``); of equal lengths the greatest distance; (0, 0) below three bytes."""
    size = len(data) if end is None else end
    most = min(LONGEST, size - at)
    if most < SHORTEST:
        return 0, 0
    best, length = -1, SHORTEST - 1
    p = max(0, at - history)
    while length < most:
        p = data.find(data[at : at + length + 1], p, at + length)
        if p < 0:
            break
        # The first place that is longer than what was known; how long is it?
        if data[p : p + most] == data[at : at + most]:
            length = most
        else:
            length += 1
            while data[p + length] == data[at + length]:
                length += 1
        best, p = p, p + 1
    return (at - best, length) if best >= 0 else (0, 0)


def packed_op(literal: int | None, distance: int, length: int) -> bytes:
    if literal is not None:
        return bytes((literal,))
    d = distance - 1
    if length < LONG_FROM:
        return bytes(((length - 2) << 4 | d >> 8, d & 255))
    return bytes((d >> 8, d & 255, length - LONG_FROM))


def packed_ops(ops: list[tuple[int | None, int, int]]) -> bytes:
    """Blocks of operations (literal or None, distance, length)."""
    out = bytearray()
    for i in range(0, len(ops), OPS_PER_BLOCK):
        block = ops[i : i + OPS_PER_BLOCK]
        out.append(sum(1 << (7 - k) for k, op in enumerate(block) if op[0] is not None))
        for op in block:
            out += packed_op(*op)
    return bytes(out)


class Matches:
    """longest_match() of the places of ``raw``, found together: ``lengths`` of all (TABLE_LENGTH stands for that length or more), and the distances of those asked for.

    A match starts at ``low`` of its place or later and ends before ``ends``.
    Places that begin alike for n bytes form a class, which the next byte splits.
    A place too far from both its neighbours in its class can match nothing
    longer and leaves. The first place of a class within reach is the match.
    """

    def __init__(self, raw: np.ndarray, low: np.ndarray, ends: np.ndarray) -> None:
        n = len(raw)
        self.low, self.bits, self.classes = low, n.bit_length(), []
        self.lengths = lengths = np.zeros(n, np.int64)
        raw, bits = raw.astype(np.int64), self.bits
        place = np.arange(max(0, n - SHORTEST + 1))
        place = place[place + SHORTEST <= ends[place]]
        key = (raw[place] << 16 | raw[place + 1] << 8 | raw[place + 2]) << bits | place
        for length in range(SHORTEST, TABLE_LENGTH + 1):
            if len(key) < 2:
                break
            key.sort()
            self.classes.append(key)
            place, kind = key & (1 << bits) - 1, key >> bits
            same = kind[1:] == kind[:-1]
            near = same & (place[:-1] >= low[place[1:]])
            lengths[place[1:][near]] = length
            number = np.cumsum(np.append(False, ~same))
            keep = (np.append(False, near) | np.append(near, False)) & (place + length < ends[place])
            place = place[keep]
            key = (number[keep] << 8 | raw[place + length]) << bits | place

    def walk(self, data: bytes, base: int, at: int, stop: int, end: int, start: int, places: list[int], longer: list[tuple[int, int, int]]) -> int:
        """Greedy from place ``at`` to ``stop``: their places, and (place, distance, length) of matches of TABLE_LENGTH or more; returns the next place.

        Place 0 is ``base`` in ``data``; matches lie between ``start`` and ``end`` there.
        """
        steps = self.steps
        while at < stop:
            places.append(at)
            step = steps[at]
            if step == TABLE_LENGTH:
                distance, step = longest_match(data, base + at, min(HISTORY, base + at - start), end)
                longer.append((at, distance, step))
            at += step
        return at

    @cached_property
    def steps(self) -> list[int]:
        return np.maximum(self.lengths, 1).tolist()

    def found(self, places: np.ndarray, longer: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Distances and lengths of the matches at ``places`` (0 where there is none)."""
        lengths, distances = self.lengths[places], np.zeros(len(places), np.int64)
        number = np.empty(len(self.lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], np.arange(SHORTEST, TABLE_LENGTH + 1)).tolist()
        for key, a, b in zip(self.classes, cuts, cuts[1:]):
            if a < b:
                mine = order[a:b]
                asked = places[mine]
                number[key & (1 << self.bits) - 1] = key >> self.bits
                first = np.searchsorted(key, number[asked] << self.bits | self.low[asked])
                distances[mine] = asked - (key[first] & (1 << self.bits) - 1)
        if longer:
            at, distance, length = np.array(longer).T
            at = np.searchsorted(places, at)
            distances[at], lengths[at] = distance, length
        return distances, lengths


def compressed_ops(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int | None, int, int]]:
    """Greedy operations for the bytes from ``at`` to ``end``: the longest match at each place, else a literal.

    Where matches are short, those of the next places are found together, of
    more places as long as many of them are asked for.
    """
    ops, end = [], len(data) if end is None else end
    size = TABLE_FIRST
    while at < end:
        distance, length = longest_match(data, at, HISTORY, end)
        if length < TABLE_LENGTH and end - at >= TABLE_FROM:
            base, stop = max(0, at - HISTORY), min(end, at + size)
            raw = np.frombuffer(data, np.uint8)[base : min(end, stop + TABLE_LENGTH)]
            n = len(raw)
            table = Matches(raw, np.maximum(0, np.arange(n) - HISTORY), np.full(n, n))
            places, longer = [], []
            after = base + table.walk(data, base, at - base, stop - base, end, 0, places, longer)
            places = np.array(places)
            distances, lengths = table.found(places, longer)
            ops += [(None, d, m) if m else (x, 0, 1) for d, m, x in zip(distances.tolist(), lengths.tolist(), raw[places].tolist())]
            size = min(TABLE, 2 * size) if 8 * len(places) >= stop - at else TABLE_FIRST
            at = after
        elif length:
            ops.append((None, distance, length))
            at += length
        else:
            ops.append((data[at], 0, 1))
            at += 1
    return ops


def encode(data: bytes, alignment: int = 0, endian: str = "BE") -> bytes:
    """A file that decodes to ``data``; the same input always gives the same bytes."""
    return Header(len(data), alignment).pack(endian) + packed_ops(compressed_ops(data))


def encode_all(files: list[bytes | None], alignment: int = 0, endian: str = "BE") -> list[bytes | None]:
    """encode() of every file, null for null; files of up to TOGETHER bytes find their matches together."""
    out: list[bytes | None] = [None] * len(files)
    mine, held = [], 0
    for i, data in enumerate(files):
        if data is None:
            continue
        if len(data) > TOGETHER:
            out[i] = encode(data, alignment, endian)
            continue
        if mine and held + len(data) > TOGETHER:
            for k, packed in zip(mine, _packed_together([files[k] for k in mine])):
                out[k] = Header(len(files[k]), alignment).pack(endian) + packed
            mine, held = [], 0
        mine.append(i)
        held += len(data)
    for k, packed in zip(mine, _packed_together([files[k] for k in mine])):
        out[k] = Header(len(files[k]), alignment).pack(endian) + packed
    return out


def _packed_together(files: list[bytes]) -> list[bytes]:
    """packed_ops(compressed_ops()) of every file."""
    data = b"".join(files)
    size = len(data)
    if not size:
        return [b""] * len(files)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([len(f) for f in files])
    ends = np.cumsum(sizes)
    low = np.maximum(np.repeat(ends - sizes, sizes), np.arange(size) - HISTORY)
    table, places, longer = Matches(raw, low, np.repeat(ends, sizes)), [], []
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        table.walk(data, 0, start, end, end, start, places, longer)
    places = np.array(places)
    far, copy = table.found(places, longer)
    far -= 1
    # Each operation's place: behind those before it in its file, and a header for every eight.
    width = np.where(copy == 0, 1, np.where(copy < LONG_FROM, 2, 3))
    first = np.searchsorted(places, ends - sizes)
    count = np.append(first[1:], len(places)) - first
    number = np.arange(len(places)) - np.repeat(first, count)
    heads = -(-count // OPS_PER_BLOCK)
    block = np.repeat(np.cumsum(heads) - heads, count) + number // OPS_PER_BLOCK
    to = np.cumsum(width) - width + block + 1
    out = np.zeros(int(width.sum() + heads.sum()), np.uint8)
    one, two, three = width == 1, width == 2, width == 3
    out[to[one]] = raw[places[one]]
    out[to[two]] = (copy[two] - 2) << 4 | far[two] >> 8
    out[to[two] + 1] = far[two] & 255
    out[to[three]] = far[three] >> 8
    out[to[three] + 1] = far[three] & 255
    out[to[three] + 2] = copy[three] - LONG_FROM
    begins = number % OPS_PER_BLOCK == 0
    header_at = (to[begins] - 1)[block]
    np.add.at(out, header_at[one], (128 >> number[one] % OPS_PER_BLOCK).astype(np.uint8))
    packed = out.tobytes()
    cuts = np.cumsum(np.bincount(np.repeat(np.arange(len(files)), count), width, len(files)).astype(np.int64) + heads).tolist()
    return [packed[a:b] for a, b in zip([0, *cuts], cuts)]


Op = tuple[int | None, int, int]  # literal byte or None, distance, length


def split_ops(ops: list[Op], at: int, before: bytes) -> tuple[list[Op], list[Op]]:
    """Operations cut at decoded offset ``at``, after ``before``. A copy that is cut in two stays a copy on a side where it has three bytes, else becomes literals."""
    left, right, done, text = [], [], 0, bytearray(before[-HISTORY:])
    for literal, distance, length in ops:
        if literal is not None:
            text.append(literal)
        else:
            copied(text, distance, length)
        if done + length <= at:
            left.append((literal, distance, length))
        elif done >= at:
            right.append((literal, distance, length))
        else:
            for side, a, b in ((left, 0, at - done), (right, at - done, length)):
                side += [(None, distance, b - a)] if b - a >= SHORTEST else [(x, 0, 1) for x in text[len(text) - length + a : len(text) - length + b]]
        done += length
    return left, right


def inflated(ops: list[Op], count: int, before: bytes) -> list[Op] | None:
    """The same bytes in exactly ``count`` operations, by putting first bytes of copies down as literals; None where there are too few copies."""
    out, more, text = [], count - len(ops), bytearray(before[-HISTORY:])
    for literal, distance, length in ops:
        if literal is not None:
            text.append(literal)
            out.append((literal, 0, 1))
            continue
        copied(text, distance, length)
        own = text[len(text) - length :]
        cut = max(0, min(more, length - SHORTEST))
        # A copy of three bytes can only become three literals, which is two operations more.
        if more - cut >= 2:
            cut = length if more >= length - 1 else cut
        out += [(x, 0, 1) for x in own[:cut]] + ([(None, distance, length - cut)] if cut < length else [])
        more -= cut if cut < length else length - 1
    return out if more == 0 else None


def ops_of(data: bytes, endian: str = "BE", limit: int = OUTPUT_LIMIT) -> tuple[Header, list[list[Op]], bytes]:
    """The header, the operations of each block and the decoded bytes, a last copy's overshoot included."""
    c = Cursor(data, endian)
    header = read_header(c)
    if header.decompressed_size > limit:
        raise c.fail("output_too_large", "yaz0.header", header.decompressed_size)
    ops: list = []
    out = parse(c.named("blocks"), header.decompressed_size, ops, bytearray())
    blocks: list[list[Op]] = []
    for block, _, literal, distance, length, _ in ops:
        if block == len(blocks):
            blocks.append([])
        blocks[block].append((literal, distance, length))
    return header, blocks, bytes(out)


def with_blocks(data: bytes, first: int, count: int, ops: list[Op], endian: str = "BE") -> bytes:
    """The file with ``count`` blocks from number ``first`` on replaced by operations; all others and their bytes stay.

    Only the last block of a file may be short, so that elsewhere ``ops`` must
    fill whole blocks. The size in the header follows.
    """
    header, blocks, out = ops_of(data, endian)
    if first < 0 or count < 0 or first + count > len(blocks):
        raise DecodeError("out_of_bounds", "yaz0.blocks", first, count, len(blocks))
    if len(ops) % OPS_PER_BLOCK and first + count < len(blocks):
        raise DecodeError("short_block", "yaz0.blocks", first, len(ops))
    old = sum(n for b in blocks[first : first + count] for *_, n in b)
    starts: list = []
    c = Cursor(data, endian)
    read_header(c)
    parse(c, header.decompressed_size, None, None, starts)
    ends = [at for at, _ in starts] + [len(data)]
    size = header.decompressed_size - old + sum(n for *_, n in ops) + (len(out) - header.decompressed_size if first + count == len(blocks) else 0)
    return Header(size, header.alignment, header.unused).pack(endian) + data[HEADER_SIZE : ends[first]] + packed_ops(ops) + data[ends[first + count] :]


def splice(data: bytes, offset: int, length: int, new: bytes, endian: str = "BE", limit: int = OUTPUT_LIMIT) -> bytes:
    """The file with ``length`` decoded bytes at ``offset`` replaced.

    Only blocks from the edit's to the last one with a copy from before the
    edit's end, 4096 bytes beyond it at most, are encoded anew: those before and
    behind stay as they are. Where the new operations can't be made to fill whole
    blocks, all that follows is encoded anew.
    """
    c = Cursor(data, endian)
    header = read_header(c)
    if header.decompressed_size > limit:
        raise c.fail("output_too_large", "yaz0.header", header.decompressed_size)
    ops, starts, size = [], [], header.decompressed_size
    old = bytes(parse(c.named("blocks"), size, ops, bytearray(), starts)[:size])
    end = offset + length
    if offset < 0 or length < 0 or end > size:
        raise DecodeError("out_of_bounds", "yaz0.overwrite", offset, length, size)
    text = old[:offset] + new + old[end:]
    packed = Header(len(text), header.alignment, header.unused).pack(endian)
    if not starts:
        return packed + packed_ops(compressed_ops(text))
    first = max(0, bisect_right([d for _, d in starts], offset) - 1)
    last = first
    for block, _, literal, distance, n, at in ops[first * OPS_PER_BLOCK :]:
        if at > end + HISTORY:
            break
        if at < end or literal is None and at - distance < end:
            last = block
    behind = last + 1
    fresh = None
    if behind < len(starts):
        stop = starts[behind][1] + len(new) - length
        fresh = compressed_ops(text, starts[first][1], stop)
        fresh = inflated(fresh, -(-len(fresh) // OPS_PER_BLOCK) * OPS_PER_BLOCK, text[: starts[first][1]])
    head = packed + data[HEADER_SIZE : starts[first][0]]
    if fresh is None:
        return head + packed_ops(compressed_ops(text, starts[first][1]))
    return head + packed_ops(fresh) + data[starts[behind][0] :]
