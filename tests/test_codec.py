import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octetloom.codec import archive, lz, tree
from octetloom.codec.cursor import Cursor
from octetloom.errors import MESSAGES, DecodeError


def unhex(s):
    return bytes.fromhex(s)


@pytest.mark.parametrize(
    "start,copies,want",
    [
        (b"ABCDEF", [(3, 3)], b"ABCDEFDEF"),
        (b"HELLO", [(2, 2), (2, 2)], b"HELLOLOLO"),
        (b"AB", [(1, 5)], b"ABBBBBB"),
        (b"QRST", [(4, 4)], b"QRSTQRST"),
        (b"XY", [(1, 4094)], b"X" + b"Y" * 4095),
    ],
)
def test_copies(start, copies, want):
    out = bytearray(start)
    for c in copies:
        lz.copied(out, *c)
    assert bytes(out) == want


@pytest.mark.parametrize("start,copy", [(b"", (1, 1)), (b"AB", (3, 1))])
def test_copies_before_the_start_are_errors(start, copy):
    with pytest.raises(DecodeError) as e:
        lz.copied(bytearray(start), *copy)
    assert e.value.code == "seekback_out_of_bounds" and e.value.offset == copy[0] and e.value.stream_length == len(start)


BLOCKS = {
    "FF 01 02 03 04 05 06 07 08": [[(b, 0, 1) for b in range(1, 9)]],
    "96 11 10 11 00 1F 2E 22 31 22 33 44 30 04 A0 AA 42 A2 BB": [
        [(0x11, 0, 1), (None, 0x12, 3), (None, 0x20, 0x40), (0x22, 0, 1), (None, 0x123, 5), (0x33, 0, 1), (0x44, 0, 1), (None, 5, 5)],
        [(0xAA, 0, 1), (None, 0x2A3, 6), (0xBB, 0, 1)],
    ],
    "FF 09 08 07 06 05 04 03 02 40 10 0F CC 00 1F 1E": [[(b, 0, 1) for b in range(9, 1, -1)], [(None, 0x10, 3), (0xCC, 0, 1), (None, 0x20, 0x30)]],
}


@pytest.mark.parametrize("raw", BLOCKS)
def test_blocks_parse_and_pack(raw):
    ops = []
    lz.parse(Cursor(unhex(raw)), sum(o[2] for b in BLOCKS[raw] for o in b), ops)
    got = [[(o[2], o[3], o[4]) for o in ops if o[0] == i] for i in range(len(BLOCKS[raw]))]
    assert got == BLOCKS[raw]
    assert lz.packed_ops([o for b in BLOCKS[raw] for o in b]) == unhex(raw)


@pytest.mark.parametrize(
    "history,ahead,want",
    [
        (b"", b"AB", (0, 0)),
        (b"XYZ", b"Q!", (0, 0)),
        (b"A", b"AAAAA", (1, 5)),
        (b"ZZZZABCDABCD", b"ABCDABCDX", (8, 8)),
        (b"A", b"A" * 300, (1, 273)),
        (b"ABCDEFGH", b"QRSXYZ", (0, 0)),
        (b"AB", b"ABZ", (0, 0)),
    ],
)
def test_longest_match(history, ahead, want):
    assert lz.longest_match(history + ahead, len(history)) == want


def slow_match(data, at):
    best = (0, 0)
    for d in range(1, min(at, lz.HISTORY) + 1):
        n = 0
        while n < lz.LONGEST and at + n < len(data) and data[at + n] == data[at - d + n]:
            n += 1
        if n >= lz.SHORTEST and n >= best[1]:
            best = (d, n)
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aab", b"abcabc", b"\0" * 40]), max_size=40).map(b"".join), st.integers(0, 200))
def test_match_search_is_exhaustive(data, at):
    assert lz.longest_match(data, min(at, len(data))) == slow_match(data, min(at, len(data)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=20), st.sampled_from([b"xyz" * 50, b"\0" * 300])), max_size=12).map(b"".join), st.sampled_from(["BE", "LE"]))
def test_encode_decodes_back(data, endian):
    raw = lz.encode(data, 128, endian)
    got = lz.decode(raw, endian, with_ops=True)
    assert got.data == data and got.overshoot == 0 and got.header.alignment == 128
    assert lz.packed_ops([o[2:5] for o in got.ops]) == raw[16:]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_decoding_is_total(data):
    for raw in (data, lz.MAGIC + data, lz.Header(40).pack() + data):
        try:
            lz.decode(raw, limit=1 << 16)
        except DecodeError as e:
            assert e.code in MESSAGES
    for make in (lambda: list(tree.table_strings(b"BY\0\1" + data)), lambda: archive.members(b"SARC\0\x14\xfe\xff" + data)):
        try:
            make()
        except DecodeError as e:
            assert e.code in MESSAGES


def test_declared_size_rules():
    body = lz.packed_ops([(65, 0, 1), (None, 1, 10)])
    assert lz.decode(lz.Header(5).pack() + body).data == b"AAAAA" and lz.decode(lz.Header(5).pack() + body).overshoot == 6
    for raw, code in ((lz.Header(50).pack() + body, "truncated"), (lz.Header(1 << 31).pack(), "output_too_large"), (b"Yaz1" + bytes(12), "bad_magic"), (b"Yaz0", "exhausted")):
        with pytest.raises(DecodeError) as e:
            lz.decode(raw)
        assert e.value.code == code
    assert lz.decode(lz.splice(lz.encode(b"hello world", 8), 6, 5, b"there!")).data == b"hello there!"


@pytest.mark.parametrize("raw,mult,signed,unsigned", [(b"\xff", 31, 4294967295, 255), (b"\x80", 1, 4294967168, 128), (b"\xc0", 1, 4294967232, 192), (b"test", 31, 3556498, 3556498), (b"test", 101, 120556948, 120556948), (b"", 101, 0, 0)])
def test_name_hash(raw, mult, signed, unsigned):
    assert archive.name_hash(raw, mult) == signed and archive.name_hash(raw, mult, False) == unsigned


@pytest.mark.parametrize("endian", ["BE", "LE"])
def test_trees_and_archives_round_trip(endian):
    keys, strings = [b"a", b"", b"caf\xe9"], [b"x" * 300]
    raw = tree.packed(keys, strings, 3, endian)
    assert [s for _, _, s, _ in tree.table_strings(raw)] == keys and [s for _, _, s, _ in tree.table_strings(raw, "string")] == strings
    assert tree.string_at(raw, 2) == b"caf\xe9" and list(tree.table_strings(tree.packed(None, endian=endian))) == []
    with pytest.raises(DecodeError, match="no such entry"):
        tree.string_at(raw, 3)
    files = {b"a/b.txt": b"one", b"c": b"", b"\xe9" * 7: b"\0" * 9}
    assert {n: d for _, n, d in archive.members(archive.packed(files, endian=endian))} == files


def test_tags_and_scalars():
    assert tree.kind_of(0xD3, 2) == "UnsignedInteger32" and tree.kind_of(0xC3, 1, True) == "BinaryDataTable"
    for args, code in (((0xD3, 1), "tag_needs_newer_version"), ((0x00, 9), "unknown_tag"), ((0xC3, 9), "tag_needs_newer_version")):
        with pytest.raises(DecodeError) as e:
            tree.kind_of(*args)
        assert e.value.code == code
    assert [tree.scalar(k, 0xFFFFFFFE) for k in ("Bool", "Integer32", "UnsignedInteger32", "Null")] == [True, -2, 0xFFFFFFFE, None]
    assert tree.scalar("Float32", 0x40490FDB) == pytest.approx(3.14159274)


def test_cursor_moves():
    c = Cursor(b"ABCDEFGH", "LE")
    assert c.get("u16") == 0x4241 and c.place == 2
    snap = c.snapshot()
    left, right = c.partition(3, "head")
    assert left.read(3) == b"CDE" and right.place == 5 and right.read(3) == b"FGH" and left.path[0][0] == "head"
    c.skip(6)
    for move, code in ((lambda: c.skip(1), "out_of_bounds"), (lambda: c.read(1), "exhausted"), (lambda: c.rewind(9), "offset_underflow"), (lambda: c.seek(9), "out_of_bounds")):
        with pytest.raises(DecodeError) as e:
            move()
        assert e.value.code == code and c.offset == 8
    end = c.snapshot()
    c.restore(snap)
    with pytest.raises(DecodeError):
        c.restore(end)
    assert c.until(b"F") == (b"CDE", True) and c.until(b"Z") == (b"GH", False)
    c.seek(0)
    assert list(c.records(lambda x: x.get("u8"), 1, first=6)) == [71, 72]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_splice_changes_only_what_the_edit_reaches(data):
    word = st.sampled_from([b"ab", b"abc", b"xyz", b"\0", b"q", b"abcabcabc", bytes(range(40))])
    old = b"".join(data.draw(st.lists(word, max_size=80)))
    at = data.draw(st.integers(0, len(old)))
    n = data.draw(st.integers(0, len(old) - at))
    new = b"".join(data.draw(st.lists(word, max_size=6)))
    packed = lz.encode(old, 32, "LE")
    out = lz.splice(packed, at, n, new, "LE")
    back = lz.decode(out, "LE")
    assert back.data == old[:at] + new + old[at + n :] and back.header.alignment == 32
    header, blocks, _ = lz.ops_of(out, "LE")
    assert all(len(b) == 8 for b in blocks[:-1])


def test_splice_keeps_the_bytes_before_and_far_behind():
    rng = random.Random(2)
    old = bytes(rng.choice(b"abcdefgh ") for _ in range(60_000))
    packed = lz.encode(old)
    out = lz.splice(packed, 20_000, 5, b"something else")
    assert lz.decode(out).data == old[:20_000] + b"something else" + old[20_005:]
    same = next(i for i in range(16, len(packed)) if packed[i] != out[i])
    behind = next(i for i in range(1, len(packed)) if packed[-i] != out[-i])
    assert same > len(packed) * 0.3 and behind > len(packed) * 0.5


@given(st.binary(max_size=200).map(lambda b: b + b[:90] + b"zzzzzzz" + b[::2]), st.integers(0, 400))
def test_operations_split_and_inflate(data, at):
    ops = lz.compressed_ops(data)
    at = min(at, len(data))
    left, right = lz.split_ops(ops, at, b"")
    assert lz.decode(lz.Header(len(data)).pack() + lz.packed_ops(left + right)).data == data
    assert sum(n for *_, n in left) == at and all(n == 1 or n >= 3 for *_, n in left + right)
    for more in range(8):
        wide = lz.inflated(ops, len(ops) + more, b"")
        if wide is not None:
            assert len(wide) == len(ops) + more and lz.decode(lz.Header(len(data)).pack() + lz.packed_ops(wide)).data == data


def test_blocks_are_replaced_in_place():
    data = bytes(range(64)) * 3
    packed = lz.encode(data)
    header, blocks, _ = lz.ops_of(packed)
    out = lz.with_blocks(packed, 2, 1, [(65, 0, 1)] * 16)
    assert lz.decode(out).header.decompressed_size == len(data) + 8 and lz.decode(out).data[16:32] == b"A" * 16
    with pytest.raises(DecodeError, match="fewer"):
        lz.with_blocks(packed, 0, 1, [(65, 0, 1)])
    assert lz.decode(lz.with_blocks(packed, len(blocks) - 1, 1, [(66, 0, 1)])).data.endswith(b"B")
    with pytest.raises(DecodeError):
        lz.with_blocks(packed, len(blocks), 1, [])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 3000))
def test_ranges_of_long_files_keep_only_their_history(at, n):
    assert lz.decode_range(LONG_PACKED, at, n) == LONG[at : at + n]


LONG = b"".join(b"line %d of a long file\n" % (i * i % 977) for i in range(10_000))[:203_000]
LONG_PACKED = lz.encode(LONG)


@pytest.mark.parametrize("seed", range(12))
def test_tables_of_matches_give_what_the_search_gives(seed):
    r = random.Random(seed)
    again = r.randbytes(r.randrange(4060, 4140))
    parts = [bytes(3000), r.randbytes(700), bytes(r.choices(b"ab", k=2500)), again + again[:400] + again, bytes(r.choices(range(12), k=4000)), r.randbytes(40) * 30]
    data = b"".join(r.sample(parts, 4))
    at, end = (0, len(data)) if seed % 3 else (r.randrange(2000), len(data) - r.randrange(2000))
    found = []
    place = at
    while place < end:
        distance, length = lz.longest_match(data, place, lz.HISTORY, end)
        found.append((None, distance, length) if length else (data[place], 0, 1))
        place += length or 1
    assert lz.compressed_ops(data, at, end) == found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=60), st.sampled_from([b"aaaa", b"abcabcabcX", bytes(9000), LONG[:70_000], LONG[:5000] + LONG[:900], b"z" * 300])), max_size=12))
def test_files_encoded_together_are_as_encoded_alone(files):
    assert lz.encode_all(files, 32, "LE") == [None if f is None else lz.encode(f, 32, "LE") for f in files]
    for f, packed in zip(files, lz.encode_all(files)):
        if f is not None and len(f) < 1000:
            ops, at = [], 0
            while at < len(f):
                distance, length = lz.longest_match(f, at)
                ops.append((None, distance, length) if length else (f[at], 0, 1))
                at += length or 1
            assert packed == lz.Header(len(f)).pack() + lz.packed_ops(ops)
