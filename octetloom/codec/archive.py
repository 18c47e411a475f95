"""Hashed archives (SARC with an SFAT table): header, entries, names and members."""

from __future__ import annotations

from dataclasses import dataclass

from octetloom.codec.cursor import Cursor
from octetloom.errors import DecodeError

# Fixed values of the format.
MAGIC, TABLE_MAGIC, NAMES_MAGIC = b"SARC", b"SFAT", b"SFNT"
HEADER_LENGTH, TABLE_HEADER_LENGTH, ENTRY_LENGTH = 0x14, 0x0C, 16
DEFAULT_MULTIPLIER = 0x65


def name_hash(name: bytes, multiplier: int = DEFAULT_MULTIPLIER, signed: bool = True) -> int:
    h = 0
    for c in name:
        h = (h * multiplier + (c - 256 if signed and c > 127 else c)) & 0xFFFFFFFF
    return h


@dataclass(frozen=True)
class Header:
    endian: str
    size: int
    data_offset: int
    version: tuple[int, int]


@dataclass(frozen=True)
class Entry:
    filename_hash: int
    sequence: int | None
    hash_index: int | None
    start_offset: int
    end_offset: int


def read_header(c: Cursor) -> Header:
    """The mark at byte 6 is read first: it says how to read the length before it."""
    if c.peek(4, "archive.magic") != MAGIC:
        raise c.fail("bad_magic", "archive.magic", 4)
    mark = c.peek(8, "archive.mark")[6:]
    if mark not in (b"\xfe\xff", b"\xff\xfe"):
        raise c.fail("bad_byte_order_mark", "archive.mark", 2)
    c.endian = "BE" if mark == b"\xfe\xff" else "LE"
    c.skip(4)
    if c.get("u16") != HEADER_LENGTH:
        raise c.fail("bad_header_length", "archive.header", HEADER_LENGTH)
    c.skip(2)
    size, data_offset, version = c.get("u32"), c.get("u32"), c.get("u16")
    c.skip(2)
    return Header(c.endian, size, data_offset, (version >> 8, version & 255))


def read_table_header(c: Cursor) -> tuple[int, int]:
    """The number of entries and the hash multiplier."""
    if c.read(4, "table.magic") != TABLE_MAGIC:
        c.rewind(4)
        raise c.fail("bad_magic", "table.magic", 4)
    c.get("u16")
    return c.get("u16"), c.get("u32")


def read_entry(c: Cursor) -> Entry:
    h, word, start, end = (c.get("u32") for _ in range(4))
    if word and not word >> 24:
        raise c.fail("zero_sequence", "table.entry.attributes")
    return Entry(h, word >> 24 if word else None, word & 0xFFFFFF if word else None, start, end)


def members(data: bytes) -> list[tuple[Entry, bytes | None, bytes]]:
    """Every entry with its name and contents. (The layout after the entry table is this engine's extension.)"""
    c = Cursor(data)
    head = read_header(c)
    count, _ = read_table_header(c)
    entries = list(c.named("table").records(read_entry, ENTRY_LENGTH, count=count)) if count else []
    c.skip(count * ENTRY_LENGTH)
    if c.read(4, "names.magic") != NAMES_MAGIC:
        raise c.fail("bad_magic", "names.magic", 4)
    c.skip(4)
    names, start = c.fork(), c.offset
    out = []
    for e in entries:
        name = None
        if e.hash_index is not None:
            names.seek(start + 4 * e.hash_index)
            name = names.until()[0]
        a, b = head.data_offset + e.start_offset, head.data_offset + e.end_offset
        if not a <= b <= len(data):
            raise DecodeError("out_of_bounds", "archive.member", a, b - a, len(data))
        out.append((e, name, data[a:b]))
    return out


def packed(files: dict[bytes, bytes], multiplier: int = DEFAULT_MULTIPLIER, endian: str = "BE") -> bytes:
    """An archive of the files, entries by hash and, within one, by name."""
    order = "big" if endian == "BE" else "little"
    u = lambda x, n: x.to_bytes(n, order)
    table, names, body, seen = b"", b"", b"", {}
    for name in sorted(files, key=lambda x: (name_hash(x, multiplier), x)):
        h = name_hash(name, multiplier)
        seen[h] = seen.get(h, 0) + 1
        table += u(h, 4) + u(seen[h] << 24 | len(names) // 4, 4) + u(len(body), 4) + u(len(body) + len(files[name]), 4)
        names += name + b"\0" * (4 - len(name) % 4)
        body += files[name]
    table = TABLE_MAGIC + u(TABLE_HEADER_LENGTH, 2) + u(len(files), 2) + u(multiplier, 4) + table
    names = NAMES_MAGIC + u(8, 2) + u(0, 2) + names
    at = HEADER_LENGTH + len(table) + len(names)
    head = MAGIC + u(HEADER_LENGTH, 2) + u(0xFEFF, 2) + u(at + len(body), 4) + u(at, 4) + u(0x0100, 2) + u(0, 2)
    return head + table + names + body
