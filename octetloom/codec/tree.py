"""Tagged tree files (BYML): header, string tables and scalar nodes.

A two-byte mark sets the byte order: ``BY`` big, ``YB`` little end first. A
16-bit version and 32-bit offsets of the key table, the string table, on demand
a binary table, and the root follow; offset 0 means absent.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from octetloom.codec.cursor import Cursor
from octetloom.errors import DecodeError

# Fixed values of the format: tag, name, first version.
TAGS = {
    0xA0: ("String", 1),
    0xA1: ("BinaryData", 4),
    0xA2: ("BinaryDataWithParameter", 5),
    0xC0: ("Array", 1),
    0xC1: ("Dictionary", 1),
    0xC2: ("StringTable", 1),
    0xC3: ("BinaryDataTable", None),
    0xD0: ("Bool", 1),
    0xD1: ("Integer32", 1),
    0xD2: ("Float32", 1),
    0xD3: ("UnsignedInteger32", 2),
    0xD4: ("Integer64", 3),
    0xD5: ("UnsignedInteger64", 3),
    0xD6: ("Float64", 3),
    0xFF: ("Null", 1),
}
MARK = b"BY"
IN_PLACE = ("String", "Bool", "Integer32", "Float32", "UnsignedInteger32", "Null")
AT_OFFSET = ("StringTable",)


@dataclass(frozen=True)
class Header:
    endian: str
    version: int
    key_table_offset: int | None
    string_table_offset: int | None
    binary_data_table_offset: int | None
    root_data_offset: int | None


def read_header(c: Cursor, binary_table: bool = False) -> Header:
    """Reads the header and leaves the cursor in the file's byte order."""
    mark = c.read(2, "tree.mark")
    if mark not in (MARK, MARK[::-1]):
        c.rewind(2)
        raise c.fail("bad_byte_order_mark", "tree.mark", 2)
    c.endian = "BE" if mark == MARK else "LE"
    version = c.get("u16")
    key, string = c.get("u32"), c.get("u32")
    binary = c.get("u32") if binary_table else 0
    return Header(c.endian, version, key or None, string or None, binary or None, c.get("u32") or None)


def kind_of(tag: int, version: int, binary_table: bool = False) -> str:
    """The node kind of a tag, if the file's version has it."""
    if tag not in TAGS:
        raise DecodeError("unknown_tag", f"tag 0x{tag:02X}")
    name, first = TAGS[tag]
    if binary_table and tag in (0xA1, 0xC3):
        return name
    if first is None or version < first:
        raise DecodeError("tag_needs_newer_version", f"tag 0x{tag:02X}")
    return name


def scalar(kind: str, word: int):
    """The value of a scalar node from its 32-bit word."""
    if kind in ("String", "UnsignedInteger32"):
        return word
    if kind == "Bool":
        return word != 0
    if kind == "Integer32":
        return word - (1 << 32) if word >> 31 else word
    if kind == "Float32":
        return struct.unpack(">f", word.to_bytes(4, "big"))[0]
    if kind == "Null":
        return None
    raise DecodeError("not_constructible", kind)


def table_strings(data: bytes, which: str = "key", binary_table: bool = False) -> Iterator[tuple[int, int, bytes, bool]]:
    """(number, offset from the node, bytes, terminated) of every string of the key or string table; none if the table is absent."""
    c = Cursor(data)
    header = read_header(c, binary_table)
    at = header.key_table_offset if which == "key" else header.string_table_offset
    if at is None:
        return
    size = 20 if binary_table else 16
    if at < size:
        raise DecodeError("out_of_bounds", f"tree.{which}_table", at, None, len(data))
    c.seek(at)
    c = c.named(f"{which}_table")
    tag = c.get("u8")
    if kind_of(tag, header.version, binary_table) not in AT_OFFSET:
        raise c.fail("not_constructible", f"tree.{which}_table")
    count = c.get("u24")
    offsets = [c.get("u32") for _ in range(count + 1)]
    for i in range(count):
        c.seek(at + offsets[i])
        raw, ended = c.until()
        yield i, offsets[i], raw, ended


def string_at(data: bytes, index: int, which: str = "key") -> bytes:
    """One string; the header and the table's offsets are all that is read besides."""
    c = Cursor(data)
    header = read_header(c)
    at = header.key_table_offset if which == "key" else header.string_table_offset
    if at is None:
        raise DecodeError("index_out_of_range", f"tree.{which}_table", index, None, 0)
    c.seek(at)
    kind_of(c.get("u8"), header.version)
    count = c.get("u24")
    if not 0 <= index < count:
        raise DecodeError("index_out_of_range", f"tree.{which}_table", index, None, count)
    c.skip(4 * index)
    c.seek(at + c.get("u32"))
    return c.until()[0]


def packed_table(strings: list[bytes], endian: str = "BE") -> bytes:
    order = "big" if endian == "BE" else "little"
    at, offsets = 4 + 4 * (len(strings) + 1), []
    for s in strings:
        offsets.append(at)
        at += len(s) + 1
    return b"\xc2" + len(strings).to_bytes(3, order) + b"".join(o.to_bytes(4, order) for o in [*offsets, at]) + b"".join(s + b"\0" for s in strings)


def packed(keys: list[bytes] | None, strings: list[bytes] | None = None, version: int = 1, endian: str = "BE") -> bytes:
    """A file of a key table and a string table, each absent if None."""
    order = "big" if endian == "BE" else "little"
    tables, offsets, at = b"", [], 16
    for t in (keys, strings):
        raw = b"" if t is None else packed_table(t, endian)
        offsets.append(at if raw else 0)
        tables, at = tables + raw, at + len(raw)
    return (MARK if endian == "BE" else MARK[::-1]) + version.to_bytes(2, order) + b"".join(o.to_bytes(4, order) for o in [*offsets, 0]) + tables
