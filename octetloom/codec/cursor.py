"""A cursor over bytes: what sequential decoders read through.

It knows its byte order and the path of named parts that led to it, so an error
says where in the file it happened. A failed move leaves it where it was.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from octetloom.errors import DecodeError

_FORMATS = {"u8": "B", "i8": "b", "u16": "H", "i16": "h", "u32": "I", "i32": "i", "u64": "Q", "i64": "q", "f32": "f", "f64": "d"}


@dataclass
class Cursor:
    """``data`` from ``start`` to ``end``; ``offset`` counts from ``start``, ``base`` is the place of ``start`` in the whole file."""

    data: bytes
    endian: str = "BE"
    offset: int = 0
    start: int = 0
    end: int = -1
    base: int = 0
    path: tuple[tuple[str, str, int, int], ...] = ()

    def __post_init__(self) -> None:
        if self.end < 0:
            self.end = len(self.data)

    def __len__(self) -> int:
        return self.end - self.start

    @property
    def remaining(self) -> int:
        return len(self) - self.offset

    @property
    def place(self) -> int:
        """The absolute offset in the file."""
        return self.base + self.offset

    def fail(self, code: str, component: str, length: int | None = None) -> DecodeError:
        return DecodeError(code, component, self.place, length, len(self), self.path)

    def peek(self, n: int, component: str = "bytes") -> bytes:
        if n > self.remaining:
            raise self.fail("exhausted", component, n)
        at = self.start + self.offset
        return self.data[at : at + n]

    def read(self, n: int, component: str = "bytes") -> bytes:
        out = self.peek(n, component)
        self.offset += n
        return out

    def get(self, kind: str):
        """A primitive in the cursor's byte order."""
        order = "big" if self.endian == "BE" else "little"
        if kind == "bool":
            return self.read(1, kind) != b"\0"
        if kind == "u24":
            return int.from_bytes(self.read(3, kind), order)
        if kind in ("u128", "i128"):
            return int.from_bytes(self.read(16, kind), order, signed=kind[0] == "i")
        code = (">" if self.endian == "BE" else "<") + _FORMATS[kind]
        return struct.unpack(code, self.read(struct.calcsize(code), kind))[0]

    def skip(self, n: int) -> None:
        if n < 0 or n > self.remaining:
            raise self.fail("out_of_bounds", "skip", n)
        self.offset += n

    def rewind(self, n: int) -> None:
        if n > self.offset:
            raise self.fail("offset_underflow", "rewind", n)
        self.offset -= n

    def seek(self, to: int) -> None:
        if not 0 <= to <= len(self):
            raise self.fail("out_of_bounds", "seek", to)
        self.offset = to

    def snapshot(self) -> tuple[int, str]:
        return self.offset, self.endian

    def restore(self, snapshot: tuple[int, str]) -> None:
        if snapshot[0] > self.offset:
            raise self.fail("restore_forwards", "restore")
        self.offset, self.endian = snapshot

    def fork(self) -> Cursor:
        """A second cursor at the same place, with the same order and path."""
        return replace(self)

    def named(self, name: str, size: int | None = None) -> Cursor:
        """The same place as a named part of where it is."""
        return replace(self, path=(*self.path, (name, "physical", self.place, self.remaining if size is None else size)))

    def partition(self, n: int, name: str = "part") -> tuple[Cursor, Cursor]:
        """The next ``n`` bytes and what follows them, each with its true place."""
        if not 0 <= n <= self.remaining:
            raise self.fail("out_of_bounds", "partition", n)
        at = self.start + self.offset
        left = replace(self, start=at, end=at + n, offset=0, base=self.place, path=(*self.path, (name, "physical", self.place, n)))
        return left, replace(self, start=at + n, offset=0, base=self.place + n)

    def until(self, needle: bytes = b"\0") -> tuple[bytes, bool]:
        """The bytes before the needle, which is passed over, and whether there was one."""
        at = self.data.find(needle, self.start + self.offset, self.end)
        stop = self.end if at < 0 else at
        out = self.data[self.start + self.offset : stop]
        self.offset = stop - self.start + (len(needle) if at >= 0 else 0)
        return out, at >= 0

    def finish(self, width: int, total: int) -> None:
        """To the end of a table of ``total`` records that starts here, or to the end of the bytes if they stop before."""
        self.skip(min(width * total, self.remaining))

    def records(self, read: Callable[[Cursor], object], width: int | None = None, first: int = 0, count: int | None = None) -> Iterator[object]:
        """Records from number ``first`` on, ``count`` of them or to the end; those of known width are jumped over, others read and dropped."""
        if width is not None:
            self.skip(min(first * width, self.remaining) if count is None else first * width)
        else:
            for _ in range(first):
                read(self)
        n = 0
        while self.remaining and (count is None or n < count):
            yield read(self)
            n += 1
        if count is not None and n < count:
            raise self.fail("exhausted", f"record[{first + n}]")
