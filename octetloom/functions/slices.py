"""Ranges of a byte column: guarded reads, windows, cursor moves and functional edits.

``substring`` cuts silently at the end, so every range is checked first. Moves
return the new position or an error; edits return new bytes or an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from octetloom.errors import either, error

_D = "decimal(21,0)"


def _col(x: int | Column) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def outside(offset: int | Column, n: int | Column, length: Column) -> Column:
    """Whether [offset, offset + n) leaves [0, length). An empty range at the end is inside."""
    offset, n = _col(offset).cast(_D), _col(n).cast(_D)
    return (offset < 0) | (n < 0) | (offset + n > length.cast(_D))


def _cut(b: Column, offset: Column, n: Column | None = None) -> Column:
    start = (offset + 1).cast("int")
    return F.substring(b, start, F.length(b) if n is None else n.cast("int"))


def read_at(b: Column, offset: int | Column, n: int | Column, component: str = "bytes") -> Column:
    """Exactly ``n`` bytes at ``offset``."""
    offset, n = _col(offset), _col(n)
    return either(outside(offset, n, F.length(b)), _cut(b, offset, n), error("out_of_bounds", component, offset, n, F.length(b)))


def window(b: Column, start: int | Column, size: int | Column | None = None) -> Column:
    """The bytes from ``start``, ``size`` of them or all that are left. Windows of windows never reach outside."""
    start = _col(start)
    return read_at(b, start, F.greatest(F.length(b) - start, F.lit(0)) if size is None else size, "window")


def moved(position: Column, by: int | Column, length: Column) -> Column:
    """A cursor after a skip; landing on the end is legal."""
    by = _col(by)
    return either(outside(position, by, length), (position + by).cast("bigint"), error("out_of_bounds", "skip", position, by, length))


def rewound(position: Column, by: int | Column) -> Column:
    """A cursor moved back."""
    by = _col(by)
    return either(position < by, (position - by).cast("bigint"), error("offset_underflow", "rewind", position, by))


def sought(to: Column, length: Column) -> Column:
    """A cursor at an absolute position."""
    return either(outside(to, 0, length), to.cast("bigint"), error("out_of_bounds", "seek", to, None, length))


def restored(position: Column, snapshot: Column) -> Column:
    """A cursor back at a snapshot taken earlier."""
    return either(snapshot > position, snapshot.cast("bigint"), error("restore_forwards", "restore", snapshot, None, position))


def parted(b: Column, at: int | Column) -> Column:
    """struct<left, right> cut at ``at``."""
    at = _col(at)
    halves = F.struct(_cut(b, F.lit(0), at).alias("left"), _cut(b, at).alias("right"))
    return either(outside(0, at, F.length(b)), halves, error("out_of_bounds", "partition", at, None, F.length(b)))


def overwritten(b: Column, offset: int | Column, n: int | Column, data: Column) -> Column:
    """``n`` bytes at ``offset`` replaced by ``data`` of any length."""
    offset, n = _col(offset), _col(n)
    edit = F.concat(_cut(b, F.lit(0), offset), data, _cut(b, offset + n))
    return either(outside(offset, n, F.length(b)), edit, error("out_of_bounds", "overwrite", offset, n, F.length(b)))


def mutated(b: Column, offset: int | Column, data: Column) -> Column:
    """``data`` written over as many bytes at ``offset``."""
    return overwritten(b, offset, F.length(data), data)


def resized(b: Column, offset: int | Column, old: int | Column, new: int | Column) -> Column:
    """A region of ``old`` bytes made ``new`` long: zeros after it, or its end dropped; what follows moves."""
    offset, old, new = _col(offset), _col(old), _col(new)
    zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(new - old, F.lit(0)).cast("int")))
    edit = F.concat(_cut(b, F.lit(0), offset + F.least(old, new)), zeros, _cut(b, offset + old))
    return either(outside(offset, old, F.length(b)) | (new < 0), edit, error("out_of_bounds", "resize", offset, old, F.length(b)))


def committed(keep: Column, edited: Column, original: Column) -> Column:
    """An edit taken only where ``keep`` holds."""
    return F.when(keep, edited).otherwise(original)


def until(b: Column, needle: Column, start: int | Column = 0) -> Column:
    """struct<value, terminated>: the bytes from ``start`` before the first needle, or all that are left without one."""
    start = _col(start)
    rest = _cut(b, start)
    at = F.position(needle, rest)
    return F.struct(F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest).alias("value"), (at > 0).alias("terminated"))


def edited_window(b: Column, start: int | Column, size: int | Column, edit: Callable[[Column], Column]) -> Column:
    """The bytes with a window of them edited in place: ``edit`` gets the window and returns as many bytes. One of another length is an error."""
    start, size = _col(start), _col(size)
    new = edit(_cut(b, start, size))
    whole = F.concat(_cut(b, F.lit(0), start), new, _cut(b, start + size))
    return either(outside(start, size, F.length(b)) | (F.length(new) != size), whole, error("out_of_bounds", "window", start, size, F.length(b)))


def written(b: Column, position: int | Column, data: Column) -> Column:
    """struct<bytes, position> after ``data`` is written over as many bytes at a cursor, which moves behind it."""
    position = _col(position)
    edit = mutated(b, position, data)
    after = F.struct(edit["value"].alias("bytes"), (position + F.length(data)).cast("bigint").alias("position"))
    return F.struct(edit["ok"].alias("ok"), F.when(edit["ok"], after).alias("value"), edit["error"].alias("error"))


def part_edited(b: Column, at: int | Column, head: Callable[[Column], Column] | None = None, tail: Callable[[Column], Column] | None = None) -> Column:
    """The bytes cut at ``at``, either half edited, and joined again. The head keeps its length; the tail may change it."""
    at = _col(at)
    left, right = _cut(b, F.lit(0), at), _cut(b, at)
    new = head(left) if head else left
    whole = F.concat(new, tail(right) if tail else right)
    return either(outside(0, at, F.length(b)) | (F.length(new) != at), whole, error("out_of_bounds", "partition", at, None, F.length(b)))


def tail_resized(b: Column, at: int | Column, size: int | Column) -> Column:
    """The bytes with all from ``at`` on made ``size`` long: zeros added or the end dropped."""
    at, size = _col(at), _col(size)
    return resized(b, at, F.greatest(F.length(b) - at, F.lit(0)), size)


def table_end(start: int | Column, width: int, total: int | Column, length: Column) -> Column:
    """Where a table of ``total`` records of ``width`` bytes ends, or the end of the bytes if they stop before."""
    return F.least(_col(start) + _col(total) * width, length).cast("bigint")
