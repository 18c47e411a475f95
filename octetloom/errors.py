"""Error codes with their messages, as data in lenient mode and raised in strict mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from octetloom.schemas import ERROR

T = TypeVar("T")

#: Every code that a decoder may return.
MESSAGES = {
    "out_of_bounds": "the range leaves its container",
    "offset_overflow": "the position cannot be represented",
    "offset_underflow": "the position lies before the start",
    "exhausted": "the stream ends before the value does",
    "restore_forwards": "a snapshot can only be restored backwards",
    "bad_magic": "the file does not begin as its format does",
    "bad_byte_order_mark": "the byte-order mark is neither of the two",
    "unknown_tag": "the tag names no node kind",
    "tag_needs_newer_version": "the node kind is newer than the file's version",
    "not_constructible": "the node kind cannot be read at this place",
    "index_out_of_range": "the table has no such entry",
    "truncated": "the compressed data ends early",
    "seekback_out_of_bounds": "a back-reference reaches before the first byte",
    "short_block": "only the last block may hold fewer operations",
    "output_too_large": "the declared size is above the limit",
    "bad_header_length": "the header has another length",
    "zero_sequence": "a name attribute has sequence 0",
    "unmappable_character": "the character is not in the code page",
    "not_found": "no entry has this name",
}


class DecodeError(ValueError):
    """An error of strict mode; carries its code and place, and the context that annotate() adds."""

    context: Context | None = None

    def __init__(self, code: str, component: str = "", offset: int | None = None, length: int | None = None, stream_length: int | None = None, path: tuple = ()) -> None:
        self.code, self.component, self.offset, self.length, self.stream_length, self.path = code, component, offset, length, stream_length, path
        super().__init__(f"{component}: {MESSAGES[code]}" + (f" (offset {offset})" if offset is not None else ""))

    def row(self) -> dict:
        return {k: getattr(self, k) for k in ("code", "component", "offset", "length", "stream_length")} | {"path": [dict(zip(("name", "kind", "offset", "size"), p)) for p in self.path]}


def error(code: str | Column, component: str, offset: Column | None = None, length: Column | None = None, stream_length: Column | None = None) -> Column:
    """An error as a column of the common type."""
    num = lambda c: F.lit(None).cast("decimal(20,0)") if c is None else c.cast("decimal(20,0)")
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.lit(component).alias("component"), num(offset).alias("offset"), num(length).alias("length"), num(stream_length).alias("stream_length"), F.array().cast(ERROR.split("path:")[1][:-1]).alias("path"))


def either(failed: Column, value: Column, problem: Column) -> Column:
    """struct<ok, value, error>: the error where ``failed``, else the value. A null condition gives a null value and no error."""
    bad = F.coalesce(failed, F.lit(False))
    return F.struct((~bad).alias("ok"), F.when(~bad, value).alias("value"), F.when(bad, problem).alias("error"))


def strict(result: Column) -> Column:
    """The value, or a failed query where there is an error."""
    return F.when(result["error"].isNull(), result["value"]).otherwise(F.raise_error(F.concat_ws(": ", result["error"]["component"], result["error"]["code"])))


def annotated(result: Column, note: str, value: Column | None = None, when: Column | None = None) -> Column:
    """The result with a note added to its error, if it has one: ``note`` alone or with a value, only where ``when`` holds. A note without its value says so."""
    text = F.lit(note) if value is None else F.concat(F.lit(f"{note}: "), F.coalesce(value.cast("string"), F.lit(UNKNOWN)))
    tail = F.concat(F.lit(" ("), text, F.lit(")"))
    tail = tail if when is None else F.when(when, tail).otherwise("")
    # One element of an array names the result, so that notes upon notes do not multiply the expression.
    return F.transform(F.array(result), lambda r: F.when(r["error"].isNull(), r).otherwise(r.withField("error.component", F.concat(r["error"]["component"], tail))))[0]


#: What stands for a note's value that could not be had.
UNKNOWN = "unknown"


@dataclass
class Context:
    """Notes that go with an error when known, and a flag when some are not."""

    notes: dict[str, object] = field(default_factory=dict)

    def note(self, name: str, value: object | None) -> Context:
        return Context({**self.notes, name: value})

    def note_if(self, condition: bool, name: str, value: object | None) -> Context:
        """A note only where the condition holds."""
        return self.note(name, value) if condition else self

    def note_or(self, name: str, value: object | None, otherwise: object) -> Context:
        """A note with something else to say where its value is not known."""
        return self.note(name, otherwise if value is None else value)

    def any_missing(self) -> bool:
        return any(v is None for v in self.notes.values())

    def lines(self) -> list[str]:
        known = [f"{k}: {v}" for k, v in self.notes.items() if v is not None]
        return known + ["some diagnostics failed to load"] * self.any_missing()


def annotate(call: Callable[..., T], *args, note: Callable[[DecodeError], Context] | Context) -> T:
    """The value of a call; its error gets the context, which is only built where there is one."""
    try:
        return call(*args)
    except DecodeError as e:
        e.context = note(e) if callable(note) else note
        raise
