"""Magic, byte-order marks, single-byte text, versions and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from octetloom.errors import either, error

#: Code pages by name; any that Spark's decode() knows can be registered.
ENCODINGS = {"latin1": "ISO-8859-1", "ascii": "US-ASCII", "utf8": "UTF-8"}


def register_encoding(name: str, charset: str) -> None:
    ENCODINGS[name] = charset


def decoded(b: Column, encoding: str = "latin1") -> Column:
    """Text of bytes."""
    return F.decode(b, ENCODINGS[encoding])


def encoded(s: Column, encoding: str = "latin1") -> Column:
    """Bytes of text, or an error where a character is not in the page."""
    if encoding == "utf8":
        return either(F.lit(False), F.encode(s, "UTF-8"), error("unmappable_character", encoding))
    most = "\\x{FF}" if encoding == "latin1" else "\\x{7F}"
    bad = s.rlike(f"[^\\x{{00}}-{most}]")
    return either(bad, F.encode(F.when(~bad, s), ENCODINGS[encoding]), error("unmappable_character", encoding))


def magic(b: Column, expected: bytes, component: str = "magic") -> Column:
    """struct<ok, value, error>: the first bytes where they are as expected."""
    got = F.substring(b, 1, len(expected))
    return either(got != F.lit(expected), got, error(F.when(F.length(b) < len(expected), "exhausted").otherwise("bad_magic"), component, F.lit(0), F.lit(len(expected)), F.length(b)))


def byte_order(b: Column, big: bytes = b"\xfe\xff", offset: int = 0) -> Column:
    """'BE' for the mark as given, 'LE' for it swapped, else an error."""
    got = F.substring(b, offset + 1, 2)
    endian = F.when(got == F.lit(big), "BE").when(got == F.lit(big[::-1]), "LE")
    return either(endian.isNull(), endian, error(F.when(F.length(b) < offset + 2, "exhausted").otherwise("bad_byte_order_mark"), "byte_order_mark", F.lit(offset), F.lit(2), F.length(b)))


def version_text(parts: Column) -> Column:
    """An array of numbers as in ``v1.2.3``."""
    return F.concat(F.lit("v"), F.array_join(F.transform(parts, lambda x: x.cast("string")), "."))


def version_word(word: Column) -> Column:
    """The high and low byte of a 16-bit version."""
    return F.array(F.shiftright(word.cast("int"), 8), word.cast("int").bitwiseAND(255))


def formatted(v: Column, base: int = 10, width: int = 0, upper: bool = True, prefix: str = "", group: int = 0, separator: str = "_") -> Column:
    """An unsigned integer in base 2 to 36: padded with zeros to ``width`` digits, grouped from the right, then prefixed."""
    digits = F.conv(v.cast("string"), 10, base)
    digits = F.upper(digits) if upper else F.lower(digits)
    if width:
        digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0")
    if group:
        digits = F.reverse(F.regexp_replace(F.reverse(digits), f"(.{{{group}}})(?=.)", f"$1{separator}"))
    return F.concat(F.lit(prefix), digits)


def raw_text(b: Column) -> Column:
    """``b'…'`` for valid UTF-8, else ``0x`` and hex."""
    return F.when(F.is_valid_utf8(b.cast("string")), F.concat(F.lit("b'"), F.decode(b, "UTF-8"), F.lit("'"))).otherwise(F.concat(F.lit("0x"), F.hex(b)))
