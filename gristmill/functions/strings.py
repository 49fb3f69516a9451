"""Text methods as Columns; positions count from one, negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(s: Column, i: int) -> Column:
    return F.lit(i) if i > 0 else F.greatest(F.length(s) + i + 1, F.lit(1))


def span(s: Column, start: int, length: int | None = None) -> Column:
    """``length`` characters from ``start`` on, or all that follow."""
    return F.substring(s, _at(s, start), F.length(s) if length is None else F.lit(length))


def sub(s: Column, start: int, end: int = -1) -> Column:
    """Characters ``start`` to ``end``, both included."""
    first, last = _at(s, start), F.lit(end) if end > 0 else F.length(s) + end + 1
    return F.substring(s, first, F.greatest(last - first + 1, F.lit(0)))


def lines(s: Column) -> Column:
    return F.split(s, r"\r\n|\n|\r", -1)


def split(s: Column, pattern: str) -> Column:
    """Parts between matches, without empty ones."""
    return F.filter(F.split(s, pattern, -1), lambda x: x != "")


def code_at(s: Column, i: int) -> Column:
    """Code point at a place, or null beyond the end."""
    return F.when(F.length(s) >= abs(i), F.ascii(F.substring(s, _at(s, i), F.lit(1))))


def codes(s: Column, start: int, end: int) -> Column:
    """Code points of a stretch."""
    return F.transform(F.filter(F.split(sub(s, start, end), ""), lambda c: c != ""), F.ascii)


def position(s: Column, char: str) -> Column:
    """Place of the first ``char``, or -1."""
    place = F.instr(s, char)
    return F.when(place > 0, place).otherwise(-1)


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exclude(s: Column, chars: str) -> Column:
    return F.translate(s, chars, "")


def span_without(s: Column, chars: str) -> Column:
    """Length of the beginning that has none of ``chars``."""
    places = [F.when(F.instr(s, c) > 0, F.instr(s, c) - 1) for c in chars]
    return F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.length(s))


def number(s: Column) -> Column:
    """The whole number that the text begins with, or null."""
    return F.regexp_extract(s, r"^[ ]*([0-9]{1,18})", 1).try_cast("bigint")


def found(s: Column, pattern: str) -> Column:
    """Start and end of the first match, or null."""
    hit, before = F.regexp_extract(s, pattern, 0), F.split(s, pattern, 2)
    return F.when(F.regexp_like(s, F.lit(pattern)), F.struct((F.length(before[0]) + 1).alias("start"), (F.length(before[0]) + F.length(hit)).alias("end")))


_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def base32(s: Column) -> Column:
    """Lower-case base 32 of the UTF-8 bytes, without padding."""
    digits = F.hex(s.cast("binary"))
    # Five bytes at a time are eight digits; the last group is filled with zeros and its digits beyond the text are cut.
    filled = F.concat(digits, F.repeat(F.lit("0"), F.pmod(-F.length(digits), F.lit(10)).cast("int")))
    groups = F.transform(F.regexp_extract_all(filled, F.lit(".{10}"), F.lit(0)), lambda g: F.lpad(F.conv(g, 16, 32), 8, "0"))
    coded = F.translate(F.array_join(groups, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)
    return F.when(F.length(s) == 0, "").otherwise(F.substring(coded, F.lit(1), F.ceil(F.length(digits) * 4 / 5).cast("int")))
