"""Utility functions on texts, numbers and patterns as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.operators.maps import glob_pattern


def is_uppercase(s: Column) -> Column:
    """More than half of at least one ASCII letter is a capital."""
    capitals = F.length(s) - F.length(F.regexp_replace(s, "[A-Z]", ""))
    small = F.length(s) - F.length(F.regexp_replace(s, "[a-z]", ""))
    return (capitals > 0) & (capitals > small)


def equal_caseless(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def caseless_hash(s: Column) -> Column:
    """60 bits of the MD5 of the lower-cased text."""
    return F.conv(F.substring(F.md5(F.lower(s).cast("binary")), 1, 15), 16, 10).cast("bigint")


def outside_range(s: Column, last: int = 0x24F) -> Column:
    """Whether a character lies beyond code point ``last``."""
    return F.regexp_like(s, F.lit(rf"[^\x{{0}}-\x{{{last:X}}}]"))


def statistics(s: Column) -> dict[str, Column]:
    """Digits, letters and white space of a text."""
    return {n: (F.length(s) - F.length(F.regexp_replace(s, p, ""))) for n, p in (("digits", "[0-9]"), ("letters", "[A-Za-z]"), ("spaces", "[ \t\r\n]"))}


def decode_url(s: Column) -> Column:
    """Percent escapes and plus signs of plain ASCII text undone; broken escapes give null."""
    return F.try_url_decode(s)


def normalize_prob(p: Column, bias: float = 0.5) -> Column:
    """How far a probability is beyond ``bias``, from 0 to 1, as a fourth power."""
    return F.pow((p - bias) * 2, F.lit(8.0))


def fold_header(name: str, value: Column, width: int = 76) -> Column:
    """Header with line breaks put in at spaces, so that lines have about ``width`` characters."""
    return F.concat(F.lit(name + ": "), F.regexp_replace(value, rf"(.{{1,{width}}}) ", "$1\r\n\t"))


def header_encode(s: Column) -> Column:
    """An encoded word if the text has other than ASCII characters, else the text."""
    raw = F.regexp_replace(F.base64(s.cast("binary")), "[\r\n]", "")
    return F.when(F.regexp_like(s, F.lit(r"[^\x00-\x7F]")), F.concat(F.lit("=?UTF-8?B?"), raw, F.lit("?="))).otherwise(s)


def pattern_search(s: Column, pattern: str, most: int | None = None) -> Column:
    """All matches, or the first ``most``."""
    hits = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return hits if most is None else F.slice(hits, 1, most)


def match_glob(s: Column, glob: str) -> Column:
    return s.rlike(glob_pattern(glob))


def match_plain(s: Column, text: str) -> Column:
    return F.contains(s, F.lit(text))


def trie_matches(s: Column, texts: list[str]) -> Column:
    """Which of the texts occur, in the list's order."""
    return F.filter(F.array(*[F.when(F.contains(s, F.lit(t)), F.lit(t)) for t in texts]), lambda x: x.isNotNull())
