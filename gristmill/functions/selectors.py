"""The selector language: ``extractor(args).transform(args):method;...`` compiled to Columns.

A selector takes values from a row and pipes them through transforms. A
transform on a list works on each element, except those that fold lists. Several
selectors are separated by ``;`` and combined by ``combine``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text as T

_CALL = re.compile(r"""\s*([A-Za-z_]\w*)\s*(?:\(((?:[^()'"]|'[^']*'|"[^"]*")*)\))?\s*""")
_ARG = re.compile(r"""\s*(?:'([^']*)'|"([^"]*)"|([^,'"]+))\s*(?:,|$)""")


class SelectorError(ValueError):
    """The text is not a selector, or names an unknown extractor or transform."""


class Value:
    """A Column and whether it is a list."""

    def __init__(self, column: Column, is_list: bool = False):
        self.column, self.is_list = column, is_list


def _args(text: str | None) -> list[str]:
    return [m[1] if m[1] is not None else m[2] if m[2] is not None else m[3].strip() for m in _ARG.finditer(text)] if text and text.strip() else []


#: Extractors over a table with columns text, id, source, url where they apply.
EXTRACTORS: dict[str, Callable[..., Value]] = {
    "id": lambda *a: Value(F.lit("".join(a))),
    "list": lambda *a: Value(F.array(*[F.lit(x) for x in a]), True),
    "col": lambda name: Value(F.col(name).cast("string")),
    "from": lambda *a: Value(F.col("source")),
    "languages": lambda *a: Value(F.array("lang"), True),
    "digest": lambda *a: Value(F.md5(F.col("text").cast("binary"))),
    "words": lambda *a: Value(T.words("text") if not a or a[0] in ("norm", "stem") else F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)), True),
    "urls": lambda *a: Value(F.regexp_extract_all("text", F.lit("https?://[A-Za-z0-9./?=&_-]+"), F.lit(0)), True),
    "emails": lambda *a: Value(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9.-]+"), F.lit(0)), True),
    "body": lambda *a: Value(F.col("text")),
}


def _each(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda v, *a: Value(F.transform(v.column, lambda x: f(x, *a)) if v.is_list else f(v.column, *a), v.is_list)


def _as_list(v: Value) -> Column:
    return v.column if v.is_list else F.array(v.column)


def _substring(x: Column, start: str, end: str = "-1") -> Column:
    n = F.length(x)
    i, j = (F.lit(int(k)) if int(k) >= 0 else n + int(k) + 1 for k in (start, end))
    i = F.greatest(i, F.lit(1))
    return F.substring(x, i, F.greatest(F.least(j, n) - i + 1, F.lit(0)))


def _digest(x: Column, encoding: str = "hex", algorithm: str = "sha256") -> Column:
    sizes = {"sha256": 256, "sha512": 512}
    raw = x.cast("binary")
    hexed = F.md5(raw) if algorithm == "md5" else F.sha1(raw) if algorithm == "sha1" else F.sha2(raw, sizes[algorithm])
    return hexed if encoding == "hex" else F.base64(F.unhex(hexed))


def _keep(ok: Callable[[Column, list[str]], Column]) -> Callable[..., Value]:
    return lambda v, *a: Value(F.filter(v.column, lambda x: ok(x, list(a))) if v.is_list else F.when(ok(v.column, list(a)), v.column), v.is_list)


def _every_nth(values: Column, n: int, sep: str) -> Column:
    """Each ``n`` neighbours joined to one text."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / n).cast("int") - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.transform(starts, lambda k: F.array_join(F.slice(values, k * n + 1, n), sep))).otherwise(F.array().cast("array<string>"))


def _masked(ip: Column, bits: int) -> Column:
    """The IPv4 network of ``bits`` bits that holds the address."""
    net = T.ip_number(ip) - F.pmod(T.ip_number(ip), F.lit(1 << (32 - bits)))
    return F.concat_ws(".", *[F.floor(net / (1 << shift)).cast("long").bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)])


#: Transforms by name; each takes a Value and text arguments.
TRANSFORMS: dict[str, Callable[..., Value]] = {
    "lower": _each(lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    "lower_utf8": _each(F.lower),
    "first": lambda v: Value(F.try_element_at(_as_list(v), F.lit(1))),
    "last": lambda v: Value(F.try_element_at(_as_list(v), F.lit(-1))),
    "nth": lambda v, n: Value(F.try_element_at(_as_list(v), F.lit(int(n)))),
    "take_n": lambda v, n: Value(F.slice(_as_list(v), 1, int(n)), True),
    "drop_n": lambda v, n: Value(F.slice(_as_list(v), int(n) + 1, F.greatest(F.size(_as_list(v)) - int(n), F.lit(0))), True),
    "join": lambda v, sep="": Value(F.array_join(_as_list(v), sep)),
    "sort": lambda v: Value(F.array_sort(_as_list(v)), True),
    "uniq": lambda v: Value(F.array_sort(F.array_distinct(_as_list(v))), True),
    "digest": _each(_digest),
    "substring": _each(_substring),
    "prepend": _each(lambda x, *a: F.concat(F.lit("".join(a)), x)),
    "append": _each(lambda x, *a: F.concat(x, F.lit("".join(a)))),
    "regexp": _each(lambda x, p: F.regexp_extract(x, re.sub(r"^/(.*)/(\w*)$", lambda m: (f"(?{m[2]})" if m[2] else "") + m[1], p), 0)),
    "id": lambda v, *a: Value(F.lit("".join(a))),
    "equal": lambda v, x: Value(F.when(v.column == x, v.column)),
    "in": _keep(lambda x, a: x.isin(a)),
    "not_in": _keep(lambda x, a: ~x.isin(a)),
    "inverse": lambda v: Value(F.when((v.column.isNull()) if not v.is_list else (F.size(v.column) == 0), F.lit("true"))),
    "to_ascii": _each(lambda x, c="?": F.regexp_replace(x, r"[^\x00-\x7F]", c)),
    "get_tld": _each(lambda x: T.registered_domain(T.parse_host(x))),
    "get_host": _each(T.parse_host),
    "join_nth": lambda v, n, sep="": Value(_every_nth(_as_list(v), int(n), sep), True),
    "filter_map": lambda v, *a: Value(F.filter(_as_list(v), lambda x: x.isin(list(a))), True),
    "except_map": lambda v, *a: Value(F.filter(_as_list(v), lambda x: ~x.isin(list(a))), True),
    "apply_map": lambda v, *a: Value(F.filter(F.transform(_as_list(v), lambda x: F.coalesce(*[F.when(x == e.split("=")[0], F.lit(e.split("=")[1])) for e in a])), lambda x: x.isNotNull()), True),
    "filter_string_nils": lambda v: Value(F.filter(_as_list(v), lambda x: x.isNotNull() & ~x.isin("nil", "")), True),
    "ipmask": _each(lambda x, bits, *six: _masked(x, int(bits))),
    "pack_numbers": lambda v: Value(F.array_join(F.transform(_as_list(v), lambda x: F.lower(F.lpad(F.hex(x.try_cast("long")), 8, "0"))), "")),
    "len": lambda v: Value((F.size(v.column) if v.is_list else F.length(v.column)).cast("string")),
}


def register_extractor(name: str, make: Callable[..., Value]) -> None:
    EXTRACTORS[name] = make


def register_transform(name: str, make: Callable[..., Value]) -> None:
    TRANSFORMS[name] = make


def compile_selector(text: str, extractors: dict[str, Callable[..., Value]] | None = None) -> list[Value]:
    """One Value per selector; text that does not parse raises SelectorError. ``extractors`` go before the common ones."""
    known = EXTRACTORS | (extractors or {})
    out = []
    for part in re.split(r""";(?=(?:[^'"]|'[^']*'|"[^"]*")*$)""", text):
        at, value = 0, None
        while at < len(part):
            m = _CALL.match(part, at)
            if not m:
                raise SelectorError(f"cannot parse {part[at:]!r}")
            table = known if value is None else TRANSFORMS
            if m[1] not in table:
                raise SelectorError(f"unknown {'extractor' if value is None else 'transform'} {m[1]!r}")
            value = table[m[1]](*_args(m[2])) if value is None else table[m[1]](value, *_args(m[2]))
            at = m.end()
            if at < len(part):
                if part[at] not in ".:":
                    raise SelectorError(f"unexpected {part[at:]!r}")
                at += 1
        if value is None:
            raise SelectorError("empty selector")
        out.append(value)
    return out


def combine(text: str, delimiter: str = "", extractors: dict[str, Callable[..., Value]] | None = None) -> Column:
    """All selectors as one text; if any is a list they are zipped element by element."""
    values = compile_selector(text, extractors)
    if not any(v.is_list for v in values):
        return F.concat_ws(delimiter, *[v.column for v in values])
    longest = F.greatest(*[F.size(_as_list(v)) for v in values]) if len(values) > 1 else F.size(_as_list(values[0]))
    columns = [v.column if v.is_list else F.array_repeat(v.column, longest) for v in values]
    zipped = F.arrays_zip(*[c.alias(f"v{k}") for k, c in enumerate(columns)])
    return F.transform(zipped, lambda x: F.concat_ws(delimiter, *[x[f"v{k}"] for k in range(len(columns))]))
