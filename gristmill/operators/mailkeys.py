"""Keys of lookup rules over messages, matching classes, tests on parts, and selectors' sources.

A lookup rule names a *type*, where its keys come from, and a *filter*, what is
made of each. Both are SQL text over the columns of ``mailrules.COLUMNS``, so a
rule compiles into Catalyst expressions; only the lookup itself is a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.selectors import Value
from gristmill.operators import maps
from gristmill.operators.mailrules import Dialect, MailRule

#: Where keys come from; types in ``LISTS`` give any number of them.
TYPES = {
    "ip": "ip", "from": "coalesce(nullif(env_from, ''), from_addr)", "helo": "helo", "header": "subject", "rcpt": "to_addr", "user": "user", "filename": "file", "content": "plain", "hostname": "hostname", "asn": "asn", "country": "country",
    "received": "CASE WHEN n_received > 0 THEN ip END", "mempool": "queue_id", "selector": "lower(from_name)", "symbol_options": "CASE WHEN subject LIKE '%!%' THEN 'exclaim' WHEN subject LIKE '%?%' THEN 'question' END", "headers": "raw", "name": "from_name",
}
LISTS = {"url": "regexp_extract_all(html, 'href=\"([^\">]*)', 1)", "email": "regexp_extract_all(from_, '[A-Za-z0-9._+=-]+@[A-Za-z0-9.-]+', 0)"}
_HOST = "lower(regexp_extract(x, '^[a-zA-Z]+://([^/?#]*@)?([^/?#:]+)', 2))"
_TLD = "regexp_extract({}, '([^.@]+[.][^.]+)$', 1)"
#: What is made of a key x; an empty or null result is no key.
FILTERS = {
    "": "x", "host": _HOST, "tld": _TLD.format(_HOST), "top": f"regexp_extract({_HOST}, '([^.]+)$', 1)", "hostname:tld": _TLD.format("x"), "hostname:top": "regexp_extract(x, '([^.]+)$', 1)", "full": "x",
    "path": "regexp_extract(x, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)", "query": "regexp_extract(x, '[?]([^#]*)', 1)", "is_obscured": f"CASE WHEN x LIKE '%@%' THEN {_HOST} END", "is_numeric": f"CASE WHEN {_HOST} LIKE '%.%.%.%' AND {_HOST} = translate({_HOST}, 'abcdefghijklmnopqrstuvwxyz', '') THEN {_HOST} END",
    "template": f"{_HOST} || regexp_extract(x, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)", "email": "lower(x)", "email:user": "regexp_extract(x, '^([^@]*)@', 1)", "email:domain": "lower(regexp_extract(x, '@([^@]*)$', 1))", "email:domain:tld": "lower(" + _TLD.format("x") + ")",
    "ip_addr": "regexp_extract(x, '([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)', 1)", "extension": "lower(regexp_extract(x, '[.]([^.]+)$', 1))", "regexp": "regexp_extract(x, '([0-9]+)', 1)", "digest": "md5(x)", "oneline": "md5(replace(replace(x, chr(13), ' '), chr(10), ' '))",
}
#: Pairs that make sense, as a rule would name them.
PAIRS = (
    [(t, "") for t in TYPES if t not in ("content", "headers")] + [("url", f) for f in ("host", "tld", "top", "full", "path", "query", "is_obscured", "is_numeric", "template", "regexp")] + [("hostname", f) for f in ("hostname:tld", "hostname:top")]
    + [(t, f) for t in ("from", "rcpt", "email") for f in ("email", "email:user", "email:domain", "email:domain:tld")] + [("received", "ip_addr"), ("filename", "extension"), ("header", "regexp"), ("content", "digest"), ("content", "oneline"), ("headers", "digest")]
)


def keys(messages: DataFrame, id_col: str, pairs: list[tuple[str, str]] = PAIRS) -> DataFrame:
    """(id_col, type, filter, key) of all pairs, in one pass over the messages."""

    def made(kind: str, name: str):
        source = F.expr(LISTS[kind]) if kind in LISTS else F.array(F.expr(TYPES[kind]))
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("filter"), F.transform(source, lambda x: F.struct(x.alias("x"))).alias("xs"))

    rows = messages.select(id_col, F.explode(F.array(*[made(*p) for p in pairs])).alias("p")).select(id_col, "p.type", "p.filter", F.explode("p.xs").alias("e")).select(id_col, "type", "filter", F.col("e.x").alias("x"))
    key = F.coalesce(*[F.when(F.col("filter") == n, F.expr(f)) for n, f in FILTERS.items()])
    return rows.select(id_col, "type", "filter", key.alias("key")).filter("key <> ''")


def keys_sql(messages: str, id_col: str, pairs: list[tuple[str, str]] = PAIRS) -> str:
    each = [f"SELECT {id_col}, '{t}' AS type, '{f}' AS filter, {FILTERS[f]} AS key FROM (SELECT {id_col}, {f'unnest({LISTS[t]})' if t in LISTS else TYPES[t]} AS x FROM {messages})" for t, f in pairs]
    return f"SELECT * FROM ({' UNION ALL '.join(each)}) WHERE key <> ''"


def findings(messages: DataFrame, id_col: str, entries: DataFrame) -> DataFrame:
    """(id_col, symbol, score, options) of all lookups; ``entries`` has type, filter, key and value in the grammar of maps.

    One join for all maps; their entries are broadcast after a count, else shuffled.
    """
    met = keys(messages, id_col).withColumn("key", F.lower("key")).join(maps.small(entries.withColumn("key", F.lower("key"))), ["type", "filter", "key"])
    parsed = maps.parse_value(F.col("value"))
    return met.select(id_col, "type", "filter", F.coalesce(parsed["symbol"], F.upper(F.concat("type", F.lit("_MAP")))).alias("symbol"), parsed["score"].alias("score"), F.array_join(parsed["options"], ",").alias("options"))


def _text(column: str) -> str:
    return f"coalesce({column}, '')"


#: The text that each class of patterns is matched against.
CLASSES = {
    "header": "from_", "rawheader": "regexp_extract(raw, '(^|[^A-Za-z-])From:([^<]*)', 2)", "allheader": "raw", "mimeheader": "ctype", "mime": "plain", "rawmime": _text("plain") + " || " + _text("html"), "url": "array_to_string(regexp_extract_all(html, 'href=\"([^\">]*)', 1), ' ')",
    "email": "regexp_extract(from_, '[A-Za-z0-9._+=-]+@[A-Za-z0-9.-]+', 0)", "body": "raw || chr(10) || " + _text("plain") + " || " + _text("html"), "sabody": _text("subject") + " || chr(10) || " + _text("plain"), "sarawbody": _text("plain"),
    "words": "array_to_string(regexp_extract_all(lower(plain), '[a-z0-9]+', 0), ' ')", "rawwords": "array_to_string(regexp_extract_all(plain, '[A-Za-z0-9]+', 0), ' ')", "stemwords": "array_to_string(regexp_extract_all(lower(plain), '[a-z0-9]+?(ing|ed|es|s)?[^a-z0-9]', 0), ' ')", "selector": "lower(from_name)",
}


#: Classes whose text is one header, by its name: folded case and no leading space, or as it stands.
NAMED = {"header": "(?im)^{}:[ ]*(.*)", "mimeheader": "(?im)^{}:[ ]*(.*)", "rawheader": "(?m)^{}:(.*)"}


def class_text(kind: str, of: str | None = None) -> str:
    """SQL of the text of a class; ``of`` names the header that a header class reads."""
    return f"regexp_extract(raw, '{NAMED[kind].format(of)}', 1)" if of else CLASSES[kind]


def class_rule(symbol: str, kind: str, pattern: str, score: float = 1.0, of: str | None = None) -> MailRule:
    """A rule that matches ``pattern`` against the texts of a class, of the header named ``of`` if given."""
    text = class_text(kind, of)
    return MailRule(symbol, score, lambda d: d.m(text if d.arrays else text.replace("array_to_string", "array_join"), pattern))


def _both(*tests: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    return lambda d: " AND ".join(t(d) for t in tests)


#: How tags begin and end that must be closed.
_TAGS = [("<html>", "</html>"), ("<body>", "</body>"), ("<p>", "</p>"), ("<span ", "</span>"), ("<a ", "</a>")]
#: Tests on messages, by name; each gives the predicate for its arguments.
TESTS: dict[str, Callable[..., Callable[[Dialect], str]]] = {
    "header_exists": lambda name: lambda d: d.h(name),
    "raw_header_exists": lambda name: lambda d: d.m("raw", f"(?m)^{name}:"),
    "check_smtp_data": lambda field, pattern: lambda d: d.m({"from": "env_from", "rcpt": "to_addr", "helo": "helo", "user": "user"}[field], pattern),
    "compare_encoding": lambda name: lambda d: d.m("ctype", f"(?i)charset=[^;]*{name}"),
    "compare_transfer_encoding": lambda name: lambda d: f"coalesce(lower(encoding) = '{name}', false)",
    "content_type_is_type": lambda t: lambda d: d.m("ctype", f"(?i)^{t}(/|;|$)"),
    "content_type_is_subtype": lambda t: lambda d: d.m("ctype", f"(?i)^[^/;]*/{t}(;|$)"),
    "content_type_has_param": lambda p: lambda d: d.m("ctype", f"(?i); *{p}="),
    "content_type_compare_param": lambda p, pattern: lambda d: d.m("ctype", f"(?i); *{p}=[^;]*{pattern}"),
    "has_content_part": lambda t: lambda d: {"text/plain": "plain IS NOT NULL", "text/html": "html IS NOT NULL"}.get(t, "file IS NOT NULL"),
    "has_content_part_len": lambda t, lo, hi: lambda d: f"coalesce(length({'plain' if t == 'text/plain' else 'html'}) BETWEEN {lo} AND {hi}, false)",
    "has_only_html_part": lambda: lambda d: "html IS NOT NULL AND plain IS NULL AND file IS NULL",
    "has_html_tag": lambda tag: lambda d: d.m("html", f"(?i)<{tag}[ >]"),
    "has_fake_html": lambda: lambda d: f"html IS NOT NULL AND NOT {d.m('html', '(?i)<(html|body)[ >]')}",
    "is_html_balanced": lambda: lambda d: "coalesce(" + " AND ".join(f"(length(html) - length(replace(html, '{a}', ''))) * {len(z)} = (length(html) - length(replace(html, '{z}', ''))) * {len(a)}" for a, z in _TAGS) + ", false)",
    "is_empty_body": lambda: lambda d: "coalesce(plain, '') = '' AND html IS NULL",
    "is_recipients_sorted": lambda: lambda d: "n_to >= 7 AND n_to_named_addr = n_to",
    "compare_recipients_distance": lambda most: lambda d: f"coalesce(levenshtein(to_addr, from_addr) <= {most}, false)",
    "has_flag": lambda flag: lambda d: {"authenticated": "user IS NOT NULL", "greylisted": "coalesce(hours < 0, false)"}[flag],
}


def test_rule(symbol: str, name: str, *args: object) -> MailRule:
    return MailRule(symbol, 1.0, TESTS[name](*args))


def _one(sql: str) -> Callable[..., Value]:
    return lambda *a: Value(F.expr(sql))


def _many(sql: str) -> Callable[..., Value]:
    return lambda *a: Value(F.expr(sql), True)


def _header(name: str, how: str = "") -> Value:
    return Value(F.regexp_extract("raw", rf"({'?m' if how == 'strong' else '?im'})^{name}:[ ]*([^\n]*)", 1))


#: Sources of the selector language over messages.
EXTRACTORS: dict[str, Callable[..., Value]] = {
    "ip": _one("ip"), "from": lambda kind="smtp": Value(F.expr("env_from" if kind == "smtp" else "from_addr")), "rcpts": _many("array(to_addr)"), "to": _one("to_addr"), "country": _one("country"), "asn": _one("asn"), "user": _one("user"), "helo": _one("helo"),
    "header": _header, "attachments": lambda *a: Value(F.expr("CASE WHEN file IS NOT NULL THEN array(md5(file)) ELSE array() END"), True), "files": _many("CASE WHEN file IS NOT NULL THEN array(file) ELSE array() END"), "languages": _many("CASE WHEN lang IS NOT NULL THEN array(lang) ELSE array() END"), "received_count": _one("CAST(n_received AS STRING)"), "received": lambda field="by": Value(F.expr("CASE WHEN n_received > 0 THEN ip END")),
    "urls": _many("coalesce(" + LISTS["url"] + ", array())"), "specific_urls": _many("array_distinct(coalesce(" + LISTS["url"] + ", array()))"), "urls_filtered": lambda keep="http": Value(F.filter(F.expr("coalesce(" + LISTS["url"] + ", array())"), lambda u: F.startswith(u, F.lit(keep))), True),
    "emails": _many("coalesce(" + LISTS["email"] + ", array())"), "pool_var": lambda name, kind="": Value(F.col(name).cast("string")), "request_header": _header, "time": lambda *a: Value(F.expr("CAST(hours AS STRING)")), "queueid": _one("queue_id"), "uid": _one("md5(queue_id)"), "messageid": _one("mid"),
    "digest": _one("md5(coalesce(plain, '') || coalesce(html, ''))"), "fuzzy_digest": _one("md5(coalesce(plain, ''))"), "authenticated": _one("CASE WHEN user IS NOT NULL THEN 'true' END"), "words": _many("regexp_extract_all(lower(coalesce(plain, '')), '[a-z0-9]+', 0)"),
}
