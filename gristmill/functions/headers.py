"""Column functions over message headers and addresses. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text as T


def address(value: Column) -> Column:
    """Struct of name, user, domain, org of ``Name <user@domain>`` or ``user@domain``; null parts where there is none."""
    bare = F.trim(F.coalesce(F.nullif(F.regexp_extract(value, r"<([^<>]*)>\s*$", 1), F.lit("")), value))
    good = bare.rlike(r"^[^@\s<>]+@[^@\s<>]+$")
    domain = F.lower(F.substring_index(bare, "@", -1))
    name = F.trim(F.regexp_replace(F.regexp_extract(value, r"^(.*?)<[^<>]*>\s*$", 1), r'^\s*"|"\s*$', ""))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.when(good, F.substring_index(bare, "@", 1)).alias("user"), F.when(good, domain).alias("domain"), F.when(good, T.registered_domain(domain)).alias("org"))


def content_type(value: Column) -> Column:
    """Struct of type, subtype and a map of parameters; keys are lower-cased and values unquoted."""
    head = F.lower(F.trim(F.substring_index(value, ";", 1)))
    found = F.regexp_extract_all(value, F.lit(r""";\s*([^=;\s]+)\s*=\s*("[^"]*"|[^;\s]*)"""), F.lit(0))
    pairs = F.transform(found, lambda p: F.struct(F.lower(F.regexp_extract(p, r";\s*([^=;\s]+)", 1)).alias("k"), F.regexp_replace(F.regexp_extract(p, r"=\s*(.*)$", 1), '^"|"$', "").alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.struct(F.nullif(F.substring_index(head, "/", 1), F.lit("")).alias("type"), F.when(head.contains("/"), F.substring_index(head, "/", -1)).alias("subtype"), F.map_from_entries(first).alias("params"))


def received(value: Column) -> Column:
    """Struct of from_host, from_ip, by_host, protocol and time of a Received header; null parts where there is none."""

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))

    return F.struct(
        F.lower(part(r"(?is)^\s*from\s+([^\s;()]+)")).alias("from_host"),
        part(r"\[(?:IPv6:)?([0-9A-Fa-f.:]+)\]").alias("from_ip"),
        F.lower(part(r"(?is)\bby\s+([^\s;()]+)")).alias("by_host"),
        F.lower(part(r"(?is)\bwith\s+([A-Za-z]+)")).alias("protocol"),
        smtp_date(part(r"(?s);\s*([^;]*)$")).alias("time"),
    )


def smtp_date(value: Column) -> Column:
    """Timestamp of ``Mon, 02 Jan 2006 15:04:05 +0000``; weekday, seconds and comments may be missing; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)", ""), r"^\s*[A-Za-z]{3},\s*", ""))
    zoned = F.regexp_replace(F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000"), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm xx")))


def humanize(number: Column) -> Column:
    """``1.50K``: a number with two decimals and a power of 1000; below 1000 as it is."""
    out = F.format_string("%d", number.cast("long"))
    for power, unit in enumerate("KMGT", 1):
        out = F.when(F.abs(number) >= 1000**power, F.concat(F.format_string("%.2f", number / float(1000**power)), F.lit(unit))).otherwise(out)
    return out


def url_components(url: Column) -> dict[str, Column]:
    """protocol, user, port, path, query, fragment (null where absent), parameters and embedded URLs in the query."""

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))

    query = part(r"^[^?#]*\?([^#]*)")
    plain = F.coalesce(F.try_url_decode(query), query, F.lit(""))
    return {
        "protocol": F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://")),
        "user": part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*)@"),
        "port": part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)").try_cast("int"),
        "path": part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"),
        "query": query,
        "fragment": part(r"#(.*)$"),
        "n_params": F.when(query.isNull(), 0).otherwise(F.regexp_count(query, F.lit("[^&]+"))),
        "n_embedded": F.regexp_count(plain, F.lit(r"https?://[A-Za-z0-9.-]+")),
    }
