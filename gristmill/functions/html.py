"""Column functions over HTML: visible text, links, tags, hidden elements. All run inside the JVM.

Markup is read with regular expressions, in one pass a function and without a
tree; a null document has no text, no links and no tags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Named character references that are decoded.
ENTITIES = {"nbsp": " ", "middot": "·", "copy": "©", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&"}
#: Elements whose content is never shown, and comments.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>"
#: An opening tag whose inline style hides it.
HIDING = r"""(?i)<[a-z][a-z0-9]*\b[^>]*style\s*=\s*["'][^"']*(display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0(?![.0-9]*[1-9]))"""
LINK = r"""(?is)<a\b[^>]*?href\s*=\s*["']?([^"'\s>]*)[^>]*>(.*?)</a>"""


def decode_entities(text: Column) -> Column:
    """Named references decoded, ``&amp;`` last, so that nothing is decoded twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(f"&{e[0]};"), F.lit(e[1])), ENTITIES.items(), text)


def visible_text(html: Column) -> Column:
    """The text between the tags, references decoded, white space folded to single spaces."""
    shown = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(shown), r"[ \t\r\n]+", " "))


def title(html: Column) -> Column:
    return decode_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def tags(html: Column) -> Column:
    """Lower-cased names of opening tags in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def links(html: Column) -> Column:
    """Array of (href, shown): every anchor with its visible text."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("shown"))
    return F.transform(found, lambda a: F.struct(decode_entities(a["href"]).alias("href"), F.trim(decode_entities(F.regexp_replace(a["shown"], "<[^>]*>", ""))).alias("shown")))


def link_kind(href: Column) -> Column:
    """mailto, script, data, numeric (IPv4 host), punycode, absolute or relative."""
    host = T.parse_host(href)
    return (
        F.when(href.rlike("(?i)^mailto:"), "mailto").when(href.rlike("(?i)^javascript:"), "script").when(href.rlike("(?i)^data:"), "data")
        .when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "numeric").when(host.contains("xn--"), "punycode").when(host != "", "absolute").otherwise("relative")
    )


def is_phished(href: Column, shown: Column) -> Column:
    """The shown text names a domain, and the link goes to another registered domain."""
    claimed = F.lower(F.regexp_extract(shown, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,})(?:[/?#:].*)?$", 1))
    return (claimed != "") & ~claimed.contains("..") & (T.parse_host(href) != "") & (T.registered_domain(claimed) != T.registered_domain(T.parse_host(href)))


def hidden_elements(html: Column) -> Column:
    """How many opening tags hide themselves by inline style."""
    return T.hits(html, HIDING)
