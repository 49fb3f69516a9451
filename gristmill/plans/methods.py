"""Queries of the methods on texts, links and HTML elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import html as H
from gristmill.functions import strings as S
from gristmill.plans.registry import documents, query, read
from gristmill.plans.web import _LINKS_SQL

_T = "coalesce(text, '')"


@query(rf"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents)
  SELECT doc_id, md5(substr(t, 5, 20)) AS span_md5, md5(substr(t, greatest(length(t) - 19, 1))) AS tail_md5, len(regexp_split_to_array(t, '\r\n|\n|\r'))::INT AS n_lines, md5(regexp_split_to_array(t, '\r\n|\n|\r')[1]) AS line_md5,
    len(list_filter(regexp_split_to_array(t, '[,.;]'), lambda x: x <> ''))::INT AS n_parts, CASE WHEN t <> '' THEN unicode(t) END::INT AS first_code, CASE WHEN instr(t, 'e') > 0 THEN instr(t, 'e') ELSE -1 END::INT AS pos_e, strlen(t)::INT AS n_bytes,
    md5(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower_md5, md5(translate(t, 'aeiou', '')) AS without_md5, coalesce(least(CASE WHEN instr(t, '.') > 0 THEN instr(t, '.') - 1 END, CASE WHEN instr(t, ',') > 0 THEN instr(t, ',') - 1 END), length(t))::INT AS before_mark,
    TRY_CAST(nullif(regexp_extract(t, '([0-9]{{1,18}})', 1), '') AS BIGINT) AS number, CASE WHEN regexp_matches(t, '[A-Z]{{3,}}') THEN length(regexp_split_to_array(t, '[A-Z]{{3,}}')[1]) + 1 END::INT AS found_start FROM d""")
def text_methods(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    made = {
        "span_md5": F.md5(S.span(t, 5, 20).cast("binary")), "tail_md5": F.md5(S.sub(t, -20).cast("binary")), "n_lines": F.size(S.lines(t)), "line_md5": F.md5(S.lines(t)[0].cast("binary")), "n_parts": F.size(S.split(t, "[,.;]")), "first_code": S.code_at(t, 1), "pos_e": S.position(t, "e"), "n_bytes": F.octet_length(t),
        "lower_md5": F.md5(S.lower_ascii(t).cast("binary")), "without_md5": F.md5(S.exclude(t, "aeiou").cast("binary")), "before_mark": S.span_without(t, ".,"), "number": S.number(F.regexp_extract(t, "([0-9]{1,18})", 1)), "found_start": S.found(t, "[A-Z]{3,}")["start"],
    }
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in made.items()])


_HOST = "lower(regexp_extract(href, '^[a-zA-Z]+://([^/?#@]*@)?([^/?#:]+)', 2))"
_SHOWN_HOST = "lower(regexp_extract(shown, '(https?://|www[.])([^/?# ]+)', 2))"
#: Flags of a link, in this order.
FLAGS = {"numeric": f"{_HOST} <> '' AND {_HOST} = translate({_HOST}, 'abcdefghijklmnopqrstuvwxyz-', '')", "obscured": "href LIKE '%://%@%'", "port": "regexp_extract(href, '^[a-zA-Z]+://[^/?#]*:([0-9]+)', 1) <> ''", "query": "href LIKE '%?%'", "fragment": "href LIKE '%#%'", "punycode": f"{_HOST} LIKE '%xn--%'", "redirected": "href LIKE '%?%http%'", "displayed": "shown <> ''", "phished": f"{_SHOWN_HOST} <> '' AND {_SHOWN_HOST} <> {_HOST}"}
_FLAG_SUM = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(FLAGS.values()))
_URL_FIELDS = {"host": _HOST, "user": "regexp_extract(href, '^[a-zA-Z]+://([^/?#@:]*)(:[^/?#@]*)?@', 1)", "fragment": "regexp_extract(href, '#(.*)$', 1)", "embedded": "regexp_extract(href, '[?].*(https?://[^&]+)', 1)", "http": "CASE WHEN href LIKE 'https://%' THEN 'http://' || substr(href, 9) ELSE href END", "hash": "md5(href)", "flags": _FLAG_SUM}


@query(f"""WITH {_LINKS_SQL}, c AS (SELECT page_id, href, shown, pos, count(*) OVER (PARTITION BY page_id, href) AS times, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS nth FROM l)
  SELECT page_id, pos AS ord, href AS url, shown AS text, length(href)::INT AS n_chars, times, {", ".join(f"{e} AS {n}" for n, e in _URL_FIELDS.items())} FROM c WHERE nth = 1""")
def url_methods(spark, sf_dir):
    """Every distinct link of a page with its fields, flags, first place and number of uses."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "l")).select("page_id", (F.col("pos") + 1).alias("ord"), "l.href", "l.shown")
    same = rows.groupBy("page_id", "href").agg(F.count("*").alias("times"), F.min(F.struct("ord", "shown")).alias("first"))
    return same.select("page_id", "first.ord", "href", "first.shown", "times").select("page_id", "ord", F.col("href").alias("url"), F.col("shown").alias("text"), F.length("href").alias("n_chars"), "times", *[F.expr(e).alias(n) for n, e in _URL_FIELDS.items()])


_TAG = "<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>([^<]*)"
_ATTRIBUTE = "([a-zA-Z-]+)="


def _value(name: str) -> str:
    return f"regexp_extract(attrs, '(^| ){name}=\"?([^\" ]*)', 2)"


@query(f"""WITH e AS (SELECT page_id, i::INT AS ord, lower(ts[i]) AS tag, trim(rtrim(attrs[i], '/'), ' ') AS attrs, trim(cs[i], ' ') AS content FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_TAG}', 1) AS ts, regexp_extract_all(html, '{_TAG}', 2) AS attrs, regexp_extract_all(html, '{_TAG}', 3) AS cs FROM pages)))
  SELECT page_id, ord, tag, md5(attrs) AS attrs_md5, len(regexp_extract_all(attrs, '{_ATTRIBUTE}', 1))::INT AS n_attrs, md5(content) AS content_md5, length(content)::INT AS n_content, {_value("href")} AS href, {_value("src")} AS src, {_value("class")} AS class, TRY_CAST(nullif({_value("width")}, '') AS INT) AS width, attrs LIKE '%style=%' AS styled FROM e""")
def html_elements(spark, sf_dir):
    """Every element's name, attributes and the text that follows it, in order."""
    parts = [F.regexp_extract_all("html", F.lit(_TAG), F.lit(k)).alias(n) for k, n in ((1, "tag"), (2, "attrs"), (3, "content"))]
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(*parts)).alias("pos", "e"))
    rows = rows.select("page_id", (F.col("pos") + 1).alias("ord"), F.lower("e.tag").alias("tag"), F.trim(F.rtrim("e.attrs", F.lit("/"))).alias("attrs"), F.trim("e.content").alias("content"))
    return rows.select(
        "page_id", "ord", "tag", F.md5(F.col("attrs").cast("binary")).alias("attrs_md5"), F.size(F.regexp_extract_all("attrs", F.lit(_ATTRIBUTE), F.lit(1))).alias("n_attrs"), F.md5(F.col("content").cast("binary")).alias("content_md5"), F.length("content").alias("n_content"),
        *[F.expr(_value(n)).alias(n) for n in ("href", "src", "class")], F.expr(_value("width")).try_cast("int").alias("width"), F.contains("attrs", F.lit("style=")).alias("styled"),
    )


_COUNTED = {"links": "tag = 'a'", "images": "tag = 'img'", "forms": "tag = 'form'", "headings": "tag LIKE 'h_' AND tag <> 'hr'", "scripts": "tag = 'script'"}


@query(f"""WITH e AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '{_TAG}', 1))) AS tag FROM pages) SELECT page_id, count(*) AS tags, count(DISTINCT tag) AS kinds, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTED.items())} FROM e GROUP BY 1""")
def html_features(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(H.tags(F.col("html"))).alias("tag"))
    return rows.groupBy("page_id").agg(F.count("*").alias("tags"), F.count_distinct("tag").alias("kinds"), *[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTED.items()])
