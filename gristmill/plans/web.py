"""Queries over web pages and the links of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import html as H
from gristmill.functions import text as T
from gristmill.operators import fuzzy
from gristmill.plans.registry import documents, query, read


def _decoded(sql: str) -> str:
    """SQL that decodes named references, in the order of the fixed table."""
    for name, shown in H.ENTITIES.items():
        sql = f"replace({sql}, '&{name};', '{shown.replace(chr(39), chr(39) * 2)}')"
    return sql


_SHOWN_SQL = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<title\\b.*?</title>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_LINK_SQL = r"(?is)<a\b[^>]*?href\s*=\s*[\x22\x27]?([^\x22\x27\s>]*)[^>]*>(.*?)</a>"
_LINKS_SQL = f"""l AS (SELECT page_id, url, i::INT AS pos, {_decoded("hs[i]")} AS href, trim({_decoded("regexp_replace(ts[i], '<[^>]*>', '', 'g')")}, ' ') AS shown FROM (
  SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '{_LINK_SQL}', 1) AS hs, regexp_extract_all(html, '{_LINK_SQL}', 2) AS ts FROM pages)))"""


@query(f"""SELECT page_id, md5(t) AS text_md5, length(t)::INT AS n_chars, len(regexp_extract_all(t, '[A-Za-z0-9]+'))::INT AS n_words,
  {_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title
  FROM (SELECT page_id, html, trim(regexp_replace({_decoded(_SHOWN_SQL)}, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM pages)""")
def html_text(spark, sf_dir):
    shown = read(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("t"), H.title(F.col("html")).alias("title"))
    return shown.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").alias("n_chars"), T.hits("t", T.WORD).alias("n_words"), "title")


@query(f"WITH {_LINKS_SQL} SELECT page_id, pos, href, shown FROM l")
def html_links(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "l"))
    return rows.select("page_id", (F.col("pos") + 1).alias("pos"), "l.href", "l.shown")


@query(f"""WITH {_LINKS_SQL}, h AS (SELECT *, lower(regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM l),
  k AS (SELECT page_id, CASE WHEN lower(href) LIKE 'mailto:%' THEN 'mailto' WHEN lower(href) LIKE 'javascript:%' THEN 'script' WHEN lower(href) LIKE 'data:%' THEN 'data'
    WHEN regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}$') THEN 'numeric' WHEN contains(host, 'xn--') THEN 'punycode' WHEN host <> '' THEN 'absolute' ELSE 'relative' END AS kind,
    shown = '' AS empty, length(href) AS n FROM h)
  SELECT page_id, kind, count(*) AS n, count(*) FILTER (empty) AS n_empty, max(n)::INT AS longest FROM k GROUP BY 1, 2""")
def html_link_kinds(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("l"))
    return rows.groupBy("page_id", H.link_kind(F.col("l.href")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l.shown") == "").alias("n_empty"), F.max(F.length("l.href")).alias("longest"))


@query("""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1, 2""")
def html_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(H.tags(F.col("html"))).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(r"""WITH ww AS (SELECT page_id, list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS w FROM pages),
  win AS (SELECT DISTINCT page_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM ww)),
  hh AS (SELECT page_id, ('0x' || substr(md5(s), 1, 7))::BIGINT AS a, ('0x' || substr(md5(s), 9, 7))::BIGINT AS b FROM win)
  SELECT page_id, pos::INT AS pos, min((a + b * (pos + 1)) % 2147483647) AS value FROM hh, range(32) r(pos) GROUP BY 1, 2""")
def html_shingles(spark, sf_dir):
    return fuzzy.shingles(read(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", H.tags(F.col("html"))).alias("text")), "page_id")


_DOMAIN_SQL = rf"""{_LINKS_SQL}, u AS (SELECT page_id, lower(coalesce(nullif(regexp_extract(href, '^https?://([^/?#:]+)', 1), ''), regexp_extract(url, '^https?://([^/?#:]+)', 1))) AS host FROM l),
  d AS (SELECT page_id, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(*) AS n FROM u WHERE host <> '' GROUP BY 1, 2)"""


def _domains(spark, sf_dir):
    """Links by the domain they lead to; relative ones lead to the page's own."""
    own, named = (F.regexp_extract(c, "^https?://([^/?#:]+)", 1) for c in ("url", "l.href"))
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(H.links(F.col("html"))).alias("l"))
    hosts = rows.select("page_id", F.lower(F.when(named != "", named).otherwise(own)).alias("host")).filter("host != ''")
    return hosts.groupBy("page_id", T.registered_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"WITH {_DOMAIN_SQL} SELECT page_id, domain, n, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, domain) AS r FROM d) WHERE r <= 3")
def top_domains(spark, sf_dir):
    """The most linked domains of each page: a report of three."""
    order = Window.partitionBy("page_id").orderBy(F.col("n").desc(), "domain")
    return _domains(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter("r <= 3")


@query(f"WITH {_DOMAIN_SQL} SELECT page_id, count(*) AS domains_total, max(n) AS max_links_single_domain FROM d GROUP BY page_id")
def domain_counts(spark, sf_dir):
    return _domains(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("domains_total"), F.max("n").alias("max_links_single_domain"))
