"""Queries that look up patterns, addresses and hosts in tables of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import confusables, recipients
from gristmill.operators import links, networks, suffixes, trie
from gristmill.plans.registry import documents, query, read

_PATTERNS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS pattern FROM benchmark"


@query(f"WITH p AS ({_PATTERNS}) SELECT pattern, count(*) AS n_docs, sum(strpos(text, pattern) - 1)::BIGINT AS first_total FROM documents JOIN p ON contains(text, pattern) GROUP BY pattern")
def trie_patterns(spark, sf_dir):
    """Every word of the benchmark as a pattern: how many documents hold it anywhere, and where first."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("pattern"))
    return trie.occurrences(documents(spark, sf_dir), words, first_only=True).groupBy("pattern").agg(F.count("*").alias("n_docs"), F.sum("start").alias("first_total"))


#: Networks of the query: nested ones of both families, a single address, and two that cannot be read.
NETWORKS = [("2001:db8::/32", "whole"), ("2001:db8:8::/45", "upper half"), ("2001:db8:a::/48", "ten"), ("2001:db8:3::1f", "one"), ("10.0.0.0/8", "ten v4"), ("10.1.0.0/16", "one v4"), ("10.1.7.9/32", "host"), ("10.300.0.0/16", "bad"), ("2001:db8::/129", "bad")]
_V6 = "'2001:db8:' || lower({hex}(c_custkey % 16)) || '::' || lower({hex}(c_custkey % 4096))"
_V4 = "'10.' || (c_custkey % 3) || '.' || (c_custkey % 11) || '.' || (c_custkey % 13)"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {_V6.format(hex="to_hex")} ELSE {_V4} END AS address,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 16 = 10 THEN 'ten' WHEN c_custkey % 16 >= 8 THEN 'upper half' WHEN c_custkey % 16 = 3 AND c_custkey % 4096 = 31 THEN 'one' ELSE 'whole' END
    WHEN c_custkey % 3 = 1 AND c_custkey % 11 = 7 AND c_custkey % 13 = 9 THEN 'host' WHEN c_custkey % 3 = 1 THEN 'one v4' ELSE 'ten v4' END AS value FROM customer""")
def network_lookup(spark, sf_dir):
    """An address of either family for each customer, and the innermost network around it."""
    address = F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN {_V6.format(hex='hex')} ELSE {_V4} END")
    return networks.lookup(read(spark, sf_dir, "customer").select("c_custkey", address.alias("address")), "address", spark.createDataFrame(NETWORKS, "key string, value string"))


#: Rules of the query, as a suffix list has them.
SUFFIXES = ["com", "org", "net", "example.org", "*.example.com", "!blog.example.com", "// comment"]


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
  s AS (SELECT *, string_split(host, '.') AS l FROM h),
  n AS (SELECT *, CASE WHEN host = 'blog.example.com' OR host LIKE '%.blog.example.com' THEN 2 WHEN host LIKE '%.example.com' THEN 3 WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 2 ELSE 1 END AS k FROM s WHERE host <> '')
  SELECT h.page_id, h.host, array_to_string(l[-k:], '.') AS suffix, CASE WHEN len(l) > k THEN array_to_string(l[-k - 1:], '.') END AS domain FROM h LEFT JOIN n USING (page_id)""")
def registered_domains(spark, sf_dir):
    """The public suffix and registered domain of every page's host."""
    hosts = read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host"))
    return suffixes.registered(hosts, "host", spark.createDataFrame([(r,) for r in SUFFIXES], "rule string"))


_LINKS = "SELECT page_id // 40 AS id, page_id AS pos, url, regexp_extract(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '([^.]+[.][^.]+)$', 1) AS domain, page_id % 7 = 0 AS subject, page_id % 11 = 0 AS obscured, page_id % 5 = 0 AS image FROM pages"


@query(f"""WITH l AS ({_LINKS}), p AS (SELECT *, CASE WHEN obscured THEN 3 WHEN subject THEN 2 ELSE 1 END AS pr, row_number() OVER (PARTITION BY id, domain ORDER BY pos) AS nth FROM l WHERE domain <> '' AND NOT image),
  c AS (SELECT id, count(DISTINCT domain) AS nd FROM p GROUP BY id),
  q AS (SELECT p.*, nd, CASE WHEN nd <= 5 THEN domain ELSE substr(domain, instr(domain, '.') + 1) END AS k FROM p JOIN c USING (id) WHERE nd > 5 OR nth <= 4),
  r AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY pr DESC, pos DESC) AS rnd, count(*) OVER (PARTITION BY id, k) AS size, max(pr) OVER (PARTITION BY id, k) AS top, max(pr * 1000000000::BIGINT + pos) OVER (PARTITION BY id, k) % 1000000000 AS tpos FROM q),
  o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rnd, top DESC, size, tpos) AS n FROM r),
  b AS (SELECT o.*, (SELECT count(*) FROM r x WHERE x.id = o.id AND x.rnd < o.rnd) AS before FROM o),
  u AS (SELECT *, row_number() OVER (PARTITION BY id, url ORDER BY n) AS again FROM b WHERE CASE WHEN nd <= 5 THEN before < 5 ELSE n <= 5 END)
  SELECT id, pos, url, domain, (row_number() OVER (PARTITION BY id ORDER BY n))::INT AS place FROM u WHERE again = 1""")
def specific_links(spark, sf_dir):
    """Five links of every forty pages, spread over domains: a top-k report."""
    found = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 40).alias("id"), F.col("page_id").alias("pos"), "url", F.regexp_extract(F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)), r"([^.]+\.[^.]+)$", 1).alias("domain"), (F.col("page_id") % 7 == 0).alias("subject"), (F.col("page_id") % 11 == 0).alias("obscured"), (F.col("page_id") % 5 == 0).alias("image"))
    return links.diversified(found, 5, per_domain=4)


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}')[1:12], lambda x, i: x || '@' || CASE WHEN (i - 1) % 2 = 0 THEN 'a' ELSE 'bb' END || '.example') AS r FROM documents),
  s AS (SELECT doc_id, i, lower(r[i]) AS a, string_split(r[i], '@')[-1] AS dom, len(r) AS n FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM w)),
  l AS (SELECT *, lag(a) OVER (PARTITION BY doc_id ORDER BY length(dom), dom, i) AS p, lag(a) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM s),
  g AS (SELECT doc_id, max(n) AS n, count(*) FILTER (length(a) = length(p) AND substr(a, 1, 3) = substr(p, 1, 3)) / 2 AS likeness, count(*) FILTER (a <= q) AS down FROM l GROUP BY doc_id)
  SELECT doc_id, CASE WHEN coalesce(n, 0) >= 7 THEN likeness ELSE 0 END::DOUBLE AS likeness, coalesce(n >= 7 AND down = 0, false) AS in_order FROM w LEFT JOIN g USING (doc_id)""")
def recipient_tests(spark, sf_dir):
    """The tests on recipients, over addresses made of each document's first words."""
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0)), 1, 12)
    made = F.transform(words, lambda w, i: F.concat(w, F.lit("@"), F.when(i % 2 == 0, "a").otherwise("bb"), F.lit(".example")))
    return documents(spark, sf_dir).select("doc_id", recipients.likeness(made).alias("likeness"), recipients.in_order(made).alias("in_order"))


_HOST = "lower(regexp_extract(url, '://([^/?#:]+)', 1))"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages)
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN translate(host, 'oe', 'ое') WHEN 1 THEN replace(host, 'm', 'rn') WHEN 2 THEN translate(host, 'a', 'α') END AS shown, host AS looks_like FROM h
  WHERE host <> '' AND page_id % 4 < 3 AND CASE page_id % 4 WHEN 0 THEN host LIKE '%o%' OR host LIKE '%e%' WHEN 1 THEN host LIKE '%m%' ELSE host LIKE '%a%' END""")
def lookalike_hosts(spark, sf_dir):
    """Hosts of pages respelled with other scripts' letters, found again by what they look like."""
    hosts = read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)).alias("host"))
    kind = F.col("page_id") % 4
    shown = F.when(kind == 0, F.translate("host", "oe", "ое")).when(kind == 1, F.replace("host", F.lit("m"), F.lit("rn"))).when(kind == 2, F.translate("host", "a", "α")).otherwise(F.col("host"))
    return confusables.lookalikes(hosts.select("page_id", shown.alias("shown")), "shown", hosts)
