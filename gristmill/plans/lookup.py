"""Queries that look values up in maps, listings, aliases and settings, and write results as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import headers
from gristmill.functions import text as T
from gristmill.operators import lookups, scoring
from gristmill.plans import catalog
from gristmill.plans.registry import documents, query, read
from gristmill.sources import sinks

_EMAILS = r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+"


@query(rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAILS}')) AS x FROM documents), d AS (SELECT doc_id, string_split(x, '@')[1] AS user, lower(string_split(x, '@')[2]) AS domain FROM a)
  SELECT doc_id, user, domain, array_to_string(string_split(domain, '.')[-2:], '.') AS org, count(*) AS n FROM d GROUP BY ALL""")
def email_addresses(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAILS), F.lit(0))).alias("x")).select("doc_id", headers.address(F.col("x")).alias("a"))
    return rows.groupBy("doc_id", "a.user", "a.domain", "a.org").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '') AS protocol, try_cast(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1), '') AS INT) AS port,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment,
  len(regexp_extract_all(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '[^&]+'))::INT AS n_params FROM pages""")
def url_components(spark, sf_dir):
    made = headers.url_components(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", *[made[n].alias(n) for n in ("protocol", "port", "path", "query", "fragment", "n_params")])


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events""")
def mail_dates(spark, sf_dir):
    """Times written as mail dates and parsed again."""
    written = F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss xx")
    return read(spark, sf_dir, "events").select("event_id", F.unix_seconds(headers.smtp_date(written)).alias("seconds"))


#: A map of domains: other symbols and multipliers are in its values.
_DOMAINS = [("example.com", "2"), ("example.org", "GOOD_HOST:-1"), ("example.net", None), ("never.test", "3")]
_DOMAIN_SQL = "u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages), d AS (SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM u)"


@query(f"""WITH {_DOMAIN_SQL} SELECT page_id, symbol, score, domain AS key FROM d JOIN (VALUES ('example.com', 'HOST_MAP', 1.0::DOUBLE), ('example.org', 'GOOD_HOST', -0.5), ('example.net', 'HOST_MAP', 0.5)) m(domain, symbol, score) USING (domain)""")
def map_rule_findings(spark, sf_dir):
    entries = spark.createDataFrame(_DOMAINS, "key string, value string")
    return lookups.map_rule(read(spark, sf_dir, "pages"), "page_id", F.array(T.registered_domain(T.parse_host("url"))), entries, "HOST_MAP", 0.5)


@query(f"""WITH {_DOMAIN_SQL} SELECT key, count(page_id) AS hits FROM (VALUES ('example.com'), ('example.org'), ('example.net'), ('never.test')) m(key) LEFT JOIN d ON domain = key GROUP BY key""")
def map_entry_hits(spark, sf_dir):
    keys = read(spark, sf_dir, "pages").select(T.registered_domain(T.parse_host("url")).alias("key"))
    return lookups.map_statistics(keys, spark.createDataFrame(_DOMAINS, "key string, value string"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)),
  b AS (SELECT s_suppkey, (s_suppkey % 4)::INT AS bits FROM supplier WHERE s_acctbal < 2000), m AS (SELECT l_orderkey, bits FROM k JOIN b ON l_suppkey = s_suppkey)
  SELECT l_orderkey, 'LISTED_ODD' AS symbol, count(*) AS n FROM m WHERE bits & 1 <> 0 GROUP BY 1 UNION ALL SELECT l_orderkey, 'LISTED_HIGH', count(*) FROM m WHERE bits & 2 <> 0 GROUP BY 1""")
def listed_suppliers(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier")
    listing = suppliers.filter("s_acctbal < 2000").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 4).cast("int").alias("bits"))
    trusted = suppliers.filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("key"))
    orders = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return lookups.listed(orders, "l_orderkey", F.array("l_suppkey"), listing, {1: "LISTED_ODD", 2: "LISTED_HIGH"}, trusted)


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS name, c_custkey // 3 AS target FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0),
  r AS (SELECT c_custkey, c_custkey AS cur, 0 AS d FROM customer UNION ALL SELECT c_custkey, target, d + 1 FROM r JOIN a ON cur = name WHERE d < 16)
  SELECT c_custkey, arg_max(cur, d) AS resolved FROM r GROUP BY c_custkey""")
def alias_ends(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    aliases = customers.filter("c_custkey % 3 = 0 and c_custkey > 0").select(F.col("c_custkey").alias("name"), F.expr("c_custkey div 3").alias("target"))
    return lookups.resolve_aliases(customers, "c_custkey", aliases, 16)


@query(f"""WITH {catalog._HITS_SQL}, s AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'trusted' WHEN lang = 'en' THEN 'english' END AS setting FROM documents)
  SELECT f.doc_id, setting, symbol, CASE WHEN setting = 'english' AND symbol = 'SHORT' THEN 0.25 * hits WHEN setting = 'english' AND symbol = 'HAS_URL' THEN 0.1 * hits ELSE score END AS score
  FROM f JOIN s USING (doc_id) WHERE NOT (setting IS NOT DISTINCT FROM 'trusted' AND symbol IN ('HAS_URL', 'HAS_EMAIL'))""")
def settings_findings(spark, sf_dir):
    settings = [
        lookups.Setting("english", 1, F.col("lang") == "en", {"SHORT": 0.25, "HAS_URL": 0.1}),
        lookups.Setting("trusted", 5, F.col("source") == "src3", disabled=("HAS_URL", "HAS_EMAIL")),
    ]
    rows = lookups.apply_settings(scoring.findings(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), catalog._rules()), settings)
    return scoring.each(rows.select("doc_id", "setting", "findings")).select("doc_id", "setting", "f.symbol", "f.score")


@query(f"""{catalog._SCORE_SQL} SELECT 'actions_total{{action="' || action || '"}} ' || count(*) AS value FROM a GROUP BY action""")
def action_metrics(spark, sf_dir):
    counts = catalog.scored_documents(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))
    return sinks.exposition_lines(counts, "actions_total", "action", "n")
