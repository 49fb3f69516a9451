"""Queries of the further message checks and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import selectors
from gristmill.operators import mailmodules, mailrules
from gristmill.plans.mail import M_SQL, messages
from gristmill.plans.registry import query

#: Given verdicts, made by id like the messages.
_VERDICTS = ["doc_id % 3 = 0 AS spf_ok", "doc_id % 2 = 0 AS dkim_ok", "lower(regexp_extract(coalesce(env_from, ''), '@([^@]*)$', 1)) AS spf_domain", "CASE WHEN doc_id % 5 = 0 THEN 'mail.' ELSE '' END || lower(regexp_extract(coalesce(from_addr, ''), '@([^@]*)$', 1)) AS dkim_domain", "doc_id * 7 % 100 AS share"]
_V_SQL = f"v AS (SELECT *, {', '.join(_VERDICTS)} FROM m)"


def _judged(spark, sf_dir):
    return messages(spark, sf_dir).selectExpr("*", *_VERDICTS)


@query(f"WITH {M_SQL} {mailrules.findings_sql('m', 'doc_id', mailmodules.RULES)}")
def message_module_findings(spark, sf_dir):
    return mailrules.findings(messages(spark, sf_dir), "doc_id", mailmodules.RULES)


LISTS = [("src1.example.com", "both", "spf", 1.0), ("src2.example.org", "wl", "dkim", 2.0), ("src3.example.net", "bl", "both", 3.0), ("gmail.com", "both", "both", 0.5), ("src4.example.com", "both", "dkim", 1.5)]


@query(f"""WITH {M_SQL}, {_V_SQL}, l(domain, kind, checks, score) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in LISTS)}),
  j AS (SELECT doc_id, kind, checks, score, CASE checks WHEN 'spf' THEN spf_ok WHEN 'dkim' THEN dkim_ok ELSE spf_ok AND dkim_ok END AS good FROM v JOIN l ON lower(regexp_extract(from_addr, '@([^@]*)$', 1)) = domain)
  SELECT doc_id, CASE WHEN good THEN 'WHITELIST_' ELSE 'BLACKLIST_' END || upper(checks) AS symbol, CASE WHEN good THEN -score ELSE score END AS score FROM j WHERE (good AND kind IN ('wl', 'both')) OR (NOT good AND kind IN ('bl', 'both'))""")
def whitelist_findings(spark, sf_dir):
    return mailmodules.listed_senders(_judged(spark, sf_dir), "doc_id", spark.createDataFrame(LISTS, "domain string, kind string, checks string, score double"))


POLICIES = [("src1.example.com", "reject", True, 100), ("src2.example.org", "quarantine", False, 50), ("src5.example.net", "none", False, 100), ("src6.example.com", "reject", False, 30), ("gmail.com", "quarantine", True, 80)]


@query(f"""WITH {M_SQL}, {_V_SQL}, p(domain, policy, strict, pct) AS (VALUES {", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in POLICIES)}),
  j AS (SELECT doc_id, domain, policy, pct, share, (spf_ok AND (spf_domain = domain OR (NOT strict AND ends_with(spf_domain, '.' || domain)))) OR (dkim_ok AND (dkim_domain = domain OR (NOT strict AND ends_with(dkim_domain, '.' || domain)))) AS ok FROM v JOIN p ON lower(regexp_extract(from_addr, '@([^@]*)$', 1)) = domain)
  SELECT doc_id, domain, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS result, CASE WHEN ok THEN 'none' WHEN share < pct THEN policy WHEN policy = 'reject' THEN 'quarantine' ELSE 'none' END AS disposition FROM j""")
def policy_dispositions(spark, sf_dir):
    return mailmodules.aligned_policy(_judged(spark, sf_dir), "doc_id", spark.createDataFrame(POLICIES, "domain string, policy string, strict boolean, pct int"))


@query(f"""WITH {M_SQL}, {_V_SQL}, p(domain, policy, strict, pct) AS (VALUES {", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in POLICIES)}),
  j AS (SELECT domain, pct, share, policy, (spf_ok AND (spf_domain = domain OR (NOT strict AND ends_with(spf_domain, '.' || domain)))) OR (dkim_ok AND (dkim_domain = domain OR (NOT strict AND ends_with(dkim_domain, '.' || domain)))) AS ok FROM v JOIN p ON lower(regexp_extract(from_addr, '@([^@]*)$', 1)) = domain)
  SELECT domain, count(*) AS n, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok AND CASE WHEN share < pct THEN policy WHEN policy = 'reject' THEN 'quarantine' ELSE 'none' END = 'reject') AS rejected FROM j GROUP BY 1""")
def policy_report(spark, sf_dir):
    """Per domain, what a report to its owner says."""
    out = mailmodules.aligned_policy(_judged(spark, sf_dir), "doc_id", spark.createDataFrame(POLICIES, "domain string, policy string, strict boolean, pct int"))
    return out.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "pass").alias("passed"), F.count_if(F.col("disposition") == "reject").alias("rejected"))


FORCES = [mailmodules.Force("reject", ("EXE_IN_ARCHIVE", "MISSING_DATE")), mailmodules.Force("no action", ("HAS_ATTACHMENT",), ("EXE_IN_ARCHIVE",)), mailmodules.Force("add header", ("FROM_NAME_HAS_TITLE", "HAS_REPLYTO"))]
_FORCED = " ".join(
    "WHEN " + " AND ".join([f"list_contains(symbols, '{s}')" for s in f.every] + [f"NOT list_contains(symbols, '{s}')" for s in f.none]) + f" THEN '{f.action}'" for f in FORCES
)


@query(f"""WITH {M_SQL}, f AS ({mailrules.findings_sql("m", "doc_id")}), s AS (SELECT doc_id, round(sum(score), 4) AS score, list(symbol) AS symbols FROM f GROUP BY 1)
  SELECT doc_id, score, CASE {_FORCED} WHEN score >= 15 THEN 'reject' WHEN score >= 6 THEN 'add header' WHEN score >= 4 THEN 'greylist' ELSE 'no action' END AS action FROM s""")
def forced_actions(spark, sf_dir):
    return mailmodules.forced_actions(mailrules.findings(messages(spark, sf_dir), "doc_id"), "doc_id", FORCES)


#: Selectors of transforms and the SQL of their values.
TRANSFORMED = {
    "id('10.20.30.40'):ipmask('16')": "'10.20.0.0'", "ip:ipmask('24')": "regexp_extract(ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1) || '.0'", "list('a', 'b', 'c', 'd', 'e'):join_nth('2', '-'):join('|')": "'a-b|c-d|e'", "list('a', 'b', 'c'):filter_map('a', 'c'):join('|')": "'a|c'", "list('a', 'b', 'c'):except_map('a', 'c'):join('|')": "'b'", "list('a', 'b'):apply_map('a=1', 'c=3'):join('|')": "'1'",
    "list('1', 'nil', '', '2'):filter_string_nils:join('|')": "'1|2'", "list('1', '255'):pack_numbers": "'00000001000000ff'", "country:apply_map('DE=Berlin', 'FR=Paris'):first": "CASE country WHEN 'DE' THEN 'Berlin' WHEN 'FR' THEN 'Paris' ELSE '' END", "from('mime'):regexp('/^[a-z]+/i'):lower": "lower(regexp_extract(coalesce(from_addr, ''), '(?i)^[a-z]+', 0))",
}


@query(f"WITH {M_SQL} " + " UNION ALL ".join("SELECT doc_id, '" + k.replace("'", "''") + f"' AS selector, {v} AS value FROM m" for k, v in TRANSFORMED.items()))
def selector_transforms(spark, sf_dir):
    from gristmill.operators import mailkeys

    values = [F.struct(F.lit(s).alias("selector"), F.coalesce(selectors.combine(s, "", mailkeys.EXTRACTORS), F.lit("")).alias("value")) for s in TRANSFORMED]
    return messages(spark, sf_dir).select("doc_id", F.explode(F.array(*values)).alias("v")).select("doc_id", "v.selector", "v.value")
