"""Queries of dependent rules and of rule files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import layers
from gristmill.plans.registry import documents, query
from gristmill.sources import rulefile

RULES = [
    layers.Dependent("FOREIGN", "LANG_fr | LANG_de | LANG_es"),
    layers.Dependent("FOREIGN_LONG", "FOREIGN & LONG & !DIGITS"),
    layers.Dependent("ODD", "FOREIGN_LONG | (SHORT & !LANG_en)"),
    layers.Dependent("BUSY", "LONG + DIGITS + LINK > 1"),
    layers.Dependent("PLAIN", "!(BUSY | ODD) & !LINK"),
]
#: Symbols of a document, as SQL that both engines read.
BASE = {"LONG": "length(text) > 2500", "SHORT": "length(text) < 300", "DIGITS": "{m}(text, '[0-9]{{3}}')", "LINK": "text LIKE '%://%'", "LANG_en": "lang = 'en'", "LANG_fr": "lang = 'fr'", "LANG_de": "lang = 'de'", "LANG_es": "lang = 'es'"}
_BASE_SQL = ", ".join(f"coalesce({c.format(m='regexp_matches')}, false) AS {s}" for s, c in BASE.items())


@query(f"""WITH b AS (SELECT doc_id, {_BASE_SQL} FROM documents),
  l1 AS (SELECT *, LANG_fr OR LANG_de OR LANG_es AS foreign_, LONG::INT + DIGITS::INT + LINK::INT > 1 AS busy FROM b), l2 AS (SELECT *, foreign_ AND LONG AND NOT DIGITS AS fl FROM l1), l3 AS (SELECT *, fl OR (SHORT AND NOT LANG_en) AS odd FROM l2)
  SELECT doc_id, 'FOREIGN' AS symbol, 1 AS layer FROM l3 WHERE foreign_ UNION ALL SELECT doc_id, 'BUSY', 1 FROM l3 WHERE busy UNION ALL SELECT doc_id, 'FOREIGN_LONG', 2 FROM l3 WHERE fl UNION ALL SELECT doc_id, 'ODD', 3 FROM l3 WHERE odd UNION ALL SELECT doc_id, 'PLAIN', 4 FROM l3 WHERE NOT (busy OR odd) AND NOT LINK""")
def layered_rules(spark, sf_dir):
    """Rules over a document's symbols in four layers."""
    docs = documents(spark, sf_dir)
    has = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c.format(m='regexp_like')} THEN '{s}' END") for s, c in BASE.items()]))
    found = docs.select("doc_id", F.explode(has).alias("symbol"))
    return layers.evaluate(docs.select("doc_id"), found, RULES, "doc_id")


#: A rule file in the usual form.
FILE = r"""
# sub-rules and rules
header __FROM_SRC   From:addr =~ /^(?:src|crawl)/i
header NO_DATE      Date !~ /\d/
header HAS_LIST     exists:List-Id
header UNSET        X-Spam =~ /^none$/ [if-unset: none]
body   __TOKEN      /\b(?:token|password)\s*=/i
body   SUBJECT_IS   /^Note \d+ /
rawbody TWO_LINES   /\n/
uri    __ORG        m{://[^/]*\.example\.org}
full   LATE_BCC     /^From: .*\n/
meta   LEAK         __TOKEN && (__FROM_SRC || HAS_LIST)
meta   LEAK_LINK    LEAK && __ORG
meta   MANY         LEAK + TWO_LINES + NO_DATE > 1
score  LEAK         2.5
score  LEAK_LINK    0 0 1.5 3.5
describe LEAK       a secret in a source's text
tflags NO_DATE      nice
"""
_RAW = "'From: X <' || coalesce(source, 'none') || '@a.example>\n' || CASE WHEN doc_id % 3 = 0 THEN 'List-Id: l\n' ELSE '' END || 'Subject: Note ' || doc_id || '\n' || CASE WHEN doc_id % 2 = 0 THEN 'Date: 1\n' ELSE '' END"


@query(r"""WITH f AS (SELECT doc_id, regexp_matches(lower(coalesce(source, 'none')), '^(src|crawl)') AS src, doc_id % 3 = 0 AS list, doc_id % 2 <> 0 AS no_date, regexp_matches(coalesce(text, ''), '(?i)\b(token|password)\s*=') AS tok, contains(coalesce(text, ''), chr(10)) AS two, regexp_matches(coalesce(text, ''), '(?i)\b(https?|ftp)://[^/\s<>\x22\x27]*[.]example[.]org') AS org FROM documents),
  g AS (SELECT *, tok AND (src OR list) AS leak FROM f)
  SELECT doc_id, s.symbol, s.score::DOUBLE AS score FROM g, (VALUES ('NO_DATE', -1.0), ('HAS_LIST', 1.0), ('UNSET', 1.0), ('SUBJECT_IS', 1.0), ('TWO_LINES', 1.0), ('LATE_BCC', 1.0), ('LEAK', 2.5), ('LEAK_LINK', 3.5), ('MANY', 1.0)) s(symbol, score)
  WHERE CASE s.symbol WHEN 'NO_DATE' THEN no_date WHEN 'HAS_LIST' THEN list WHEN 'TWO_LINES' THEN two WHEN 'LEAK' THEN leak WHEN 'LEAK_LINK' THEN leak AND org WHEN 'MANY' THEN leak::INT + two::INT + no_date::INT > 1 ELSE true END""")
def rule_file(spark, sf_dir):
    """A rule file, read and run over a message of each document."""
    messages = documents(spark, sf_dir).select("doc_id", F.expr(_RAW).alias("raw"), F.col("text").alias("body"))
    return rulefile.findings(messages, rulefile.load(FILE.splitlines()), "doc_id")
