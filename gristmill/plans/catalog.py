"""Registered queries of the engine, by name, with DuckDB SQL to hold them against.

Each query is a thin composition of operators over whole tables. The SQL states
the same result independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import expr, selectors
from gristmill.functions import text as T
from gristmill.operators import bayes, buckets, fuzzy, maps, scoring, state, stats
from gristmill.plans.registry import ORACLE, QUERIES, documents, query, read

FLAGSHIP = "action_scores"

# --- rules, scores and actions -------------------------------------------------------------

URL, EMAIL, NOISE = r"https?://[A-Za-z0-9./?=&_-]+", r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+", r"[#%&*$]{3}"
SECRET, LICENSE = r"(password|token|secret|api_key)", r"(Licensed under|Copyright|All rights reserved)"


def _caps() -> Column:
    c = T.counters("text")
    return F.when(c["n_capitals"] * 10 > F.greatest(c["n_chars"], F.lit(1)) * 3, 1).otherwise(0)


def _rules() -> list[scoring.SymbolRule]:
    rule = scoring.SymbolRule
    return [
        rule("MANY_CAPS", _caps, 1.5, "style"),
        rule("HAS_URL", lambda: T.hits("text", URL), 0.5, "links", 3),
        rule("HAS_EMAIL", lambda: T.hits("text", EMAIL), 0.75, "leaks", 2),
        rule("HAS_SECRET", lambda: T.hits("text", SECRET), 2.0, "leaks", 2),
        rule("NOISE", lambda: T.hits("text", NOISE), 0.25, "style", 8),
        rule("LICENSE", lambda: T.hits("text", LICENSE), 0.5, "style"),
        rule("SHORT", lambda: F.when(T.hits("text", T.WORD) < 20, 1).otherwise(0), 1.0, "style"),
        rule("PLAIN_WORDS", lambda: F.when(T.hits("text", " the ") > 5, 1).otherwise(0), -0.5, "ham"),
    ]


LIMITS = scoring.Limits(groups={"style": 2.0, "leaks": 3.0})
GROWING = scoring.Limits(groups={"style": 2.0, "leaks": 3.0}, grow_factor=1.25)

#: The rules' hits as a SQL table f(doc_id, ord, symbol, grp, hits, score).
_HITS_SQL = rf"""
h AS (SELECT doc_id,
  CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) * 10 > greatest(length(text), 1) * 3 THEN 1 ELSE 0 END AS caps,
  least(len(regexp_extract_all(text, '{URL}')), 3) AS url, least(len(regexp_extract_all(text, '{EMAIL}')), 2) AS email,
  least(len(regexp_extract_all(text, '{SECRET}')), 2) AS secret, least(len(regexp_extract_all(text, '{NOISE}')), 8) AS noise,
  least(len(regexp_extract_all(text, '{LICENSE}')), 1) AS license,
  CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+')) < 20 THEN 1 ELSE 0 END AS short,
  CASE WHEN len(regexp_extract_all(text, ' the ')) > 5 THEN 1 ELSE 0 END AS plain FROM documents),
f AS (SELECT doc_id, ord, symbol, grp, hits, hits * weight AS score FROM (
  SELECT doc_id, 1 AS ord, 'MANY_CAPS' AS symbol, 'style' AS grp, caps AS hits, 1.5::DOUBLE AS weight FROM h
  UNION ALL SELECT doc_id, 2, 'HAS_URL', 'links', url, 0.5 FROM h UNION ALL SELECT doc_id, 3, 'HAS_EMAIL', 'leaks', email, 0.75 FROM h
  UNION ALL SELECT doc_id, 4, 'HAS_SECRET', 'leaks', secret, 2.0 FROM h UNION ALL SELECT doc_id, 5, 'NOISE', 'style', noise, 0.25 FROM h
  UNION ALL SELECT doc_id, 6, 'LICENSE', 'style', license, 0.5 FROM h UNION ALL SELECT doc_id, 7, 'SHORT', 'style', short, 1.0 FROM h
  UNION ALL SELECT doc_id, 8, 'PLAIN_WORDS', 'ham', plain, -0.5 FROM h) WHERE hits > 0)"""
#: Scores with caps; both capped groups have positive scores only, so clipping in order is clipping the sum.
_SCORE_SQL = f"""WITH {_HITS_SQL},
g AS (SELECT doc_id, grp, CASE grp WHEN 'style' THEN least(sum(score), 2.0) WHEN 'leaks' THEN least(sum(score), 3.0) ELSE sum(score) END AS s FROM f GROUP BY doc_id, grp),
s AS (SELECT d.doc_id, coalesce(t.score, 0.0) AS score, coalesce(n.pos, 0) AS n_positive, coalesce(n.neg, 0) AS n_negative FROM documents d
  LEFT JOIN (SELECT doc_id, sum(s) AS score FROM g GROUP BY doc_id) t USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) FILTER (score > 0) AS pos, count(*) FILTER (score < 0) AS neg FROM f GROUP BY doc_id) n USING (doc_id)),
a AS (SELECT *, CASE WHEN score >= 3.5 THEN 'reject' WHEN score >= 2.0 THEN 'add header' WHEN score >= 1.0 THEN 'greylist' ELSE 'no action' END AS action FROM s)"""


def scored_documents(spark: SparkSession, sf_dir: str, limits: scoring.Limits = LIMITS) -> DataFrame:
    return scoring.scored(scoring.findings(documents(spark, sf_dir).select("doc_id", "text"), _rules()), limits)


@query(f"""{_SCORE_SQL} SELECT doc_id, score, action, n_positive::INT AS n_positive, n_negative::INT AS n_negative,
  CASE WHEN action = 'reject' AND n_positive > 1 THEN 'spam' WHEN action = 'no action' AND (score < 0 OR n_negative > 3) THEN 'ham'
       WHEN action = 'add header' THEN 'junk' ELSE 'uncertain' END AS verdict FROM a""")
def action_scores(spark, sf_dir):
    return scored_documents(spark, sf_dir).select("doc_id", "score", "action", "n_positive", "n_negative", "verdict")


@query(f"WITH {_HITS_SQL} SELECT doc_id, symbol, hits::INT AS hits, score FROM f")
def rule_findings(spark, sf_dir):
    rows = scoring.findings(documents(spark, sf_dir).select("doc_id", "text"), _rules())
    return scoring.each(rows.select("doc_id", "findings")).select("doc_id", "f.symbol", "f.hits", "f.score")


@query(f"""{_SCORE_SQL} SELECT a.doc_id, round(a.score + coalesce(p.s * (p.f * 1.25 - 1) * CASE WHEN p.f > 1 THEN 1 ELSE 0 END, 0), 6) AS score
  FROM a LEFT JOIN (SELECT doc_id, sum(score) AS s, product(1 + 0.25 * score / 3.5) AS f FROM f WHERE score > 0 GROUP BY doc_id) p USING (doc_id)""")
def grown_scores(spark, sf_dir):
    return scored_documents(spark, sf_dir, GROWING).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_SCORE_SQL} SELECT action, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY action")
def action_shares(spark, sf_dir):
    return stats.action_shares(scored_documents(spark, sf_dir))


@query(f"""{_SCORE_SQL} SELECT symbol, count(*) AS hits, count(*) FILTER (a.score >= 3.5) AS spam_hits, count(*) FILTER (a.score >= 2 AND a.score < 3.5) AS junk_hits,
  count(*) FILTER (a.score < 2) AS ham_hits, round(sum(f.score) / count(*), 6) AS avg_weight,
  count(*) FILTER ((f.score > 0 AND a.score >= 3.5 AND a.score - f.score < 3.5) OR (f.score < 0 AND a.score < 3.5 AND a.score - f.score >= 3.5)) AS spam_change
  FROM f JOIN a USING (doc_id) GROUP BY symbol""")
def symbol_statistics(spark, sf_dir):
    return stats.symbol_stats(scored_documents(spark, sf_dir), 3.5, 2.0)


@query(f"""WITH {_HITS_SQL}, n AS (SELECT symbol, count(*) AS hits FROM f GROUP BY symbol)
  SELECT x.symbol AS a, y.symbol AS b, count(*) AS "both", round(count(*) / any_value(n.hits), 6) AS given
  FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.symbol <> y.symbol JOIN n ON n.symbol = x.symbol GROUP BY x.symbol, y.symbol""")
def symbol_correlations(spark, sf_dir):
    return stats.correlations(scored_documents(spark, sf_dir))


COMPOSITES = [
    scoring.Composite("LEAKY", "HAS_SECRET & (HAS_EMAIL | HAS_URL)", 3.0, "remove"),
    scoring.Composite("JUNKY", "NOISE + SHORT + LICENSE >= 2", 1.0, "remove_weight"),
    scoring.Composite("SHOUTED_LINK", "MANY_CAPS & HAS_URL & !HAS_SECRET", 0.5, "leave"),
]


@query(f"""WITH {_HITS_SQL},
has AS (SELECT doc_id, bool_or(symbol='HAS_SECRET') AS sec, bool_or(symbol='HAS_EMAIL') AS em, bool_or(symbol='HAS_URL') AS url, bool_or(symbol='NOISE') AS noi,
  bool_or(symbol='SHORT') AS sho, bool_or(symbol='LICENSE') AS lic, bool_or(symbol='MANY_CAPS') AS cap FROM f GROUP BY doc_id),
c AS (SELECT doc_id, sec AND (em OR url) AS leaky, noi::INT + sho::INT + lic::INT >= 2 AS junky, cap AND url AND NOT sec AS shout FROM has),
p AS (SELECT f.doc_id, symbol, CASE WHEN junky AND symbol IN ('NOISE','SHORT','LICENSE') THEN 0.0 ELSE score END AS score FROM f JOIN c USING (doc_id)
  WHERE NOT (leaky AND symbol IN ('HAS_SECRET','HAS_EMAIL','HAS_URL')))
SELECT * FROM p UNION ALL SELECT doc_id, 'LEAKY', 3.0 FROM c WHERE leaky UNION ALL SELECT doc_id, 'JUNKY', 1.0 FROM c WHERE junky UNION ALL SELECT doc_id, 'SHOUTED_LINK', 0.5 FROM c WHERE shout""")
def composite_findings(spark, sf_dir):
    rows = scoring.with_composites(scoring.findings(documents(spark, sf_dir).select("doc_id", "text"), _rules()), COMPOSITES)
    return scoring.each(rows.select("doc_id", "findings")).select("doc_id", "f.symbol", "f.score")


@query(r"""WITH d AS (SELECT doc_id, length(text)::DOUBLE AS n, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::DOUBLE AS w,
  len(regexp_extract_all(text, chr(10)))::DOUBLE AS l, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS en FROM documents)
  SELECT doc_id, CASE WHEN en <> 0 AND NOT (l > 3) THEN 1.0 ELSE 0.0 END AS short_english, CASE WHEN n / CASE WHEN w = 0 THEN NULL ELSE w END > 6 OR w < 10 THEN 1.0 ELSE 0.0 END AS odd,
  w * 2.0 + l - en AS mixed FROM d""")
def rule_expressions(spark, sf_dir):
    c = T.counters("text")
    atoms = {"LEN": c["n_chars"], "WORDS": c["n_words"], "BREAKS": c["n_lines"] - 1, "EN": F.when(F.col("lang") == "en", 1).otherwise(0)}
    odd = F.coalesce(expr.evaluate("LEN / WORDS > 6 | WORDS < 10", atoms), F.lit(1.0))
    return documents(spark, sf_dir).select("doc_id", expr.evaluate("EN & !(BREAKS > 3)", atoms).alias("short_english"), odd.alias("odd"), expr.evaluate("WORDS * 2.0 + BREAKS - EN", atoms).alias("mixed"))


# --- text, urls, selectors -----------------------------------------------------------------


@query(r"""SELECT doc_id, length(text)::INT AS n_chars, strlen(text)::INT AS n_bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines,
  len(regexp_extract_all(text, '\n\n'))::INT AS n_empty_lines, (length(text) - length(replace(text, ' ', '')))::INT AS n_spaces, len(regexp_extract_all(text, '  '))::INT AS n_double_spaces,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::INT AS n_capitals, (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::INT AS n_digits,
  (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))::INT AS n_non_ascii, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INT AS n_words FROM documents""")
def text_counters(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[v.cast("int").alias(k) for k, v in T.counters("text").items()])


@query("""SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_digests(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '([^.]+\.[^.]+)$', 1) AS domain FROM pages""")
def url_parts(spark, sf_dir):
    host = T.parse_host("url")
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"), T.registered_domain(host).alias("domain"))


@query(r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY length(url) DESC, page_id) AS nth FROM u)
  SELECT page_id, host, nth::INT AS nth FROM r WHERE nth <= 3""")
def specific_urls(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", T.parse_host("url").alias("host"), F.length("url").alias("size"))
    w = Window.partitionBy("host").orderBy(F.col("size").desc(), "page_id")
    return pages.withColumn("nth", F.row_number().over(w)).filter("nth <= 3").select("page_id", "host", "nth")


@query(r"""SELECT doc_id, concat_ws('/', source, md5(text)) AS key, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))[1:3], '-') AS least_words,
  coalesce(upper(substr(regexp_extract(lower(text), '[a-z]{4,}'), 1, 1)), '') AS initial FROM documents""")
def selector_values(spark, sf_dir):
    d = documents(spark, sf_dir)
    first = F.upper(selectors.combine(r"body.lower_utf8.regexp('/[a-z]{4,}/').substring(1, 1)"))
    return d.select("doc_id", selectors.combine("from;digest", "/").alias("key"), selectors.combine("words.uniq.take_n(3).join('-')").alias("least_words"), first.alias("initial"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '.')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY 1, 2),
  t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY 1) SELECT doc_id, round(-sum(k / total * log2(k / total)), 4) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id""")
def character_entropy(spark, sf_dir):
    chars = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^\n]"), F.lit(0))).alias("ch"))
    counts = chars.groupBy("doc_id", "ch").agg(F.count("*").alias("k"))
    return counts.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s")).select("doc_id", F.round(F.log2("n") - F.col("s") / F.col("n"), 4).alias("entropy"))


# --- lookup maps -----------------------------------------------------------------------------

_SOURCES = [("SRC0", "BULK:2.5"), ("src1", "1.5"), ("src3", "TRUSTED:-1:vip,known"), ("src7", "ODD")]
_HOST_PATTERNS = [(r"^(www|m)\.", "front"), (r"\.example\.org$", "org"), (r"^blog\.", "blog")]
_NETS = [("10.0.0.0/8", "private"), ("10.1.0.0/16", "lab"), ("10.1.2.0/24", "rack"), ("192.168.0.0/16", "home"), ("10.1.2.77", "host")]


@query("""SELECT doc_id, m.sym AS symbol, m.score FROM documents d JOIN (VALUES ('src0','BULK',2.5::DOUBLE),('src1',NULL,1.5),('src3','TRUSTED',-1.0),('src7','ODD',1.0)) m(k, sym, score) ON lower(d.source) = m.k""")
def map_exact(spark, sf_dir):
    met = maps.join_exact(documents(spark, sf_dir).select("doc_id", "source"), F.col("source"), spark.createDataFrame(_SOURCES, "key string, value string"))
    value = maps.parse_value(F.col("value"))
    return met.select("doc_id", value["symbol"].alias("symbol"), value["score"].alias("score"))


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS h FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(h, '^(www|m)\.') THEN 'front' WHEN regexp_matches(h, '\.example\.org$') THEN 'org' WHEN regexp_matches(h, '^blog\.') THEN 'blog' END AS first_hit,
  concat_ws(',', CASE WHEN regexp_matches(h, '^(www|m)\.') THEN 'front' END, CASE WHEN regexp_matches(h, '\.example\.org$') THEN 'org' END, CASE WHEN regexp_matches(h, '^blog\.') THEN 'blog' END) AS all_hits,
  h LIKE 'm.%.net' AS glob_hit FROM h""")
def map_regexp(spark, sf_dir):
    host = T.parse_host("url")
    every = F.array_join(maps.match_patterns(host, _HOST_PATTERNS, every=True), ",")
    return read(spark, sf_dir, "pages").select("page_id", maps.match_patterns(host, _HOST_PATTERNS).alias("first_hit"), every.alias("all_hits"), host.rlike(maps.glob_pattern("m.*.net")).alias("glob_hit"))


@query("""WITH e AS (SELECT event_id, user_id % 4 AS b, user_id % 256 AS d, (user_id // 3) % 3 AS c FROM events),
  a AS (SELECT event_id, CASE WHEN b = 3 THEN '192.168.' ELSE '10.' || b || '.' END || c || '.' || d AS ip, b, c, d FROM e)
  SELECT event_id, ip, CASE WHEN b = 3 THEN 'home' WHEN b = 1 AND c = 2 AND d = 77 THEN 'host' WHEN b = 1 AND c = 2 THEN 'rack' WHEN b = 1 THEN 'lab' ELSE 'private' END AS net FROM a""")
def map_networks(spark, sf_dir):
    b, d, c = F.col("user_id") % 4, F.col("user_id") % 256, F.floor(F.col("user_id") / 3) % 3
    ip = F.concat_ws(".", F.when(b == 3, F.lit("192.168")).otherwise(F.concat(F.lit("10."), b.cast("string"))), c.cast("string"), d.cast("string"))
    rows = read(spark, sf_dir, "events").select("event_id", ip.alias("ip"))
    return maps.join_longest_prefix(rows, "ip", spark.createDataFrame(_NETS, "key string, value string")).select("event_id", "ip", F.col("value").alias("net"))


# --- Bayes and fuzzy storage -----------------------------------------------------------------

_PAIR_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT DISTINCT doc_id, w[i] || chr(31) || w[i + 1] || chr(31) || '1' AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
t AS (SELECT doc_id, ('0x' || substr(md5(pair), 1, 15))::BIGINT AS token FROM p),
c AS (SELECT token, count(*) FILTER (toxic = 1) AS spam_n, count(*) FILTER (toxic = 0) AS ham_n FROM t JOIN labels USING (doc_id) GROUP BY token)"""


@query(f"WITH {_PAIR_SQL} SELECT * FROM c")
def bayes_learn(spark, sf_dir):
    return bayes.learn_texts(documents(spark, sf_dir), read(spark, sf_dir, "labels"), label_col="toxic")[0]


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tokens of all texts, and what the labelled ones teach."""
    docs = documents(spark, sf_dir)
    return bayes.tokens(docs), *bayes.learn_texts(docs, read(spark, sf_dir, "labels"), label_col="toxic")


_BAYES_SQL = f"""WITH {_PAIR_SQL}, l AS (SELECT count(*) FILTER (toxic = 1) AS sl, count(*) FILTER (toxic = 0) AS hl FROM labels),
k AS (SELECT token, spam_n + ham_n AS n, (spam_n / greatest(sl, 1)) / (spam_n / greatest(sl, 1) + ham_n / greatest(hl, 1)) AS p FROM c, l),
b AS (SELECT token, (n / (1 + n) * 0.5 + n * p) / (n / (1 + n) + n) AS bp, (n / (1 + n) * 0.5 + n * (1 - p)) / (n / (1 + n) + n) AS bh FROM k),
s AS (SELECT doc_id, count(*) AS n_tokens, sum(round(ln(bp) * 1e9)::BIGINT)::DOUBLE / 1e9 AS lp, sum(round(ln(bh) * 1e9)::BIGINT)::DOUBLE / 1e9 AS lh FROM t JOIN b USING (token) WHERE abs(bp - 0.5) >= 0.05 GROUP BY doc_id)"""


@query(f"{_BAYES_SQL} SELECT doc_id, n_tokens, round(lp, 4) AS ln_spam, round(lh, 4) AS ln_ham FROM s")
def bayes_evidence(spark, sf_dir):
    sums = bayes.evidence(*_evidence(spark, sf_dir))
    return sums.select("doc_id", "n_tokens", F.round("ln_bp", 4).alias("ln_spam"), F.round("ln_bh", 4).alias("ln_ham"))


def _tail(v: str) -> str:
    """SQL of min(1, sum over i < n_tokens of e^v (-v)^i / i!)."""
    return f"least(1.0, list_sum(list_transform(range(n_tokens), lambda i: exp({v} + i * ln(-{v}) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END))))"


@query(f"{_BAYES_SQL} SELECT doc_id, n_tokens, round(CASE WHEN lp > -300 AND lh > -300 THEN ((1 - {_tail('lh')}) + 1 - (1 - {_tail('lp')})) / 2 ELSE 1 / (1 + exp(least(greatest(lh - lp, -500), 500))) END, 6) AS prob FROM s")
def bayes_classify(spark, sf_dir):
    return bayes.classify(*_evidence(spark, sf_dir)).select("doc_id", "n_tokens", F.round("prob", 6).alias("prob"))


@query()
def bayes_evaluation(spark, sf_dir):
    """Only texts with a label are judged, as only they are counted."""
    docs, labels = documents(spark, sf_dir), read(spark, sf_dir, "labels")
    known = maps.small(labels.filter("toxic is not null").select("doc_id", "toxic"), bayes.LABELS_BROADCAST)
    of = docs.join(known.select("doc_id"), "doc_id", "left_semi")
    rows = bayes.classify(bayes.tokens(of), *bayes.learn_texts(docs, labels, label_col="toxic")).join(known, "doc_id")
    return rows.agg(*bayes.evaluate(F.col("prob") > 0.5, F.col("toxic") == 1))


_SHINGLE_SQL = r"""ww AS (SELECT id, src, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM x),
win AS (SELECT DISTINCT id, src, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, src, w, unnest(range(1, len(w) - 1)) AS i FROM ww)),
hh AS (SELECT id, src, ('0x' || substr(md5(s), 1, 7))::BIGINT AS a, ('0x' || substr(md5(s), 9, 7))::BIGINT AS b FROM win),
sh AS (SELECT id, src, pos, min((a + b * (pos + 1)) % 2147483647) AS value FROM hh, range(32) r(pos) GROUP BY 1, 2, 3)"""


@query(f"WITH x AS (SELECT item_id AS id, 'b' AS src, text FROM benchmark), {_SHINGLE_SQL} SELECT id AS item_id, pos::INT AS pos, value FROM sh")
def fuzzy_shingles(spark, sf_dir):
    return fuzzy.shingles(read(spark, sf_dir, "benchmark"), "item_id")


@query(f"""WITH x AS (SELECT item_id AS id, 'b' AS src, text FROM benchmark UNION ALL SELECT doc_id, 'd', text FROM documents), {_SHINGLE_SQL},
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) / 32 AS share FROM sh d JOIN sh b ON d.src = 'd' AND b.src = 'b' AND d.pos = b.pos AND d.value = b.value GROUP BY 1, 2 HAVING count(*) / 32 > 0.25)
SELECT doc_id, item_id, share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, item_id) AS r FROM m) WHERE r = 1""")
def fuzzy_match(spark, sf_dir):
    return fuzzy.match(fuzzy.shingles(documents(spark, sf_dir), "doc_id"), fuzzy.shingles(read(spark, sf_dir, "benchmark"), "item_id"), "doc_id", "item_id", 0.25)


# --- state over events ------------------------------------------------------------------------

_EVENTS_SQL = "e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


_LIMITS_SQL = f"""WITH RECURSIVE {_EVENTS_SQL}, z AS (
  SELECT event_id, user_id, rn, t, 1.0::DOUBLE AS level, false AS limited FROM e WHERE rn = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.rn, e.t, CASE WHEN greatest(0, z.level - (e.t - z.t) * 0.0001) + 1 > 5 THEN greatest(0, z.level - (e.t - z.t) * 0.0001) ELSE greatest(0, z.level - (e.t - z.t) * 0.0001) + 1 END,
    greatest(0, z.level - (e.t - z.t) * 0.0001) + 1 > 5 FROM z JOIN e ON e.user_id = z.user_id AND e.rn = z.rn + 1)
  SELECT user_id::VARCHAR AS user_id, event_id, round(level, 4) AS level, limited FROM z"""


@query(_LIMITS_SQL)
def rate_limits(spark, sf_dir):
    out = state.fold(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", state.token_bucket(5, 0.0001), "level double, limited boolean")
    return out.withColumn("level", F.round("level", 4))


@query(_LIMITS_SQL)
def rate_limits_in_slots(spark, sf_dir):
    """The same buckets, each user's days in tasks of their own."""
    out = buckets.limits(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5, 0.0001)
    return out.withColumn("level", F.round("level", 4))


@query(f"""WITH RECURSIVE {_EVENTS_SQL}, z AS (SELECT event_id, user_id, rn, t, value AS average FROM e WHERE rn = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.rn, e.t, (1 - exp(-(e.t - z.t) / 86400)) * e.value + exp(-(e.t - z.t) / 86400) * z.average FROM z JOIN e ON e.user_id = z.user_id AND e.rn = z.rn + 1)
  SELECT user_id::VARCHAR AS user_id, event_id, round(average, 4) AS average, rn AS n, round(CASE WHEN rn < 10 THEN 0.0 ELSE tanh(average / 100 * 1.83178 - 0.5493) END, 4) AS reputation FROM z""")
def reputations(spark, sf_dir):
    out = state.fold(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", state.moving_average(86400.0), "average double, n long")
    return out.select("user_id", "event_id", F.round("average", 4).alias("average"), "n", F.round(state.reputation_score("average", "n", 100.0), 4).alias("reputation"))


@query(f"""WITH RECURSIVE {_EVENTS_SQL}, z AS (
  SELECT event_id, user_id, rn, t AS first, 'new' AS verdict FROM e WHERE rn = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.rn, CASE WHEN e.t - z.first <= 432000 THEN z.first ELSE e.t END, CASE WHEN e.t - z.first > 432000 THEN 'new' WHEN e.t - z.first >= 3600 THEN 'pass' ELSE 'defer' END
    FROM z JOIN e ON e.user_id = z.user_id AND e.rn = z.rn + 1)
  SELECT user_id::VARCHAR AS user_id, event_id, verdict FROM z""")
def greylisting(spark, sf_dir):
    return state.fold(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", state.greylist(3600.0, 5 * 86400.0), "verdict string")


@query("""SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS nth FROM events) WHERE nth <= 5""")
def history_ring(spark, sf_dir):
    return state.newest(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", "nth")


def _rounded(n: str, d: str) -> str:
    """SQL of a whole quotient to the nearest whole number, halves upwards."""
    return f"((2 * ({n}) + ({d}) - ((2 * ({n}) + ({d})) % (2 * ({d})) + 2 * ({d})) % (2 * ({d}))) // (2 * ({d})))::BIGINT"


@query(f"""WITH p AS (SELECT event_type, floor(floor(epoch_us(ts) / 1000000) / 3600)::BIGINT * 3600 AS point, sum(round(value * 1e6)::BIGINT)::BIGINT AS total, count(value) AS n FROM events GROUP BY 1, 2),
  r AS (SELECT event_type, floor(point / 21600)::BIGINT * 21600 AS slot, sum({_rounded("total", "n")})::BIGINT AS s, max({_rounded("total", "n")}) AS mx, min({_rounded("total", "n")}) AS mn, count(*) AS known FROM p WHERE n > 0 GROUP BY 1, 2)
  SELECT event_type, slot, CASE WHEN 6 - known <= 3 THEN {_rounded("s", "100 * known")} / 1e4 END AS average, CASE WHEN 6 - known <= 3 THEN {_rounded("mx", "100")} / 1e4 END AS maximum, CASE WHEN 6 - known <= 3 THEN {_rounded("mn", "100")} / 1e4 END AS minimum, known FROM r""")
def round_robin_archive(spark, sf_dir):
    return state.archive(read(spark, sf_dir, "events"), "ts", "value", 3600, 6, group=["event_type"])


@query("""SELECT event_type, epoch(time_bucket(INTERVAL 6 HOURS, ts))::BIGINT AS start, count(*) AS n, round(sum(round(value * 1e4)::BIGINT) / 1e4, 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    out = read(spark, sf_dir, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 1e4).cast("long")) / 1e4, 4).alias("total"))
    return out.select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


# --- vectors and relational forms -----------------------------------------------------------------


@query("""WITH x AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT dim::INT AS dim, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM x GROUP BY dim""")
def vector_moments(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    return rows.groupBy("dim").agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("mean"), F.round(F.stddev_pop(F.col("v").cast("double")), 4).alias("std"))


@query("""WITH s AS (SELECT o_orderpriority AS p, o_totalprice AS v, (o_orderstatus = 'F')::INT AS y FROM orders),
  b AS (SELECT floor(v / 10000)::BIGINT AS cut, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1)
  SELECT cut, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr FROM b WINDOW w AS (ORDER BY cut DESC ROWS UNBOUNDED PRECEDING)""")
def roc_thresholds(spark, sf_dir):
    bins = read(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 10000).alias("cut")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("pos"), F.count_if(F.col("o_orderstatus") != "F").alias("neg"))
    above = Window.orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bins.select("cut", F.round(F.sum("pos").over(above) / F.sum("pos").over(every), 6).alias("tpr"), F.round(F.sum("neg").over(above) / F.sum("neg").over(every), 6).alias("fpr"))


@query("""SELECT r_name, n_name, o_orderpriority, count(*) AS orders, round(sum(round(o_totalprice * 100)::BIGINT) / 100, 2) AS total, grouping(r_name) + 0 AS level
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, o_orderpriority)""")
def order_rollup(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    rows = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out = rows.rollup("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100, 2).alias("total"), F.grouping("r_name").cast("long").alias("level"))
    return out


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role""")
def conversation_roles(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


@query("""SELECT a.conv_id, a.turn, b.turn AS answered_by FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role <> a.role""")
def conversation_replies(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    follows = (F.lead("turn").over(w) == F.col("turn") + 1) & (F.lead("role").over(w) != F.col("role"))
    return turns.select("conv_id", "turn", F.when(follows, F.lead("turn").over(w)).alias("answered_by"))


# --- languages, senders, splits -------------------------------------------------------------------

#: A few stop words of each language.
STOP_WORDS = {"en": ["the", "and", "of", "that"], "fr": ["le", "la", "et", "des"], "de": ["der", "die", "und", "das"], "es": ["el", "que", "los", "para"]}


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
  s(lang, w) AS (VALUES ('en','the'),('en','and'),('en','of'),('en','that'),('fr','le'),('fr','la'),('fr','et'),('fr','des'),('de','der'),('de','die'),('de','und'),('de','das'),('es','el'),('es','que'),('es','los'),('es','para')),
  c AS (SELECT doc_id, s.lang, count(*) AS hits FROM w JOIN s USING (w) GROUP BY 1, 2)
  SELECT doc_id, lang AS guess, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS r FROM c) WHERE r = 1""")
def stop_word_language(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", T.words("text").alias("w"))
    counts = F.array(*[F.struct(F.size(_among("w", s)).cast("long").alias("hits"), F.lit(lang).alias("guess")) for lang, s in sorted(STOP_WORDS.items())])
    best = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("hits"), F.lit("").alias("guess")), lambda a, x: F.when(x["hits"] > a["hits"], x).otherwise(a))
    return words.select("doc_id", best.alias("b")).filter("b.hits > 0").select("doc_id", "b.guess", "b.hits")


def _among(column: str, listed: list[str]) -> Column:
    return F.filter(column, lambda x: x.isin(*listed))


@query("""SELECT source, max(doc_id) AS last_id, count(*) AS messages, count(DISTINCT md5(text)) AS distinct_texts FROM documents GROUP BY source HAVING count(*) > 1""")
def known_senders(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("messages"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("distinct_texts")).filter("messages > 1")


@query("""SELECT doc_id, CASE WHEN ('0x' || substr(md5('split:' || doc_id), 1, 15))::BIGINT % 10 < 8 THEN 'train' ELSE 'test' END AS part FROM documents""")
def train_test_split(spark, sf_dir):
    fold = T.hash60(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))) % 10
    return documents(spark, sf_dir).select("doc_id", F.when(fold < 8, "train").otherwise("test").alias("part"))


from gristmill.plans import forms, learning, lookup, mail, mailmodules, methods, pages, parts, rules, sequences, tables, texts, web  # noqa: E402, F401 (they register more queries)
