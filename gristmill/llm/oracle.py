"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS start, hits[i] AS hit
  FROM (SELECT doc_id, gaps, hits, kept, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS kept
    FROM d WHERE regexp_matches(text, '{pattern}'))) WHERE length(kept[i]) >= {least}"""


_LOGIN = r"[a-z][a-z0-9+.-]{0,30}://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@"
_TOKEN = r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_kind(0, "assign", _ASSIGN, 2, 6)} UNION ALL {_kind(1, "access", "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_kind(2, "hex", "[0-9a-f]{24,}", 0, 24)}
  UNION ALL {_kind(3, "key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0)} UNION ALL {_kind(4, "jwt", _TOKEN, 0, 0)} UNION ALL {_kind(5, "login", _LOGIN, 0, 0)}),
a AS (SELECT doc_id, string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, rank) AS spans, string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  6 * max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY text) AS n_skipped FROM d LEFT JOIN a USING (doc_id)"""

#: The mix as windows over whole sources: the cut is the last finish time within the budget.
MIXING = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM t),
f AS (SELECT *, source_size * 3 AS bound, sum(source_size) OVER () AS total, coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT source, source_size, bound, weight, first_value((total - below) / open) OVER (ORDER BY CASE WHEN (total - below) / open * weight <= bound THEN 0 ELSE 1 END, below ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT source, source_size, least(weight * level, bound::DOUBLE) AS target FROM l),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT size, (k * source_size + cum) / target AS finish FROM c, range(3) r(k) WHERE size > 0 AND target > 0),
cut AS (SELECT max(finish) AS cut FROM (SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS upto FROM e GROUP BY finish) WHERE upto <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 AND target > 0 THEN size * ((cum / target <= cut)::INT + ((source_size + cum) / target <= cut)::INT + ((2 * source_size + cum) / target <= cut)::INT) ELSE 0 END::BIGINT AS taken FROM c, cut"""


def _level(k: int) -> str:
    return f""",
n{k} AS (SELECT host, template, sum(bad) > 0 AND sum(bad) < sum(known) AS mixed, (sum(bad) + 4.0 * max(prior)) / (sum(known) + 4.0) AS purity FROM t{k} GROUP BY ALL),
s{k} AS (SELECT t.* EXCLUDE (prior), mixed, purity AS prior, segments[{k + 1}] AS seg FROM t{k} t JOIN n{k} USING (host, template)),
e{k} AS (SELECT host, path, rule, label, bad, known, template || CASE WHEN mixed THEN '' ELSE repeat('/*', greatest(len(segments) - {k}, 0)) END AS template, prior FROM s{k} WHERE NOT mixed OR seg IS NULL),
g{k} AS (SELECT * FROM s{k} WHERE mixed AND seg IS NOT NULL),
c{k} AS (SELECT host, template, seg, sum(n) AS cn, sum(bad) AS cb, sum(known) AS ck, sum(CASE WHEN len(segments) = {k + 1} THEN n ELSE 0 END) AS ce FROM g{k} GROUP BY ALL),
v{k} AS (SELECT c.*, ck > 0 AS labelled, ce * 2 >= cn AS leaf, CASE WHEN ck > 0 THEN cb / ck ELSE 0 END AS share FROM c{k} c JOIN (SELECT host, template FROM c{k} GROUP BY ALL HAVING count(*) < 8 OR count(*) * count(*) <= sum(cn)) USING (host, template)),
l{k} AS (SELECT *, lag(share) OVER w AS sb, lag(cb) OVER w AS bb, lag(ck) OVER w AS kb FROM v{k} WINDOW w AS (PARTITION BY host, template, labelled, leaf ORDER BY share, seg)),
a{k} AS (SELECT *, CASE WHEN labelled AND (share - sb) * (share - sb) > 1.5 * 1.5 * (((cb + bb) / (ck + kb)) * (1 - (cb + bb) / (ck + kb)) * (1 / ck + 1 / kb)) THEN 1 ELSE 0 END AS apart FROM l{k}),
b{k} AS (SELECT *, sum(apart) OVER (PARTITION BY host, template, labelled, leaf ORDER BY share, seg) AS class FROM a{k}),
m{k} AS (SELECT host, template, seg, CASE WHEN count(*) OVER w = 1 THEN regexp_replace(seg, '^\\*', '%2A') ELSE '*' || min(seg) OVER w END AS name FROM b{k} WINDOW w AS (PARTITION BY host, template, labelled, leaf, class)),
t{k + 1} AS (SELECT g.host, g.path, g.n, g.rule, g.label, g.segments, g.bad, g.known, g.template || '/' || coalesce(name, '*') AS template, g.prior FROM g{k} g LEFT JOIN m{k} m ON g.host = m.host AND g.template = m.template AND g.seg = m.seg)"""


#: Levels written out; the paths of the tables have three segments at most.
LEVELS = 4
URLS = (
    r"""WITH u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, domain, start, verdict) AS (VALUES ('org/','org','/','allow'), ('example.org/es/','example.org','/es/','block'), ('example.org/en/1','example.org','/en/1','block'), ('com/fr/','com','/fr/','allow'), ('com/de/','com','/de/','block')),
q AS (SELECT host, path, count(*) AS n FROM u GROUP BY ALL),
fit AS (SELECT q.host, q.path, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS label FROM q JOIN r ON (q.host = domain OR q.host LIKE '%.' || domain) AND starts_with(q.path, start) GROUP BY ALL),
d AS (SELECT q.*, rule, label, CASE WHEN q.path = '' THEN [] ELSE string_split(substr(q.path, 2), '/') END AS segments, CASE WHEN label = 'block' THEN n ELSE 0 END AS bad, CASE WHEN label IS NOT NULL THEN n ELSE 0 END AS known FROM q LEFT JOIN fit USING (host, path)),
t0 AS (SELECT host, path, n, rule, label, segments, bad, known, '' AS template, (SELECT (sum(bad) + 1) / (sum(known) + 2) FROM d) AS prior FROM d)"""
    + "".join(_level(k) for k in range(LEVELS))
    + ",\nt AS ("
    + " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(LEVELS))
    + """),
pur AS (SELECT host, template, (sum(bad) + 4.0 * max(prior)) / (sum(known) + 4.0) AS purity FROM t GROUP BY ALL)
SELECT u.page_id, u.host, u.path, t.rule, coalesce(t.label, CASE WHEN pur.purity > 0.75 THEN 'block' ELSE 'allow' END) AS verdict, t.template, pur.purity FROM u JOIN t USING (host, path) JOIN pur ON pur.host = t.host AND pur.template = t.template"""
)

#: Every pair of sources by every kept term, without vectors.
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
w AS (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (w.n + 1)) // (w.total + v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN w USING (lang, term) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200"""

ORACLE = {"op5_secret_scan": SECRETS, "op8_mixing": MIXING, "op10_url_filter": URLS, "op13_source_divergence": DIVERGENCE}
