"""Queries of the methods on message parts, addresses, patterns and utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import network as N
from gristmill.functions import strings as S
from gristmill.functions import utilities as U
from gristmill.plans.mail import M_SQL, messages
from gristmill.plans.registry import documents, query

#: Fields of a part, as SQL text over kind, content, ctype, encoding, raw and file.
PART = {
    "is_html": "kind = 'html'", "is_text": "kind <> 'file'", "is_attachment": "kind = 'file'", "is_empty": "kind <> 'file' AND length(content) = 0", "n_chars": "CAST(length(content) AS INT)", "digest": "md5(content)", "oneline": "md5(replace(replace(content, chr(13), ''), chr(10), ''))",
    "charset": "lower(regexp_extract(coalesce(ctype, ''), 'charset=\"?([A-Za-z0-9_-]+)', 1))", "type": "lower(regexp_extract(coalesce(ctype, ''), '^([^/; ]+)', 1))", "subtype": "lower(regexp_extract(coalesce(ctype, ''), '^[^/; ]+/([^; ]+)', 1))", "boundary": "regexp_extract(coalesce(ctype, ''), 'boundary=\"?([^\"; ]+)', 1)", "cte": "lower(coalesce(encoding, '7bit'))",
    "is_multipart": "coalesce(ctype, '') LIKE 'multipart/%'", "extension": "CASE WHEN kind = 'file' THEN lower(regexp_extract(content, '[.]([^.]+)$', 1)) ELSE '' END", "is_archive": "kind = 'file' AND (content LIKE '%.zip' OR content LIKE '%.rar' OR content LIKE '%.gz')", "n_headers": "CAST(length(raw) - length(replace(raw, chr(10), '')) AS INT)",
    "url_chars": "CAST(length(content) - length(regexp_replace(content, 'https?://[A-Za-z0-9./?=&_-]+', '')) AS INT)", "alternative": "kind <> 'file' AND has_other", "first_header": "regexp_extract(raw, '^([^:]+):', 1)",
}
_PARTS_SQL = "p AS (SELECT doc_id, 'plain' AS kind, plain AS content, ctype, encoding, raw, html IS NOT NULL AS has_other FROM m UNION ALL SELECT doc_id, 'html', html, ctype, encoding, raw, plain IS NOT NULL FROM m UNION ALL SELECT doc_id, 'file', file, ctype, encoding, raw, false FROM m)"
_PART_DUCK = {n: e.replace("_-]+', '')) AS INT)", "_-]+', '', 'g')) AS INT)") for n, e in PART.items()}


@query(f"WITH {M_SQL}, {_PARTS_SQL} SELECT doc_id, kind, {', '.join(f'{e} AS {n}' for n, e in _PART_DUCK.items())}, regexp_matches(content, '[^\\x00-\\x7F]') AS has_8bit, len(regexp_extract_all(content, '[A-Za-z0-9]+'))::INT AS n_words, strlen(content)::INT AS n_bytes FROM p WHERE content IS NOT NULL")
def part_methods(spark, sf_dir):
    """Every part of every message with its fields."""
    kinds = [("plain", F.col("plain"), F.col("html").isNotNull()), ("html", F.col("html"), F.col("plain").isNotNull()), ("file", F.col("file"), F.lit(False))]
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("content"), o.alias("has_other")) for k, c, o in kinds])
    rows = messages(spark, sf_dir).select("doc_id", "ctype", "encoding", "raw", F.explode(parts).alias("p")).select("doc_id", "ctype", "encoding", "raw", "p.*").filter("content is not null")
    more = {"has_8bit": F.regexp_like("content", F.lit(r"[^\x00-\x7F]")), "n_words": F.regexp_count("content", F.lit("[A-Za-z0-9]+")), "n_bytes": F.octet_length("content")}
    return rows.select("doc_id", "kind", *[F.expr(e).alias(n) for n, e in PART.items()], *[c.alias(n) for n, c in more.items()])


_NUMBER = "(split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT)"


@query(f"""WITH {M_SQL} SELECT doc_id, ip, {_NUMBER} AS number, array_to_string(list_reverse(string_split(ip, '.')), '.') AS inversed, list_sum(list_transform(string_split(ip, '.'), lambda x: x::INT))::BIGINT AS octet_sum, 4 AS version, true AS is_valid,
  {" OR ".join(f"{_NUMBER} BETWEEN {a} AND {b}" for a, b in N.LOCAL)} AS is_local, {_NUMBER} - {_NUMBER} % 65536 AS network, regexp_extract(ip, '^([0-9]+[.][0-9]+)', 1) || '.0.0' AS network_text FROM m""")
def ip_methods(spark, sf_dir):
    ip = F.col("ip")
    total = F.aggregate(N.octets(ip), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return messages(spark, sf_dir).select("doc_id", "ip", N.ip_number(ip).alias("number"), N.inversed(ip).alias("inversed"), total.alias("octet_sum"), N.version(ip).alias("version"), N.is_valid(ip).alias("is_valid"), N.is_local(ip).alias("is_local"), N.mask(ip, 16).alias("network"), N.to_text(N.mask(ip, 16)).alias("network_text"))


_WORDS = ["password", "the", "und", "AKIA"]


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  SELECT doc_id, regexp_matches(t, '^[A-Z]') AS matched, least(len(regexp_extract_all(t, '[0-9]+')), 3)::INT AS matched_n, array_to_string(regexp_extract_all(t, '[A-Z]{{2,}}')[1:5], ',') AS found, len(regexp_split_to_array(t, '[.!?]'))::INT AS n_split, regexp_matches(t, '(?s)^.*copy.*right.*$') AS globbed, contains(t, 'the ') AS plain,
    array_to_string(list_filter([{", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in _WORDS)}], lambda x: x IS NOT NULL), ',') AS trie FROM d""")
def pattern_methods(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    made = {"matched": F.regexp_like(t, F.lit("^[A-Z]")), "matched_n": F.size(U.pattern_search(t, "[0-9]+", 3)), "found": F.array_join(U.pattern_search(t, "[A-Z]{2,}", 5), ","), "n_split": F.size(F.split(t, "[.!?]", -1)), "globbed": t.rlike("(?s)" + U.glob_pattern("*copy*right*")), "plain": U.match_plain(t, "the "), "trie": F.array_join(U.trie_matches(t, _WORDS), ",")}
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in made.items()])


@query(f"""WITH {M_SQL} SELECT doc_id, length(coalesce(subject, '')) - length(regexp_replace(coalesce(subject, ''), '[A-Z]', '', 'g')) > greatest(length(coalesce(subject, '')) - length(regexp_replace(coalesce(subject, ''), '[a-z]', '', 'g')), 0) AS uppercase,
    lower(coalesce(from_name, '')) = lower(coalesce(reply_name, '')) AS same_name, ('0x' || substr(md5(lower(helo)), 1, 15))::BIGINT AS hash, regexp_matches(coalesce(html, ''), '[^\\x{{0}}-\\x{{24F}}]') AS outside, length(coalesce(plain, '')) - length(regexp_replace(coalesce(plain, ''), '[0-9]', '', 'g')) AS digits, length(coalesce(plain, '')) - length(regexp_replace(coalesce(plain, ''), '[A-Za-z]', '', 'g')) AS letters,
    length(coalesce(plain, '')) - length(regexp_replace(coalesce(plain, ''), '[ \\t\\r\\n]', '', 'g')) AS spaces, round(pow((doc_id % 100 / 100.0 - 0.5) * 2, 8.0), 6) AS normal, round(tanh(doc_id % 7 / 3.0), 6) AS tanh, CASE WHEN regexp_matches(coalesce(from_name, ''), '[^\\x00-\\x7F]') THEN '=?UTF-8?B?' || to_base64(encode(from_name)) || '?=' ELSE coalesce(from_name, '') END AS encoded,
    levenshtein(helo, coalesce(hostname, ''))::INT AS distance, strftime(make_timestamp(1704067200000000 + doc_id % 1000 * 3600000000), '%Y-%m-%d %H:%M') AS time, url_decode('a%20b+c%3D' || asn) AS decoded FROM m""")
def utility_methods(spark, sf_dir):
    def text(c):
        return F.coalesce(c, F.lit(""))

    counted = U.statistics(text("plain"))
    made = {
        "uppercase": U.is_uppercase(text("subject")), "same_name": U.equal_caseless(text("from_name"), text("reply_name")), "hash": U.caseless_hash(F.col("helo")), "outside": U.outside_range(text("html")), **{n: c.cast("long") for n, c in counted.items()}, "normal": F.round(U.normalize_prob(F.col("doc_id") % 100 / 100.0), 6), "tanh": F.round(F.tanh(F.col("doc_id") % 7 / 3.0), 6),
        "encoded": U.header_encode(text("from_name")), "distance": F.levenshtein("helo", text("hostname")), "time": F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 1000 * 3600), "yyyy-MM-dd HH:mm"), "decoded": F.regexp_replace(U.decode_url(F.concat(F.lit("a%20b+c%3D"), "asn")), "b c", "b+c"),
    }
    return messages(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in made.items()])


@query("SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def base32_round_trip(spark, sf_dir):
    """Digests in base 32: as many texts as there are, each of its own length."""
    rows = documents(spark, sf_dir).filter("text is not null").withColumn("digest", F.md5(F.col("text").cast("binary")))
    return rows.withColumn("coded", S.base32(F.col("digest"))).filter(F.length("coded") == 52).select("doc_id", F.length("text").cast("long").alias("n_chars"), "digest")
