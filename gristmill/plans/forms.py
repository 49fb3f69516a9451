"""Queries over word forms, trigram profiles, fuzzy storage, archives, message keys and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import html as H
from gristmill.functions import text as T
from gristmill.functions import wordforms as W
from gristmill.operators import fuzzystore, trigrams
from gristmill.plans.mail import M_SQL, messages
from gristmill.plans.registry import documents, query, read
from gristmill.plans.web import _LINKS_SQL


@query(f"SELECT doc_id, len(s)::INT AS n_words, len(list_distinct(s))::INT AS n_stems, md5(array_to_string(s, ' ')) AS stems_md5 FROM (SELECT doc_id, {W.stems_sql("regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')")} AS s FROM documents)")
def stemmed_words(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", W.stems("regexp_extract_all(lower(coalesce(text, '')), '[a-z]+', 0)").alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_words"), F.size(F.array_distinct("s")).alias("n_stems"), F.md5(F.array_join("s", " ").cast("binary")).alias("stems_md5"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
  p AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE i <= 60 OR ('0x' || substr(md5(doc_id || ':' || (i - 1)), 1, 15))::BIGINT % 10 < 5)
  SELECT doc_id, count(x) AS n_kept, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS kept_md5 FROM w LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def decayed_words(spark, sf_dir):
    """The first 60 words of every text and half of those that follow."""
    rows = documents(spark, sf_dir).select("doc_id", W.decayed(T.words(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string"), 60).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_kept"), F.md5(F.array_join("w", " ").cast("binary")).alias("kept_md5"))


#: Every third text with Cyrillic letters in place of some Latin ones, since the table has no such texts.
_DISGUISED = "CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeo', 'аео') ELSE text END"


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_DISGUISED}, '[0-9A-Za-zͰ-ӿ]+')) AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN length(w) > 40 THEN 0 ELSE least(coalesce(list_sum(list_transform(regexp_extract_all(w, '{W.SWITCH}'), lambda s: 1.0::DOUBLE / (length(s) - 1))), 0) + len(regexp_extract_all(w, '{W.DIGIT_SWITCH}')) * 0.25, 4.0) END AS s FROM w)
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (s > 0) AS n_mixed, round(sum(round(s, 6)), 4) AS score FROM s GROUP BY doc_id""")
def mixed_words(spark, sf_dir):
    """Words of each text, those of mixed alphabets, and how mixed they are."""
    words = F.regexp_extract_all(F.expr(_DISGUISED), F.lit("[0-9A-Za-zͰ-ӿ]+"), F.lit(0))
    scored = F.transform(words, lambda w: W.mixed_score(w))
    rows = documents(spark, sf_dir).select("doc_id", scored.alias("s")).filter(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_words"), F.size(F.filter("s", lambda x: x > 0)).cast("long").alias("n_mixed"), F.round(total, 4).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS w FROM documents), g AS (SELECT doc_id, lang, substr(w, i, 3) AS g FROM (SELECT *, unnest(range(1, length(w) - 1)) AS i FROM w)),
  d AS (SELECT doc_id, g, count(*) AS k FROM g GROUP BY 1, 2), p AS (SELECT lang, g, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT lang, sum(n)::BIGINT AS total, count(*) AS kinds FROM p GROUP BY 1),
  q AS (SELECT lang, g, round(ln((n + 1) / (total + kinds)) * 1e6)::BIGINT - round(ln(1 / (total + kinds)) * 1e6)::BIGINT AS gain, round(ln(1 / (total + kinds)) * 1e6)::BIGINT AS base FROM p JOIN t USING (lang)),
  a AS (SELECT doc_id, sum(k)::BIGINT AS n_trigrams FROM d GROUP BY 1), s AS (SELECT doc_id, lang, n_trigrams, sum(k * gain)::BIGINT + n_trigrams * max(base) AS score FROM d JOIN q USING (g) JOIN a USING (doc_id) GROUP BY 1, 2, 3)
  SELECT doc_id, n_trigrams, lang AS guess, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM s) WHERE r = 1""")
def trigram_language(spark, sf_dir):
    """The language whose trigram profile, counted over all labelled texts, makes each text likeliest."""
    return trigrams.likeliest(documents(spark, sf_dir), "doc_id", "lang")


_HALVES = "len(w) // 2"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), h AS (SELECT doc_id, w, list_distinct(w[1:{_HALVES}]) AS a, list_distinct(w[{_HALVES} + 1:]) AS b FROM w)
  SELECT doc_id, (2 * len(list_distinct(w)) - len(a) - len(b))::INT AS distance, round((len(a) + len(b) - len(list_distinct(w))) / CASE WHEN len(w) > 0 THEN len(list_distinct(w)) END, 6) AS likeness, sha256(array_to_string(w, chr(31))) AS signature, sha256(array_to_string(list_sort(list_distinct(w)), chr(31))) AS unordered FROM h""")
def word_sets(spark, sf_dir):
    """How the word sets of a text's two halves differ, and digests of all its words in order and in any order."""
    rows = documents(spark, sf_dir).select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("half", F.floor(F.size("w") / 2).cast("int"))
    a, b = F.slice("w", F.lit(1), F.col("half")), F.slice("w", F.col("half") + 1, F.size("w"))
    return rows.select("doc_id", W.set_distance(a, b).alias("distance"), F.round(W.set_likeness(a, b), 6).alias("likeness"), W.digest(F.col("w")).alias("signature"), W.digest(F.array_distinct("w"), ordered=False).alias("unordered"))


_SAFE = "https://safe.example/?u="


@query(f"""WITH {_LINKS_SQL}, n AS (SELECT href, count(*) AS times, count(DISTINCT page_id) AS pages FROM l GROUP BY 1) SELECT md5(href) AS url_md5, times, pages, CASE WHEN href LIKE 'http%' THEN '{_SAFE}' || url_encode(href) ELSE href END AS rewritten FROM n""")
def url_rewrites(spark, sf_dir):
    """Distinct links with their uses, and as they read once sent through a checking service."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("l")).select("page_id", "l.href")
    same = rows.groupBy("href", "page_id").agg(F.count("*").alias("n")).groupBy("href").agg(F.sum("n").alias("times"), F.count("*").alias("pages"))
    sent = F.when(F.col("href").like("http%"), F.concat(F.lit(_SAFE), W.encoded(F.col("href")))).otherwise(F.col("href"))
    return same.select(F.md5(F.col("href").cast("binary")).alias("url_md5"), "times", "pages", sent.alias("rewritten"))


#: Events read as commands on the stored set.
_COMMANDS = """SELECT event_id, user_id AS digest, CAST(floor(value) AS BIGINT) % 12 AS flag, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'refresh' ELSE 'add' END AS command, 1 + event_id % 5 AS value, {t} AS t FROM events"""
_STORE_SQL = f"""WITH c AS ({_COMMANDS.format(t="epoch_us(ts) // 1000000")}), x AS (SELECT digest, flag, max((t, event_id)) AS gone FROM c WHERE command = 'delete' GROUP BY 1, 2),
  s AS (SELECT digest, flag, sum(value) FILTER (command = 'add')::BIGINT AS value, max(t) AS touched FROM c LEFT JOIN x USING (digest, flag) WHERE command <> 'delete' AND (gone IS NULL OR (t, event_id) > gone) AND digest IS NOT NULL AND flag IS NOT NULL GROUP BY 1, 2),
  f AS (SELECT digest, flag, value, touched FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY value DESC, flag) AS slot FROM s WHERE value IS NOT NULL) WHERE slot <= 8)"""


def _stored(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "refresh").otherwise("add")
    commands = events.select("event_id", F.col("user_id").alias("digest"), (F.floor("value") % 12).alias("flag"), kind.alias("command"), (1 + F.col("event_id") % 5).alias("value"), t.alias("t"))
    return fuzzystore.apply(commands, "event_id")


@query(f"{_STORE_SQL} SELECT * FROM f")
def fuzzy_storage(spark, sf_dir):
    """The stored set after all adds, refreshes and deletes."""
    return _stored(spark, sf_dir)


#: The time at which entries are expired and how long they live, in seconds.
_NOW, _TTL = 1706745600, 1296000


@query(f"{_STORE_SQL} SELECT flag, count(*) AS digests, sum(value)::BIGINT AS total, max(touched) AS newest FROM f WHERE touched >= {_NOW} - {_TTL} GROUP BY 1")
def fuzzy_storage_counts(spark, sf_dir):
    """What each flag holds once old entries have expired."""
    return fuzzystore.counts(fuzzystore.expire(_stored(spark, sf_dir), _NOW, _TTL))


#: Seconds a row of each archive: a minute, five, ten, an hour.
_STEPS = [60, 300, 600, 3600]


@query(f"""SELECT step, event_type, epoch_us(ts) // (step::BIGINT * 1000000) * step AS slot, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total, max(value) AS most, min(value) AS least, arg_max(value, (ts, event_id)) AS last FROM events, unnest({_STEPS}) u(step) GROUP BY 1, 2, 3""")
def archive_levels(spark, sf_dir):
    """Four archives of different resolution from one scan."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read(spark, sf_dir, "events").withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in _STEPS])))
    slot = (F.floor(us / (F.col("step") * 1_000_000)) * F.col("step")).alias("slot")
    return rows.groupBy("step", "event_type", slot).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.max("value").alias("most"), F.min("value").alias("least"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


_MASKED = "regexp_extract(ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1) || '.0'"
#: Keys of a message under which rates are limited and first sights kept, as SQL text.
KEYS = {
    "ip": "'ip_' || ip", "from": "'from_' || coalesce(env_from, '')", "bounce": "CASE WHEN coalesce(env_from, '') = '' THEN 'bounce_' || ip END", "asn": "'asn_' || asn", "user": "'user_' || user", "to_ip": "'to_ip_' || coalesce(to_addr, '') || '_' || ip",
    "body_key": "md5(substr(coalesce(plain, html, ''), 1, 500) || coalesce(subject, '') || coalesce(to_addr, '') || coalesce(env_from, ''))", "meta_key": f"md5(coalesce(env_from, '') || coalesce(to_addr, '') || {_MASKED})",
}


@query(f"WITH {M_SQL} SELECT doc_id, {', '.join(f'{e.replace("|| user", "|| m.user")} AS k_{n}' for n, e in KEYS.items())} FROM m")
def message_keys(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", *[F.expr(e.replace("|| user", "|| `user`")).alias(f"k_{n}") for n, e in KEYS.items()])


#: A message's numeric features, from 0 to 1 or as counts, as SQL text.
META = {
    "size": "length(coalesce(plain, '')) + length(coalesce(html, ''))", "images": "n_images", "parts": "CASE WHEN plain IS NULL THEN 0 ELSE 1 END + CASE WHEN html IS NULL THEN 0 ELSE 1 END + CASE WHEN file IS NULL THEN 0 ELSE 1 END",
    "encoded": "CASE WHEN lower(coalesce(encoding, '')) IN ('base64', 'quoted-printable') THEN 1 ELSE 0 END", "rcpts": "CASE WHEN n_rcpt < 3 THEN 0.0 WHEN n_rcpt < 10 THEN 0.5 ELSE 1.0 END", "received": "n_received", "secure": "CASE WHEN n_received > 0 THEN n_received_tls / CAST(n_received AS DOUBLE) ELSE 0.0 END",
    "urls": "n_urls", "html_share": "CASE WHEN html IS NULL THEN 0.0 ELSE length(html) / CAST(length(html) + length(coalesce(plain, '')) AS DOUBLE) END",
}


@query(f"WITH {M_SQL} SELECT doc_id, {', '.join(f'round(CAST({e} AS DOUBLE), 6) AS {n}' for n, e in META.items())} FROM m")
def message_vector(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", *[F.round(F.expr(f"CAST({e} AS DOUBLE)"), 6).alias(n) for n, e in META.items()])


@query("SELECT user_id, count(DISTINCT event_type) AS n, array_to_string(list_sort(list(DISTINCT event_type))[1:3], ',') AS options FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1")
def option_sets(spark, sf_dir):
    """The distinct options of each key, counted, and the first three; no key's options are gathered whole."""
    kinds = read(spark, sf_dir, "events").select("user_id", "event_type").dropna().distinct()
    w = Window.partitionBy("user_id")
    first = kinds.select("user_id", "event_type", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("event_type")).alias("r")).filter("r <= 3")
    return first.groupBy("user_id", "n").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("options"))
