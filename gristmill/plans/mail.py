"""Queries over messages. The tables hold none, so a message is made of each document by its id.

The fields are SQL text that both engines read, so that the message table is the
same on both sides; the operators under test then run on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import selectors
from gristmill.operators import mailkeys, mailrules
from gristmill.plans.registry import documents, query


def _pick(n: int, *values: str) -> str:
    """One of the expressions by doc_id modulo ``n``; the last is for all further remainders."""
    return "CASE " + " ".join(f"WHEN doc_id % {n} = {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


_ADDRESS = "'[A-Za-z0-9._+=-]+@[A-Za-z0-9.-]+'"
_SHORT = "substr(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' '), 1, 60)"
_DOM = f"lower(coalesce(source, 'none')) || '.example.' || {_pick(3, chr(39) + 'com' + chr(39), chr(39) + 'org' + chr(39), chr(39) + 'net' + chr(39))}"


def _name(column: str) -> str:
    return f"trim(replace(CASE WHEN {column} LIKE '%<%' THEN regexp_replace({column}, ' ?<[^>]*>$', '') ELSE '' END, '\"', ''))"


#: Fields in layers; each layer may use the columns of those before it.
FIELDS: list[dict[str, str]] = [
    {
        "dom": _DOM,
        "subject": _pick(12, "CAST(NULL AS STRING)", "''", f"translate({_SHORT}, 'abcdefghijklmnopqrstuvwxyz', '{mailrules.CAPITALS}')", f"'Re: ' || {_SHORT} || '?'", f"{_SHORT} || '!'", f"{_SHORT} || ' $9 '", "'=?UTF-8?B?SGVsbG8=?='", "'=?UTF-8?Q?Hello?='", "'see http://x.example.com/a now! ok? yes'", f"'café ' || {_SHORT}", f"{_SHORT} || {_SHORT} || {_SHORT} || {_SHORT}", _SHORT),
        "mid": _pick(9, "CAST(NULL AS STRING)", "'no-brackets'", "'<1234@www.host.example>'", "'<0123ABCD.1@ann>'", "'<12.3@host.example>'", "'<201801011200.x@host.example>'", "'<op.x@host.example>'", "'<a b@host>'", "'<0a1b2c3d-4e5f@host.example>'"),
        "ctype": _pick(14, "'text/plain; charset=utf-8'", "'text/plain'", "'text/html; charset=utf-8'", "'multipart/alternative; boundary=\"b1\"'", "'multipart/mixed; boundary=\"b2\"'", "'multipart/signed; protocol=\"application/pgp-signature\"'", "'multipart/encrypted; protocol=\"application/pgp-encrypted\"'", "'application/pkcs7-mime'", "'text'", "'text/plain; reply-type=original;'", "'multipart/mixed; boundary=\"------------123456789012345678901\"'", "'multipart/signed; protocol=\"application/pkcs7-signature\"'", "CAST(NULL AS STRING)", "'text/plain; charset=us-ascii'"),
        "encoding": _pick(5, "'7bit'", "'8Bit'", "'base64'", "'quoted-printable'", "CAST(NULL AS STRING)"),
        "plain": _pick(7, "CAST(NULL AS STRING)", "''", "text"),
        "html": _pick(6, "CAST(NULL AS STRING)", "'<html><body><p>' || coalesce(text, '') || '</p><a href=\"http://10.0.0.1/x\">https://bank.example</a></body></html>'", "'<p><img src=\"a.png\"><a href=\"http://u@evil.example/.a/\">go</a></p>'", "'<link rel=stylesheet href=\"x.css\"><span style=\"font-size: 0\">' || coalesce(text, '') || '</span><a href=\"https://w.example/wp-content/a.php\">x</a>'", "'<p style=\"color: #fff; background: white\">' || coalesce(text, '') || '</p><a href=\"http://paуpal.example/\">x</a>'", "CAST(NULL AS STRING)"),
        "file": _pick(8, "'invoice.exe.zip'", "'order.scr.rar'", "'notes.txt'", "'data.tar.gz'", "CAST(NULL AS STRING)"),
        "hours": _pick(9, "CAST(NULL AS INT)", "5", "-48", "0"),
        "n_received": "CAST(doc_id % 15 AS INT)",
        "n_received_tls": _pick(3, "CAST(doc_id % 15 AS INT)", "CAST(floor(doc_id % 15 / 2) AS INT)", "0"),
        "last_tls": "doc_id % 2 = 0",
        "helo": _pick(3, "'user'", "'localhost'", "'mx.' || " + _DOM),
        "hostname": _pick(4, "CAST(NULL AS STRING)", "'host' || CAST(doc_id % 50 AS STRING) || '.example.net'"),
        "ip": "'10.' || CAST(doc_id % 7 AS STRING) || '.' || CAST(doc_id % 11 AS STRING) || '.' || CAST(doc_id % 250 AS STRING)",
        "user": _pick(4, "'ann'", "'bob'", "CAST(NULL AS STRING)"),
        "asn": "CAST(64500 + doc_id % 9 AS STRING)",
        "country": _pick(5, "'DE'", "'FR'", "'US'", "'ES'", "CAST(NULL AS STRING)"),
        "queue_id": "'Q' || CAST(doc_id AS STRING)",
        "n_to": "CAST(doc_id * 7 % 60 AS INT)",
    },
    {
        "from_": _pick(10, "'\"Dr. Ann Lee\" <ann@' || dom || '>'", "'bob@' || dom", "'\"bob@corp.example.net\" <carl@' || dom || '>'", "'Ann <ann@' || dom || '>, Bob <bob@' || dom || '>'", "'=?UTF-8?B?QW5u?= <ann@' || dom || '>'", "'Ann<ann@' || dom || '>'", "'Ann  Lee <info@' || dom || '>'", "'Zoé Lee <zoe@gmail.com>'", "CAST(NULL AS STRING)", "'\"http://x.example\" <www-data@www.' || dom || '>'"),
        "to_": _pick(8, "'Recipients <info@' || dom || '>'", "'undisclosed-recipients:;'", "'< ann@' || dom || ' >'", "'\"ann@' || dom || '\" <ann@' || dom || '>'", "CAST(NULL AS STRING)", "'=?UTF-8?Q?Bob?= <bob@corp.example.net>'", "'Zoë <zoe@corp.example.net>'", "'carl@' || dom"),
        "reply_to": _pick(7, "'Mr. X <x@yahoo.com>'", "'broken'", "'ann@' || dom", "'\"Dr. Ann Lee\" <ann@' || dom || '>'", "'root@www.' || dom", "CAST(NULL AS STRING)"),
        "env_from": _pick(8, "'ann@' || dom", "''", "'prvs=12ab=ann@' || dom", "'list+ann=corp.example@' || dom", "'nobody@' || dom", "'bad address'", "CAST(NULL AS STRING)", "'bob@' || dom"),
        "n_to_named": _pick(3, "0", "n_to", "CAST(floor(n_to / 2) AS INT)"),
        "n_to_named_addr": _pick(4, "0", "n_to", "CAST(floor(n_to / 3) AS INT)"),
        "n_rcpt": "n_to",
        "n_to_env": _pick(3, "n_to", "CAST(floor(n_to / 2) AS INT)", "0"),
        "n_urls": "CASE WHEN html LIKE '%href=%' THEN 1 ELSE 0 END",
        "n_images": "CASE WHEN html LIKE '%<img%' THEN 1 ELSE 0 END",
    },
    {
        **{f"{k}_addr": f"regexp_extract({c}, {_ADDRESS}, 0)" for k, c in (("to", "to_"), ("reply", "reply_to"))},
        "from_addr": f"regexp_extract(CASE WHEN from_ LIKE '%<%' THEN regexp_extract(from_, '<[^>]*>', 0) ELSE from_ END, {_ADDRESS}, 0)",
        "from_name": _name("from_"),
        "reply_name": _name("reply_to"),
        "raw": "'X-Id: ' || CAST(doc_id AS STRING) || chr(10)"
        + "".join(f" || CASE WHEN {c} IS NULL THEN '' ELSE '{h}:' || {' ' .join(['CASE WHEN doc_id % 19 = 0 THEN', chr(39) + chr(39), 'ELSE', chr(39) + ' ' + chr(39), 'END'])} || {c} || chr(10) END" for h, c in (("From", "from_"), ("To", "to_"), ("Subject", "subject"), ("Reply-To", "reply_to"), ("Message-ID", "mid"), ("Content-Type", "ctype"), ("Content-Transfer-Encoding", "encoding")))
        + " || CASE WHEN doc_id % 9 = 4 THEN '' ELSE 'Date: x' || chr(10) END || CASE WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 6 = 2 THEN 'Mime-Version: 1.0' || chr(10) ELSE 'MIME-Version: 1.0' || chr(10) END || "
        + _pick(
            23,
            *(
                f"'{line}' || chr(10)"
                for line in (
                    "X-Priority: 0", "X-Priority: 1", "X-Priority: 4", "X-Priority: 7", "Organization: Org", "Content-Description: Mail message body", "X-Originating-IP: 10.0.0.9", "X-Mailer: PHPMailer 5", "X-PHP-Originating-Script: 0:mail.php",
                    "X-PHP-Originating-Script: 1234567:eval()d code", "X-PHP-Script: w.example/.a/x.php for 10.0.0.1", "X-AntiAbuse: yes", "X-Authentication-Warning: host: www-data set sender", "X-mailer: The Bat! 3", "User-Agent: Thunderbird 60", "X-Mailer: SeaMonkey",
                    "X-MSMail-Priority: Normal", "Disposition-Notification-To: x@y.example", "Received: from 10.0.0.1 by 10.0.0.2 helo=localhost with esmtpsa", "Received: from x helo user by strongmail", "List-Unsubscribe: <x>", "Delivered-To: a@b.example", "From: twice@x.example",
                )
            ),
        ),
    },
]
NAMES = ["doc_id", *(n for layer in FIELDS for n in layer)]
MESSAGES_SQL, _before = "documents", ["*"]
for _layer in FIELDS:
    MESSAGES_SQL = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in _layer.items())} FROM {MESSAGES_SQL})"
#: A WITH item that names the messages.
M_SQL = f"m AS (SELECT {', '.join(NAMES)}, lang, text FROM {MESSAGES_SQL})"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for layer in FIELDS:
        rows = rows.withColumns({n: F.expr(e) for n, e in layer.items()})
    return rows.select(*NAMES, "lang", "text")


@query(f"WITH {M_SQL} {mailrules.findings_sql('m', 'doc_id')}")
def mail_rule_findings(spark, sf_dir):
    """Every shipped rule that every message meets."""
    return mailrules.findings(messages(spark, sf_dir), "doc_id")


@query(f"WITH {M_SQL}, f AS ({mailrules.findings_sql('m', 'doc_id')}) SELECT symbol, count(*) AS n, round(sum(score), 4) AS total FROM f GROUP BY 1")
def mail_symbol_totals(spark, sf_dir):
    return mailrules.findings(messages(spark, sf_dir), "doc_id").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {M_SQL}, f AS ({mailrules.findings_sql('m', 'doc_id')}), s AS (SELECT doc_id, count(*) AS n, round(sum(score), 4) AS score FROM f GROUP BY 1) SELECT *, CASE WHEN score >= 15 THEN 'reject' WHEN score >= 6 THEN 'add header' WHEN score >= 4 THEN 'greylist' ELSE 'no action' END AS action FROM s")
def mail_actions(spark, sf_dir):
    scores = mailrules.findings(messages(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))
    return scores.withColumn("action", F.when(F.col("score") >= 15, "reject").when(F.col("score") >= 6, "add header").when(F.col("score") >= 4, "greylist").otherwise("no action"))


@query(f"WITH {M_SQL} {mailkeys.keys_sql('m', 'doc_id')}")
def map_rule_keys(spark, sf_dir):
    """The keys that lookup rules of every type and filter take from the messages."""
    return mailkeys.keys(messages(spark, sf_dir), "doc_id")


#: Entries of maps of all types: type, filter, key, value.
ENTRIES = [
    ("ip", "", "10.3.4.100", "BAD_IP:4.0"), ("from", "", "ann@src1.example.org", "KNOWN_SENDER:-1.5"), ("from", "email:domain", "src2.example.com", "2.5"), ("from", "email:user", "nobody", "SERVICE:1.0:a,b"), ("helo", "", "localhost", "HELO_LOCAL:0.5"), ("rcpt", "email:domain:tld", "example.net", "RCPT_TLD:0.25"),
    ("user", "", "ann", "USER_ANN"), ("url", "host", "10.0.0.1", "URL_IP:3.0"), ("url", "tld", "evil.example", "URL_EVIL:5.0:x"), ("url", "top", "example", "URL_TOP:0.1"), ("url", "path", "/.a/", "HIDDEN:1.0"), ("url", "is_obscured", "evil.example", "OBSCURED:2.0"), ("filename", "extension", "zip", "ZIP:0.3"), ("filename", "", "notes.txt", "NOTES"),
    ("hostname", "", "host7.example.net", "HOST7:1.0"), ("hostname", "hostname:tld", "example.net", "HOST_TLD:0.2"), ("asn", "", "64503", "ASN:0.7"), ("country", "", "fr", "COUNTRY:0.4"), ("received", "ip_addr", "10.1.1.1", "HOP:1.0"), ("mempool", "", "q12", "POOL:1.0"), ("selector", "", "dr. ann lee", "SELECTED:1.0"), ("symbol_options", "", "exclaim", "OPTION:0.6"), ("header", "regexp", "9", "NINE:0.9"), ("email", "email", "zoe@gmail.com", "ZOE:0.2"),
]
_VALUES = ", ".join(f"('{t}', '{f}', '{k}', '{v}')" for t, f, k, v in ENTRIES)


@query(f"""WITH {M_SQL}, k AS ({mailkeys.keys_sql('m', 'doc_id')}), e(type, filter, key, value) AS (VALUES {_VALUES}),
  j AS (SELECT k.doc_id, k.type, k.filter, string_split(value, ':') AS p, TRY_CAST(string_split(value, ':')[1] AS DOUBLE) AS number FROM k JOIN e ON k.type = e.type AND k.filter = e.filter AND lower(k.key) = lower(e.key))
  SELECT doc_id, type, filter, CASE WHEN number IS NULL THEN p[1] ELSE upper(type || '_map') END AS symbol, coalesce(number, TRY_CAST(p[2] AS DOUBLE), 1.0) AS score, coalesce(p[3], '') AS options FROM j""")
def multimap_findings(spark, sf_dir):
    return mailkeys.findings(messages(spark, sf_dir), "doc_id", spark.createDataFrame(ENTRIES, "type string, filter string, key string, value string"))


CLASS_RULES = [
    mailkeys.class_rule(f"RE_{k.upper()}", k, p)
    for k, p in {
        "header": "(?i)lee", "rawheader": "Ann", "allheader": "(?im)^x-mailer:", "mimeheader": "(?i)utf-8", "mime": "(?i)password", "rawmime": "<p>", "url": "[.]example", "email": "(?i)^bob@", "body": "(?i)copyright", "sabody": "(?i)^re:", "sarawbody": "[#%&*$]{3}", "words": "(^| )the( |$)", "rawwords": "(^| )[A-Z]{4,}( |$)", "stemwords": "(^| )[a-z]+ing[^a-z]", "selector": "^dr",
    }.items()
] + [mailkeys.class_rule(f"RE_{k.upper()}_{h.upper()}", k, p, of=h) for k, h, p in (("header", "subject", "^Re: "), ("header", "To", "<bob@"), ("header", "X-Mailer", "[0-9]"), ("mimeheader", "content-type", "^multipart"), ("rawheader", "Subject", "^ [A-Z ]+$"), ("rawheader", "subject", "."))]


@query(f"WITH {M_SQL} {mailrules.findings_sql('m', 'doc_id', CLASS_RULES)}")
def pattern_classes(spark, sf_dir):
    """One rule for each class of texts that patterns are matched against."""
    return mailrules.findings(messages(spark, sf_dir), "doc_id", CLASS_RULES)


TEST_CALLS = [
    ("header_exists", "Organization"), ("raw_header_exists", "Mime-Version"), ("check_smtp_data", "from", "^ann@"), ("check_smtp_data", "helo", "^user$"), ("compare_encoding", "ascii"), ("compare_transfer_encoding", "base64"), ("content_type_is_type", "multipart"), ("content_type_is_subtype", "mixed"), ("content_type_has_param", "boundary"),
    ("content_type_compare_param", "charset", "utf"), ("has_content_part", "text/html"), ("has_content_part_len", "text/plain", 1, 1000), ("has_only_html_part",), ("has_html_tag", "img"), ("has_fake_html",), ("is_html_balanced",), ("is_empty_body",), ("is_recipients_sorted",), ("compare_recipients_distance", 3), ("has_flag", "authenticated"),
]
TEST_RULES = [mailkeys.test_rule(f"{i}:{name}", name, *args) for i, (name, *args) in enumerate(TEST_CALLS)]


@query(f"WITH {M_SQL} {mailrules.findings_sql('m', 'doc_id', TEST_RULES)}")
def message_tests(spark, sf_dir):
    """The functions that expressions may call on a message."""
    return mailrules.findings(messages(spark, sf_dir), "doc_id", TEST_RULES)


_URLS = "coalesce(regexp_extract_all(html, 'href=\"([^\">]*)', 1), [])"
#: Selector and the SQL of its value.
SELECTORS = {
    "ip": "ip", "from('smtp'):lower": "lower(coalesce(env_from, ''))", "from('mime')": "coalesce(from_addr, '')", "rcpts.first": "coalesce(to_addr, '')", "to": "coalesce(to_addr, '')", "country": "coalesce(country, '')", "asn": "asn", "user": "coalesce(user, '')", "helo": "helo", "header('Organization')": r"regexp_extract(raw, '(?im)^Organization:[ ]*([^\n]*)', 1)",
    "header('Mime-Version', 'strong')": r"regexp_extract(raw, '(?m)^Mime-Version:[ ]*([^\n]*)', 1)", "attachments.first": "coalesce(md5(file), '')", "files.first": "coalesce(file, '')", "languages.first": "coalesce(lang, '')", "received_count": "n_received::VARCHAR", "received": "CASE WHEN n_received > 0 THEN ip ELSE '' END",
    "urls.join(' ')": f"array_to_string({_URLS}, ' ')", "specific_urls.len": f"len(list_distinct({_URLS}))::VARCHAR", "urls_filtered('https').len": f"len(list_filter({_URLS}, lambda x: starts_with(x, 'https')))::VARCHAR", "emails.len": "len(coalesce(regexp_extract_all(from_, '[A-Za-z0-9._+=-]+@[A-Za-z0-9.-]+', 0), []))::VARCHAR", "pool_var('queue_id')": "queue_id",
    "request_header('X-Priority')": r"regexp_extract(raw, '(?im)^X-Priority:[ ]*([^\n]*)', 1)", "time": "coalesce(hours::VARCHAR, '')", "queueid": "queue_id", "uid": "md5(queue_id)", "messageid": "coalesce(mid, '')", "digest": "md5(coalesce(plain, '') || coalesce(html, ''))", "fuzzy_digest": "md5(coalesce(plain, ''))", "authenticated": "CASE WHEN user IS NOT NULL THEN 'true' ELSE '' END", "words.len": "len(regexp_extract_all(lower(coalesce(plain, '')), '[a-z0-9]+', 0))::VARCHAR",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"WITH {M_SQL} {' UNION ALL '.join(f'SELECT doc_id, {_quoted(k)} AS selector, {v} AS value FROM m' for k, v in SELECTORS.items())}")
def message_selectors(spark, sf_dir):
    """Every extractor of the selector language over messages."""
    values = [F.struct(F.lit(s).alias("selector"), F.coalesce(selectors.combine(s, "", mailkeys.EXTRACTORS), F.lit("")).alias("value")) for s in SELECTORS]
    return messages(spark, sf_dir).select("doc_id", F.explode(F.array(*values)).alias("v")).select("doc_id", "v.selector", "v.value")
