"""Rule sets of further checks over messages, and policies that turn verdicts into findings and actions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.mailrules import ARCHIVE, EXECUTABLE, MailRule, _match, _plain, _present
from gristmill.operators.maps import small

#: The test text that must always be found, and top-level domains that deserve a look.
TEST_TEXT = "XJS[*]C4JDBQADN1[.]NSBN3[*]2IDNEN[*]GTUBE-STANDARD-ANTI-UBE-TEST-EMAIL[*]C[.]34X"
DOUBTFUL_TLDS = "tk|ml|ga|cf|gq|top|xyz"
_LINK = "(?i)href=[\\x22]?https?://"

RULES: list[MailRule] = [
    _match("GTUBE", 0.0, "plain", TEST_TEXT),
    # hops and lists
    _plain("ONCE_RECEIVED", 0.1, "n_received = 1"),
    _plain("ONCE_RECEIVED_STRICT", 4.0, "n_received = 1 AND (hostname IS NULL OR hostname LIKE '%dynamic%' OR hostname LIKE 'host%')"),
    _plain("DIRECT_TO_MX", 0.0, "n_received = 0"),
    MailRule("MAILLIST", -0.2, lambda d: f"{d.h('List-Unsubscribe')} OR {d.h('List-Id')} OR {d.h('Mailing-List')}"),
    MailRule("KNOWN_NO_MID", 0.0, lambda d: f"mid IS NULL AND {d.m('from_addr', '(?i)@src[0-9]+[.]example[.]com$')}"),
    # greeting and host
    _match("HFILTER_HELO_BAREIP", 3.0, "helo", "^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$"),
    _match("HFILTER_HELO_NOT_FQDN", 2.0, "helo", "^[^.]+$"),
    _match("HFILTER_HELO_LOCAL", 3.0, "helo", "(?i)^(localhost|local|localdomain)$"),
    _plain("HFILTER_HOSTNAME_UNKNOWN", 2.5, "hostname IS NULL"),
    _match("HFILTER_HOSTNAME_DYNAMIC", 1.0, "hostname", "(?i)(dyn|dsl|pool|host)[0-9-]+[.]"),
    _plain("HFILTER_URL_ONLY", 2.2, "n_urls > 0 AND coalesce(length(plain), 0) < 10"),
    # attachments
    _match("MIME_BAD_EXTENSION", 2.0, "file", f"(?i)[.]({EXECUTABLE})$"),
    _match("MIME_DOUBLE_BAD_EXTENSION", 3.0, "file", f"(?i)[.][a-z0-9]{{2,4}}[.]({EXECUTABLE})$"),
    _match("MIME_BAD_EXTENSION_IN_ARCHIVE", 3.0, "file", f"(?i)[.]({EXECUTABLE})[.]({ARCHIVE})$"),
    _match("MIME_ARCHIVE_IN_ARCHIVE", 5.0, "file", f"(?i)[.]({ARCHIVE})[.]({ARCHIVE})$"),
    _match("MIME_GOOD", -0.1, "ctype", "(?i)^(multipart/alternative|text/plain)"),
    # addresses
    _match("SPAMTRAP", 1.0, "to_addr", "(?i)^(trap|carl)@"),
    _plain("FORGED_RECIPIENTS", 2.0, "n_rcpt > 0 AND n_to_env < n_rcpt"),
    _plain("FORGED_SENDER", 0.3, "from_addr <> '' AND env_from <> '' AND lower(from_addr) <> lower(env_from)"),
    _present("FORGED_RECIPIENTS_MAILLIST", 0.0, "List-Unsubscribe"),
    # links
    _match("URL_USER_PASSWORD", 2.0, "html", _LINK + "[^/>\\x22]*@"),
    _match("URL_NUMERIC_IP", 1.5, "html", _LINK + "([^/>\\x22]*@)?[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+[/:\\x22]"),
    _match("URL_PRIVATE_IP", 0.5, "html", _LINK + "(10[.]|192[.]168[.]|127[.])[0-9.]+[/:\\x22]"),
    _match("URL_NO_TLD", 2.0, "html", _LINK + "[^/.>\\x22]+[/:\\x22]"),
    _match("URL_SUSPICIOUS_TLD", 3.0, "html", _LINK + f"[^/>\\x22]+[.]({DOUBTFUL_TLDS})[/:\\x22]"),
    _match("URL_MULTIPLE_AT", 3.0, "html", _LINK + "[^/>\\x22]*@[^/>\\x22]*@"),
    _match("URL_BACKSLASH_PATH", 2.0, "html", _LINK + "[^>\\x22]*\\\\\\\\"),
    _match("URL_EXCESSIVE_DOTS", 2.0, "html", _LINK + "[^/.>\\x22]*[.][^/.>\\x22]*[.][^/.>\\x22]*[.][^/.>\\x22]*[.][^/.>\\x22]*[.][^/.>\\x22]*[.]"),
    _match("URL_VERY_LONG", 1.5, "html", _LINK + "[^>\\x22]{500,}"),
    _match("URL_HAS_PORT", 0.5, "html", _LINK + "[^/>\\x22]+:[0-9]+[/\\x22]"),
]


def listed_senders(messages: DataFrame, id_col: str, lists: DataFrame) -> DataFrame:
    """(id_col, symbol, score): senders on a list of domains, judged by their SPF and DKIM verdicts.

    ``messages`` has from_addr and the verdicts spf_ok and dkim_ok; ``lists`` has
    domain, kind (wl, bl or both), checks (spf, dkim or both) and score. A listed
    domain whose checks hold is whitelisted, one whose checks fail blacklisted.
    """
    rows = messages.withColumn("domain", F.lower(F.regexp_extract("from_addr", "@([^@]*)$", 1))).join(small(lists), "domain")
    good = F.when(F.col("checks") == "spf", F.col("spf_ok")).when(F.col("checks") == "dkim", F.col("dkim_ok")).otherwise(F.col("spf_ok") & F.col("dkim_ok"))
    rows = rows.withColumn("good", good).filter((F.col("good") & F.col("kind").isin("wl", "both")) | (~F.col("good") & F.col("kind").isin("bl", "both")))
    return rows.select(id_col, F.concat(F.when(F.col("good"), "WHITELIST_").otherwise("BLACKLIST_"), F.upper("checks")).alias("symbol"), F.when(F.col("good"), -F.col("score")).otherwise(F.col("score")).alias("score"))


def aligned_policy(messages: DataFrame, id_col: str, policies: DataFrame) -> DataFrame:
    """(id_col, domain, result, disposition) by published policies: a join over given verdicts.

    ``messages`` has from_addr, spf_ok, spf_domain, dkim_ok, dkim_domain and share
    (0 to 99); ``policies`` has domain, policy (none, quarantine, reject), strict
    and pct. A message passes if a check holds and its domain is aligned: equal,
    or, unless strict, below the policy's domain.
    """
    domain = F.lower(F.regexp_extract("from_addr", "@([^@]*)$", 1))
    rows = messages.withColumn("domain", domain).join(small(policies), "domain")

    def aligned(other: Column) -> Column:
        return (other == F.col("domain")) | (~F.col("strict") & F.endswith(other, F.concat(F.lit("."), F.col("domain"))))

    passes = (F.col("spf_ok") & aligned(F.col("spf_domain"))) | (F.col("dkim_ok") & aligned(F.col("dkim_domain")))
    applied = F.col("share") < F.col("pct")
    softer = F.when(F.col("policy") == "reject", "quarantine").otherwise("none")
    return rows.select(id_col, "domain", F.when(passes, "pass").otherwise("fail").alias("result"), F.when(passes, "none").when(applied, F.col("policy")).otherwise(softer).alias("disposition"))


class Force(NamedTuple):
    """An action for messages with all of some symbols and none of others."""

    action: str
    every: tuple[str, ...]
    none: tuple[str, ...] = ()


def forced_actions(findings: DataFrame, id_col: str, forces: list[Force]) -> DataFrame:
    """(id_col, score, action): the first forced action that fits, else that of the score.

    ``findings`` has symbol and score; the symbols that matter are counted as they
    are summed, so one aggregation does for all.
    """
    names = sorted({s for f in forces for s in f.every + f.none})
    held = findings.groupBy(id_col).agg(F.round(F.sum("score"), 4).alias("score"), *[F.count_if(F.col("symbol") == s).alias(f"has_{i}") for i, s in enumerate(names)])
    has = {s: F.col(f"has_{i}") > 0 for i, s in enumerate(names)}

    def fits(f: Force) -> Column:
        out = F.lit(True)
        for s in f.every:
            out &= has[s]
        for s in f.none:
            out &= ~has[s]
        return out

    by_score = F.when(F.col("score") >= 15, "reject").when(F.col("score") >= 6, "add header").when(F.col("score") >= 4, "greylist").otherwise("no action")
    return held.select(id_col, "score", F.coalesce(*[F.when(fits(f), F.lit(f.action)) for f in forces], by_score).alias("action"))
