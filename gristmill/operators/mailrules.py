"""Symbol rules over messages: header, address, structure, content and transport checks.

A message is one row with the columns of ``COLUMNS``; ``raw`` is its header block,
one ``Name: value`` a line. Every rule is one predicate, written once as SQL text
in which ``m(column, pattern)`` and ``h(header, pattern)`` stand for a match, and
compiled to a Catalyst expression, so a rule set is one pass over the messages
without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = {
    "raw": "header block", "subject": "decoded or null", "from_": "From as written", "from_addr": "its address", "from_name": "its display name", "to_": "To as written", "to_addr": "first recipient's address",
    "n_to": "recipients in headers", "n_to_named": "those with a display name", "n_to_named_addr": "those named by their own address", "n_to_env": "those in the envelope", "n_rcpt": "recipients of the envelope",
    "reply_to": "as written or null", "reply_addr": "its address", "reply_name": "its display name", "env_from": "envelope sender", "helo": "HELO", "hostname": "reverse name", "ip": "source address",
    "mid": "Message-ID", "n_received": "hops", "n_received_tls": "encrypted hops", "last_tls": "last hop encrypted", "hours": "Date minus arrival in hours or null", "ctype": "Content-Type as written", "encoding": "transfer encoding",
    "plain": "text part or null", "html": "HTML part or null", "file": "attachment name or null", "n_urls": "links", "n_images": "images",
}

#: Titles, freemail domains, service accounts, executable and archive suffixes.
TITLES = "mr|mrs|ms|dr|prof"
FREEMAIL = "gmail.com|yahoo.com|hotmail.com|outlook.com|aol.com|mail.ru|gmx.de|proton.me"
SERVICE = "www-data|anonymous|ftp|apache|nobody|guest|nginx|web|www|mysql|root"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EXECUTABLE, ARCHIVE = "exe|scr|com|bat|pif|lnk|vbs|jar", "zip|rar|7z|iso|arj|cab|gz"


class Dialect(NamedTuple):
    """How a match of a regular expression is written, and whether lists join by ``array_to_string``."""

    match: Callable[[str, str], str]
    arrays: bool = False

    def m(self, column: str, pattern: str) -> str:
        return self.match(column, pattern)

    def h(self, name: str, pattern: str = "") -> str:
        return self.match("raw", f"(?im)^{name}:[ ]*{pattern}")


SPARK = Dialect(lambda c, p: f"coalesce(regexp_like({c}, r'{p}'), false)")
#: The same for engines whose literals take backslashes as they are.
ANSI = Dialect(lambda c, p: f"coalesce(regexp_matches({c}, '{p}'), false)", True)


class MailRule(NamedTuple):
    symbol: str
    score: float
    predicate: Callable[[Dialect], str]


def _present(symbol: str, score: float, header: str, pattern: str = "") -> MailRule:
    return MailRule(symbol, score, lambda d: d.h(header, pattern))


def _missing(symbol: str, score: float, header: str) -> MailRule:
    return MailRule(symbol, score, lambda d: f"NOT {d.h(header)}")


def _match(symbol: str, score: float, column: str, pattern: str) -> MailRule:
    return MailRule(symbol, score, lambda d: d.m(column, pattern))


def _plain(symbol: str, score: float, sql: str) -> MailRule:
    return MailRule(symbol, score, lambda d: f"coalesce({sql}, false)")


def _count(prefix: str, column: str, bounds: list[tuple[str, int, int]]) -> list[MailRule]:
    return [_plain(f"{prefix}_{name}", 0.0, f"{column} >= {lo} AND {column} < {hi}") for name, lo, hi in bounds]


def _domain(column: str) -> str:
    return f"lower(substr({column}, length(regexp_replace({column}, '@[^@]*$', '')) + 2))"


def _same_domain(a: str, b: str, same: bool = True) -> str:
    return f"{_domain(a)} {'=' if same else '<>'} {_domain(b)}"


_MUA = [("THEBAT", "The Bat!", "[0-9]+[.][0-9]+@"), ("KMAIL", "KMail", "[0-9]{12}[.]"), ("OPERA", "Opera Mail", "op[.]"), ("MOZILLA_MAIL", "Mozilla", "[0-9A-F]{8}[.]"), ("THUNDERBIRD", "Thunderbird", "[0-9a-f-]{8,}[.]?"), ("SEAMONKEY", "SeaMonkey", "[0-9A-F]{8}[.]"), ("POSTBOX", "Postbox", "[0-9A-F]{8}[.]")]


def _forged_mua(name: str, mailer: str, shape: str) -> list[MailRule]:
    """A mailer that names itself, but whose Message-ID has not the shape it makes; UNKNOWN: no Message-ID in brackets at all."""
    claims = f"(X-Mailer|User-Agent):[^\\n]*{mailer}"
    return [
        MailRule(f"FORGED_MUA_{name}_MSGID", 4.0, lambda d: f"{d.m('raw', '(?im)^' + claims)} AND {d.m('mid', '^<[^>]+>$')} AND NOT {d.m('mid', '^<' + shape)}"),
        MailRule(f"FORGED_MUA_{name}_MSGID_UNKNOWN", 2.5, lambda d: f"{d.m('raw', '(?im)^' + claims)} AND mid IS NOT NULL AND NOT {d.m('mid', '^<[^>]+>$')}"),
    ]


def _excess(prefix: str, header: str) -> list[MailRule]:
    """Encoded words that hold nothing but plain ASCII letters."""
    return [_present(f"{prefix}_EXCESS_BASE64", 1.5, header, "[^\\n]*=[?][^?\\n]*[?]B[?][A-Za-z0-9+/]*={0,2}[?]="), _present(f"{prefix}_EXCESS_QP", 1.2, header, "[^\\n]*=[?][^?\\n]*[?]Q[?][A-Za-z0-9_]*[?]=")]


RULES: list[MailRule] = [
    # hops
    *_count("RCVD_COUNT", "n_received", [("ZERO", 0, 1), ("ONE", 1, 2), ("TWO", 2, 3), ("THREE", 3, 5), ("FIVE", 5, 7), ("SEVEN", 7, 12), ("TWELVE", 12, 1_000_000)]),
    _plain("RCVD_TLS_ALL", 0.0, "n_received > 0 AND n_received_tls = n_received"),
    _plain("RCVD_TLS_LAST", 0.0, "n_received > 0 AND last_tls"),
    _plain("RCVD_NO_TLS_LAST", 0.1, "n_received > 0 AND NOT last_tls"),
    _present("RCVD_VIA_SMTP_AUTH", 0.0, "Received", "[^\\n]*with esmtps?a"),
    _present("RCVD_HELO_USER", 3.0, "Received", "[^\\n]*helo[= ]user"),
    _present("RECEIVED_HELO_LOCALHOST", 0.0, "Received", "[^\\n]*helo[= ]localhost"),
    _present("RCVD_DOUBLE_IP_SPAM", 2.0, "Received", "from [\\x5B]?[0-9.]+[\\x5D]? by [\\x5B]?[0-9.]+"),
    _plain("RDNS_NONE", 2.0, "hostname IS NULL OR hostname = ''"),
    # priority
    *[_present(f"HAS_X_PRIO_{name}", 0.0, "X-Priority", f"[{digits}]") for name, digits in (("ZERO", "0"), ("ONE", "1"), ("TWO", "2"), ("THREE", "34"), ("FIVE", "5-9"))],
    # reply address
    _present("HAS_REPLYTO", 0.0, "Reply-To"),
    _plain("REPLYTO_UNPARSEABLE", 1.0, "reply_to <> '' AND reply_addr = ''"),
    _plain("REPLYTO_EQ_FROM", 0.0, "reply_to = from_"),
    _plain("REPLYTO_ADDR_EQ_FROM", 0.0, "reply_to <> from_ AND lower(reply_addr) = lower(env_from)"),
    _plain("REPLYTO_DOM_EQ_FROM_DOM", 0.0, f"reply_addr <> '' AND from_addr <> '' AND {_same_domain('reply_addr', 'from_addr')}"),
    _plain("REPLYTO_DOM_NEQ_FROM_DOM", 0.0, f"reply_addr <> '' AND from_addr <> '' AND {_same_domain('reply_addr', 'from_addr', False)}"),
    _plain("REPLYTO_DN_EQ_FROM_DN", 0.0, "reply_name <> '' AND lower(reply_name) = lower(from_name)"),
    _match("REPLYTO_EMAIL_HAS_TITLE", 2.0, "reply_name", f"(?i)^({TITLES})[. ]"),
    _plain("REPLYTO_EQ_TO_ADDR", 5.0, "reply_addr <> '' AND lower(reply_addr) = lower(to_addr)"),
    _plain("REPLYTO_DOM_EQ_TO_DOM", 0.0, f"reply_addr <> '' AND to_addr <> '' AND {_same_domain('reply_addr', 'to_addr')}"),
    _plain("REPLYTO_DOM_NEQ_TO_DOM", 0.0, f"reply_addr <> '' AND to_addr <> '' AND {_same_domain('reply_addr', 'to_addr', False)}"),
    MailRule("REPLYTO_INVALID", 1.0, lambda d: f"coalesce(reply_addr <> '', false) AND NOT ({d.m('reply_addr', '^[A-Za-z0-9._+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*[.][A-Za-z0-9.-]*[A-Za-z0-9-]$')} AND NOT {d.m('reply_addr', '@.*[.][.]')})"),
    _match("REPLYTO_LOCALPART_LONG", 2.0, "reply_addr", "^[^@]{65,}@"),
    _match("REPLYTO_DOMAIN_LONG", 2.0, "reply_addr", "@[^@]{256,}$"),
    MailRule("FREEMAIL_REPLYTO_NEQ_FROM_DOM", 3.0, lambda d: f"{d.m('reply_addr', f'(?i)@({FREEMAIL})$')} AND {d.m('from_addr', f'(?i)@({FREEMAIL})$')} AND {_same_domain('reply_addr', 'from_addr', False)}"),
    _plain("SPOOF_REPLYTO", 6.0, f"reply_addr <> '' AND to_addr <> '' AND {_same_domain('from_addr', 'to_addr')} AND {_same_domain('reply_addr', 'from_addr', False)}"),
    # sender
    _missing("MISSING_FROM", 2.0, "From"),
    _match("MULTIPLE_FROM", 8.0, "from_", "@[^,]*,[^,]*@"),
    _plain("FROM_NO_DN", 0.0, "from_addr <> '' AND from_name = ''"),
    _plain("FROM_HAS_DN", 0.0, "from_addr <> '' AND from_name <> '' AND lower(from_name) <> lower(from_addr)"),
    _plain("FROM_DN_EQ_ADDR", 1.0, "from_addr <> '' AND lower(from_name) = lower(from_addr)"),
    _match("FROM_NAME_EXCESS_SPACE", 1.0, "from_name", "  "),
    _match("FROM_NAME_HAS_TITLE", 1.0, "from_name", f"(?i)^({TITLES})[. ]"),
    _plain("FROM_EQ_ENVFROM", 0.0, "lower(from_addr) = lower(env_from)"),
    _plain("FROM_NEQ_ENVFROM", 0.0, "from_addr <> '' AND env_from <> '' AND lower(from_addr) <> lower(env_from)"),
    _plain("TO_EQ_FROM", 0.0, "from_addr <> '' AND lower(from_addr) = lower(to_addr)"),
    _plain("TO_DOM_EQ_FROM_DOM", 0.0, f"from_addr <> '' AND to_addr <> '' AND {_same_domain('from_addr', 'to_addr')}"),
    MailRule("ENVFROM_INVALID", 2.0, lambda d: f"coalesce(env_from <> '', false) AND NOT {d.m('env_from', '^[^@ ]+@[^@ ]+[.][^@ ]+$')}"),
    MailRule("FROM_INVALID", 2.0, lambda d: f"coalesce(from_ <> '', false) AND NOT {d.m('from_addr', '^[^@ ]+@[^@ ]+[.][^@ ]+$')}"),
    _match("ENVFROM_PRVS", 0.0, "env_from", "(?i)^prvs="),
    _match("ENVFROM_VERP", 0.0, "env_from", "^[^@]+[+=-][^@]+=[^@]+@"),
    _match("ENVFROM_SERVICE_ACCT", 1.0, "env_from", f"(?i)^({SERVICE})@"),
    MailRule("FROM_SERVICE_ACCT", 1.0, lambda d: f"{d.m('from_addr', f'(?i)^({SERVICE})@')} OR {d.m('reply_addr', f'(?i)^({SERVICE})@')}"),
    MailRule("WWW_DOT_DOMAIN", 0.5, lambda d: " OR ".join(d.m(c, "(?i)@www[.]") for c in ("from_addr", "reply_addr", "env_from"))),
    _match("R_HTTP_URL_IN_FROM", 5.0, "from_", "(?i)(^|[\\x22 ])https?(:|%3A)//"),
    _match("R_NO_SPACE_IN_FROM", 1.0, "from_", "[^ <]<[^ >]+@"),
    _match("FROM_NEEDS_ENCODING", 1.0, "from_", "[^\\x00-\\x7F]"),
    _match("TO_NEEDS_ENCODING", 1.0, "to_", "[^\\x00-\\x7F]"),
    _match("SUBJECT_NEEDS_ENCODING", 1.0, "subject", "[^\\x00-\\x7F]"),
    _match("INVALID_FROM_8BIT", 0.5, "from_addr", "[^\\x00-\\x7F]"),
    _match("INVALID_RCPT_8BIT", 0.5, "to_addr", "[^\\x00-\\x7F]"),
    MailRule("FROM_NEQ_DISPLAY_NAME", 4.0, lambda d: f"{d.m('from_name', '[^ ]+@[^ ]+')} AND lower(from_name) <> lower(from_addr)"),
    MailRule("SPOOF_DISPLAY_NAME", 8.0, lambda d: f"{d.m('from_name', '[^ ]+@[^ ]+')} AND {_same_domain('from_name', 'to_addr')} AND {_same_domain('from_addr', 'to_addr', False)}"),
    MailRule("INFO_TO_INFO_LU", 2.0, lambda d: f"{d.m('from_addr', '(?i)^info@')} AND {d.m('to_addr', '(?i)^info@')} AND {d.h('List-Unsubscribe')}"),
    *[r for p, h in (("FROM", "From"), ("TO", "To"), ("REPLYTO", "Reply-To"), ("CC", "Cc"), ("SUBJ", "Subject")) for r in _excess(p, h)],
    # recipients
    *_count("RCPT_COUNT", "n_to", [("ZERO", 0, 1), ("ONE", 1, 2), ("TWO", 2, 3), ("THREE", 3, 5), ("FIVE", 5, 7), ("SEVEN", 7, 12), ("TWELVE", 12, 51), ("GT_50", 51, 1_000_000)]),
    _match("TO_DN_RECIPIENTS", 2.0, "to_", "(?i)^[\\x22]?recipients[\\x22]? *<"),
    _plain("TO_DN_NONE", 0.0, "n_to > 0 AND n_to_named = 0"),
    _plain("TO_DN_ALL", 0.0, "n_to > 0 AND n_to_named = n_to"),
    _plain("TO_DN_SOME", 0.0, "n_to_named > 0 AND n_to_named < n_to"),
    _plain("TO_DN_EQ_ADDR_ALL", 0.0, "n_to > 0 AND n_to_named_addr = n_to"),
    _plain("TO_DN_EQ_ADDR_SOME", 0.0, "n_to_named_addr > 0 AND n_to_named_addr < n_to"),
    _plain("TO_MATCH_ENVRCPT_ALL", 0.0, "n_to > 0 AND n_to_env = n_rcpt"),
    _plain("TO_MATCH_ENVRCPT_SOME", 0.0, "n_to_env > 0 AND n_to_env < n_rcpt"),
    _missing("MISSING_TO", 2.0, "To"),
    _match("R_UNDISC_RCPT", 3.0, "to_", "(?i)undisclosed[ -]?recipients"),
    _match("TO_WRAPPED_IN_SPACES", 2.0, "to_", "< [^>]+ >"),
    # subject
    _missing("MISSING_SUBJECT", 2.0, "Subject"),
    _plain("EMPTY_SUBJECT", 1.0, "subject = ''"),
    _plain("LONG_SUBJ", 3.0, "length(subject) > 200"),
    MailRule("SUBJ_ALL_CAPS", 3.0, lambda d: f"coalesce(length(subject) - length(translate(subject, '{CAPITALS}', '')) > 6, false) AND NOT {d.m('subject', '[a-z]')}"),
    _match("URL_IN_SUBJECT", 4.0, "subject", "(?i)https?://[^ ]+"),
    _match("SUBJECT_ENDS_EXCLAIM", 0.0, "subject", "! *$"),
    _match("SUBJECT_HAS_EXCLAIM", 0.0, "subject", "![^!]*[^! ]"),
    _match("SUBJECT_ENDS_QUESTION", 1.0, "subject", "[?] *$"),
    _match("SUBJECT_HAS_QUESTION", 0.0, "subject", "[?][^?]*[^? ]"),
    _match("SUBJECT_HAS_CURRENCY", 1.0, "subject", "[$€£¥₽]"),
    _match("SUBJECT_ENDS_SPACES", 0.5, "subject", " $"),
    MailRule("FAKE_REPLY", 1.0, lambda d: f"{d.m('subject', '(?i)^re:')} AND NOT {d.h('In-Reply-To')} AND NOT {d.h('References')}"),
    MailRule("BOUNCE", 0.0, lambda d: f"{d.m('subject', '(?i)(undeliver|delivery (status|failure)|returned mail)')} AND coalesce(env_from = '', true)"),
    # date and id
    _missing("MISSING_DATE", 1.0, "Date"),
    MailRule("INVALID_DATE", 1.5, lambda d: f"{d.h('Date')} AND hours IS NULL"),
    _plain("DATE_IN_FUTURE", 4.0, "hours > 2"),
    _plain("DATE_IN_PAST", 1.0, "hours < -24"),
    _missing("MISSING_MID", 2.5, "Message-ID"),
    MailRule("INVALID_MSGID", 1.7, lambda d: f"mid IS NOT NULL AND NOT {d.m('mid', '^<[^<> @]+@[^<> @]+>$')}"),
    _match("MID_RHS_WWW", 0.5, "mid", "(?i)@www[.]"),
    _plain("MID_END_EQ_FROM_USER_PART", 4.0, "from_addr <> '' AND mid LIKE '%@' || regexp_replace(from_addr, '@[^@]*$', '') || '>'"),
    # header habits
    _present("MV_CASE", 0.5, "(?-i:Mime-Version)"),
    _present("XM_CASE", 0.5, "(?-i:X-mailer)"),
    _present("CTE_CASE", 0.5, "Content-Transfer-Encoding", "(?-i:[78]Bit)"),
    _present("CT_EXTRA_SEMI", 1.0, "Content-Type", "[^\\n]*; *$"),
    _present("HAS_ORG_HEADER", 0.0, "Organi[sz]ation"),
    _present("HAS_CD_HEADER", 0.0, "Content-Description"),
    _present("CD_MM_BODY", 2.0, "Content-Description", "Mail message body"),
    _present("HAS_XOIP", 0.0, "X-Originating-IP"),
    _present("PREVIOUSLY_DELIVERED", 0.0, "Delivered-To"),
    _present("HAS_PHPMAILER_SIG", 0.0, "X-Mailer", "PHPMailer"),
    _present("HAS_X_POS", 0.0, "X-PHP-Originating-Script"),
    _present("PHP_SCRIPT_ROOT", 1.0, "X-PHP-Originating-Script", "0:"),
    _present("X_PHP_EVAL", 4.0, "X-PHP-Originating-Script", "[^\\n]*eval[(][)]"),
    _present("X_PHPOS_FAKE", 3.0, "X-PHP-Originating-Script", "[0-9]{7}:"),
    _present("X_PHP_FORGED_0X", 4.0, "X-PHP-Originating-Script", "0[0-9]+:"),
    _present("HAS_X_PHP_SCRIPT", 0.0, "X-PHP-Script"),
    _present("PHP_XPS_PATTERN", 0.0, "X-PHP-Script", "[^\\n]*[.]php for "),
    _present("HAS_X_SOURCE", 0.0, "X-Source"),
    _present("HIDDEN_SOURCE_OBJ", 2.0, "X-(PHP-Script|Source-Args|Source-Dir)", "[^\\n]*/[.][a-z]"),
    _present("HAS_X_AS", 0.0, "X-Authenticated-Sender"),
    _present("HAS_X_GMSV", 0.0, "X-Get-Message-Sender-Via"),
    _present("HAS_X_ANTIABUSE", 0.0, "X-AntiAbuse"),
    _present("HAS_XAW", 0.0, "X-Authentication-Warning"),
    _present("XAW_SERVICE_ACCT", 1.0, "X-Authentication-Warning", f"[^\\n]*({SERVICE}) set sender"),
    _present("HAS_INTERSPIRE_SIG", 1.0, "X-Mailer-LID"),
    _present("MAIL_RU_MAILER", 0.0, "X-Mailer", "Mail[.]Ru"),
    _present("YANDEX_RU_MAILER", 0.0, "X-Mailer", "Yamail"),
    _present("MAILER_1C_8", 0.0, "X-Mailer", "1C:Enterprise 8"),
    _present("STRONGMAIL", 6.0, "Received", "[^\\n]*strongmail"),
    _present("STOX_REPLY_TYPE", 1.0, "Content-Type", "[^\\n]*reply-type="),
    MailRule("MISSING_MIMEOLE", 2.0, lambda d: f"{d.h('X-MSMail-Priority')} AND NOT {d.h('X-MimeOLE')}"),
    *[MailRule(f"HEADER_{n}_EMPTY_DELIMITER", 1.0, lambda d, h=h: d.m("raw", f"(?im)^{h}:[^ \\n]")) for n, h in (("FROM", "From"), ("TO", "To"), ("CC", "Cc"), ("REPLYTO", "Reply-To"), ("DATE", "Date"))],
    *[r for m in _MUA for r in _forged_mua(*m)],
    MailRule("MULTIPLE_UNIQUE_HEADERS", 7.0, lambda d: " OR ".join(d.m("raw", f"(?is)(^|\\n){n}:(.*)\\n{n}:") for n in ("Date", "From", "To", "Subject", "Message-ID", "Reply-To"))),
    MailRule("MISSING_ESSENTIAL_HEADERS", 7.0, lambda d: " AND ".join(f"NOT {d.h(n)}" for n in ("From", "To", "Subject", "Date", "Message-ID"))),
    MailRule("HEADER_RCONFIRM_MISMATCH", 2.0, lambda d: f"{d.h('X-Confirm-Reading-To')} AND NOT coalesce(raw LIKE '%X-Confirm-Reading-To: ' || from_addr || '%', false)"),
    MailRule("HEADER_FORGED_MDN", 2.0, lambda d: f"{d.h('Disposition-Notification-To')} AND NOT coalesce(raw LIKE '%Disposition-Notification-To: ' || env_from || '%', false)"),
    # structure
    MailRule("MISSING_MIME_VERSION", 2.0, lambda d: f"{d.m('ctype', '(?i)^multipart/')} AND NOT {d.h('MIME-Version')}"),
    MailRule("MIME_HEADER_CTYPE_ONLY", 2.0, lambda d: f"{d.h('Content-Type')} AND NOT {d.h('MIME-Version')} AND NOT {d.h('Content-Transfer-Encoding')}"),
    MailRule("MIME_MA_MISSING_TEXT", 2.0, lambda d: f"{d.m('ctype', '(?i)^multipart/alternative')} AND plain IS NULL"),
    MailRule("MIME_MA_MISSING_HTML", 1.0, lambda d: f"{d.m('ctype', '(?i)^multipart/alternative')} AND html IS NULL"),
    MailRule("CTYPE_MIXED_BOGUS", 1.0, lambda d: f"{d.m('ctype', '(?i)^multipart/mixed')} AND file IS NULL"),
    MailRule("R_MISSING_CHARSET", 0.5, lambda d: f"{d.m('ctype', '(?i)^text/')} AND NOT {d.m('ctype', '(?i)charset=')}"),
    _match("BROKEN_CONTENT_TYPE", 1.5, "ctype", "^[^/;]*(;|$)"),
    _match("SUSPICIOUS_BOUNDARY", 5.0, "ctype", "(?i)boundary=[\\x22]?-{10,}[0-9]{18,}"),
    _plain("MIME_BASE64_TEXT", 0.1, "plain IS NOT NULL AND lower(encoding) = 'base64'"),
    MailRule("MIME_BASE64_TEXT_BOGUS", 1.0, lambda d: f"plain IS NOT NULL AND coalesce(lower(encoding) = 'base64', false) AND NOT {d.m('plain', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')}"),
    MailRule("R_BAD_CTE_7BIT", 3.5, lambda d: f"coalesce(lower(encoding) = '7bit', false) AND {d.m('plain', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')}"),
    _plain("MIME_HTML_ONLY", 0.2, "html IS NOT NULL AND plain IS NULL"),
    _plain("HAS_ATTACHMENT", 0.0, "file IS NOT NULL"),
    _match("CHECK_ARCHIVES", 0.0, "file", f"(?i)[.]({ARCHIVE})$"),
    _match("EXE_IN_ARCHIVE", 1.5, "file", f"(?i)[.]({EXECUTABLE})[.]({ARCHIVE})$"),
    MailRule("EXE_ARCHIVE_CLICKBAIT_SUBJECT", 9.0, lambda d: f"{d.m('file', f'(?i)[.]({EXECUTABLE})[.]({ARCHIVE})$')} AND {d.m('subject', '(?i)(invoice|payment|order|urgent)')}"),
    _match("EXE_ARCHIVE_CLICKBAIT_FILENAME", 9.0, "file", f"(?i)(invoice|payment|order)[^/]*[.]({EXECUTABLE})[.]({ARCHIVE})$"),
    _plain("COMPLETELY_EMPTY", 15.0, "coalesce(plain, '') = '' AND html IS NULL AND file IS NULL AND coalesce(subject, '') = ''"),
    _plain("SINGLE_SHORT_PART", 0.0, "html IS NULL AND file IS NULL AND length(plain) < 64"),
    _match("ENCRYPTED_PGP", -0.5, "ctype", "(?i)^multipart/encrypted[^\\n]*pgp-encrypted"),
    _match("SIGNED_PGP", -2.0, "ctype", "(?i)^multipart/signed[^\\n]*pgp-signature"),
    _match("SIGNED_SMIME", -2.0, "ctype", "(?i)^multipart/signed[^\\n]*pkcs7-signature"),
    _match("ENCRYPTED_SMIME", -0.5, "ctype", "(?i)^application/(x-)?pkcs7-mime"),
    # links, pictures and markup
    MailRule("URI_COUNT_ODD", 1.0, lambda d: f"{d.m('ctype', '(?i)^multipart/alternative')} AND n_urls % 2 = 1"),
    _plain("HTML_SHORT_LINK_IMG_1", 2.0, "length(html) < 1024 AND n_images > 0 AND n_urls > 0"),
    _plain("HTML_SHORT_LINK_IMG_2", 1.0, "length(html) >= 1024 AND length(html) < 1536 AND n_images > 0 AND n_urls > 0"),
    _plain("HTML_SHORT_LINK_IMG_3", 0.5, "length(html) >= 1536 AND length(html) < 2048 AND n_images > 0 AND n_urls > 0"),
    MailRule("R_EMPTY_IMAGE", 2.0, lambda d: f"n_images > 0 AND NOT {d.m('html', '>[^<]*[A-Za-z0-9]{3}')}"),
    _match("ZERO_FONT", 1.0, "html", "(?i)font-size *: *0"),
    _match("EXT_CSS", 1.0, "html", "(?i)<link[^>]*stylesheet"),
    _match("HTTP_TO_HTTPS", 0.5, "html", "(?i)href=[\\x22]?http://[^>]*>[^<]*https://"),
    _match("HTTP_TO_IP", 1.0, "html", "(?i)href=[\\x22]?https?://[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"),
    _match("R_WHITE_ON_WHITE", 4.0, "html", "(?i)style=[\\x22][^\\x22]*color *: *(#fff(fff)?|white)[^\\x22]*background(-color)? *: *(#fff(fff)?|white)"),
    _match("R_SUSPICIOUS_URL", 5.0, "html", "(?i)href=[\\x22]?https?://[^/>\\x22]*@"),
    MailRule("ZERO_WIDTH_SPACE_URL", 7.0, lambda d: d.m("html", "(?i)href=[\\x22]?https?://[^>\\x22]*\\x{200B}")),
    _match("OMOGRAPH_URL", 5.0, "html", "(?i)href=[\\x22]?https?://[^/>\\x22]*([a-z][\\x{370}-\\x{4FF}]|[\\x{370}-\\x{4FF}][a-z])"),
    _match("HAS_WP_URI", 0.0, "html", "(?i)https?://[^>\\x22]*/wp-[a-z]"),
    _match("WP_COMPROMISED", 0.0, "html", "(?i)https?://[^>\\x22]*/wp-(content|includes)/[^>\\x22]*[.]php"),
    _match("URI_HIDDEN_PATH", 1.0, "html", "(?i)https?://[^/>\\x22]+/([^>\\x22]*/)?[.][a-z]"),
]


def findings(messages: DataFrame, id_col: str, rules: list[MailRule] = RULES) -> DataFrame:
    """(id_col, symbol, score): one row for each rule that a message meets."""
    met = F.array(*[F.when(F.expr(r.predicate(SPARK)), F.struct(F.lit(r.symbol).alias("symbol"), F.lit(float(r.score)).alias("score"))) for r in rules])
    return messages.select(id_col, F.explode(F.filter(met, lambda x: x.isNotNull())).alias("f")).select(id_col, "f.symbol", "f.score")


def findings_sql(messages: str, id_col: str, rules: list[MailRule] = RULES) -> str:
    """The same as one SELECT for each rule over the table ``messages``."""
    return " UNION ALL ".join(f"SELECT {id_col}, '{r.symbol}' AS symbol, {float(r.score)}::DOUBLE AS score FROM {messages} WHERE {r.predicate(ANSI)}" for r in rules)
