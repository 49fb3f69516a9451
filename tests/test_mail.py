"""Single rules on messages written by hand: met, and not met."""

import pytest
from gristmill.operators import mailkeys, mailmodules, mailrules
from pyspark.sql import functions as F

INTS = {"n_to", "n_to_named", "n_to_named_addr", "n_to_env", "n_rcpt", "n_received", "n_received_tls", "hours", "n_urls", "n_images"}
CLEAN = {
    "raw": "From: Ann <ann@a.example>\nTo: Bob <bob@b.example>\nSubject: Lunch\nDate: x\nMessage-ID: <1@a.example>\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n", "subject": "Lunch", "from_": "Ann <ann@a.example>", "from_addr": "ann@a.example", "from_name": "Ann", "to_": "Bob <bob@b.example>", "to_addr": "bob@b.example",
    "n_to": 1, "n_to_named": 1, "n_to_named_addr": 0, "n_to_env": 1, "n_rcpt": 1, "env_from": "ann@a.example", "helo": "mx.a.example", "hostname": "mx.a.example", "ip": "192.0.2.1", "mid": "<1@a.example>", "n_received": 2, "n_received_tls": 2, "last_tls": True, "hours": 0, "ctype": "text/plain; charset=utf-8", "encoding": "7bit", "plain": "See you at noon, as we said last week. Bring the book along, please.", "n_urls": 0, "n_images": 0,
}
CASES = {
    "RCVD_COUNT_SEVEN": {"n_received": 11}, "REPLYTO_DOM_NEQ_FROM_DOM": {"reply_to": "x@c.example", "reply_addr": "x@c.example"}, "MULTIPLE_FROM": {"from_": "a@a.example, b@a.example"}, "FROM_NAME_HAS_TITLE": {"from_name": "Dr. Ann"}, "ENVFROM_PRVS": {"env_from": "prvs=1=ann@a.example"}, "FROM_NO_DN": {"from_name": ""},
    "SUBJ_ALL_CAPS": {"subject": "BUY THIS NOW"}, "SUBJECT_ENDS_QUESTION": {"subject": "Lunch?"}, "FAKE_REPLY": {"subject": "Re: Lunch"}, "DATE_IN_FUTURE": {"hours": 3}, "DATE_IN_PAST": {"hours": -25}, "INVALID_MSGID": {"mid": "nonsense"}, "MISSING_MID": {"raw": CLEAN["raw"].replace("Message-ID: <1@a.example>\n", "")}, "HAS_ORG_HEADER": {"raw": CLEAN["raw"] + "Organization: X\n"},
    "MIME_HTML_ONLY": {"plain": None, "html": "<p>x</p>"}, "EXE_IN_ARCHIVE": {"file": "a.exe.zip"}, "HTTP_TO_IP": {"html": '<a href="http://10.0.0.1/">x</a>'}, "ZERO_FONT": {"html": '<b style="font-size:0">x</b>'}, "R_BAD_CTE_7BIT": {"plain": "naïve"}, "FORGED_MUA_THEBAT_MSGID": {"raw": CLEAN["raw"] + "X-Mailer: The Bat! 3\n"}, "HEADER_TO_EMPTY_DELIMITER": {"raw": CLEAN["raw"].replace("To: ", "To:")},
    "MULTIPLE_UNIQUE_HEADERS": {"raw": CLEAN["raw"] + "Subject: again\n"}, "TO_DN_NONE": {"n_to_named": 0}, "RDNS_NONE": {"hostname": None}, "SPOOF_DISPLAY_NAME": {"from_name": "boss@b.example"}, "SUBJ_EXCESS_BASE64": {"raw": CLEAN["raw"].replace("Subject: Lunch", "Subject: =?UTF-8?B?THVuY2g=?=")}, "GTUBE": {"plain": "XJS*C4JDBQADN1.NSBN3*2IDNEN*GTUBE-STANDARD-ANTI-UBE-TEST-EMAIL*C.34X"}, "ONCE_RECEIVED": {"n_received": 1}, "HFILTER_HELO_BAREIP": {"helo": "10.0.0.1"}, "URL_SUSPICIOUS_TLD": {"html": '<a href="http://x.tk/">x</a>'},
}


@pytest.fixture(scope="module")
def found(spark):
    schema = ", ".join(f"{c} {'int' if c in INTS else 'boolean' if c == 'last_tls' else 'string'}" for c in mailrules.COLUMNS)
    made = [("clean", CLEAN), *((s, CLEAN | changed) for s, changed in CASES.items()), ("nothing", {})]
    rows = spark.createDataFrame([(n, *(m.get(c) for c in mailrules.COLUMNS)) for n, m in made], f"name string, {schema}")
    rules = mailrules.RULES + mailmodules.RULES
    out = mailrules.findings(rows, "name", rules).groupBy("name").agg(F.collect_set("symbol").alias("s")).collect()
    return {r.name: set(r.s) for r in out}


@pytest.mark.parametrize("symbol", CASES)
def test_rule_is_met_by_its_case_alone(found, symbol):
    assert symbol in found[symbol] and symbol not in found["clean"]


def test_a_message_of_nulls_lacks_headers(found):
    assert {"MISSING_FROM", "MISSING_TO", "MISSING_DATE", "MISSING_MID", "RDNS_NONE", "MISSING_ESSENTIAL_HEADERS"} <= found["nothing"]


def test_no_rule_fails_on_very_long_fields(spark):
    """Patterns run without recursion: long hosts, addresses and words end no job."""
    long = {"html": '<a href="http://' + "a." * 100_000 + 'x/">' + "b." * 100_000 + "</a>", "reply_addr": "x@" + "a." * 100_000 + "a", "reply_to": "x@" + "a." * 100_000 + "a", "plain": "x" * 200_000 + " " + "a.b@" * 50_000, "subject": "= " * 100_000, "from_name": "a " * 100_000, "mid": "<" + "a." * 100_000 + "@x>", "ctype": "a/b; " * 50_000, "raw": CLEAN["raw"] + "Received: " + "by x " * 50_000}
    schema = ", ".join(f"{c} {'int' if c in INTS else 'boolean' if c == 'last_tls' else 'string'}" for c in mailrules.COLUMNS)
    m = CLEAN | long
    rows = spark.createDataFrame([("long", *(m.get(c) for c in mailrules.COLUMNS))], f"name string, {schema}")
    found = {r.symbol for r in mailrules.findings(rows, "name", mailrules.RULES + mailmodules.RULES).collect()}
    assert "URL_EXCESSIVE_DOTS" in found and "REPLYTO_INVALID" not in found


def test_doubled_dots_make_an_address_invalid(spark):
    schema = ", ".join(f"{c} {'int' if c in INTS else 'boolean' if c == 'last_tls' else 'string'}" for c in mailrules.COLUMNS)
    made = [(a, *((CLEAN | {"reply_addr": a, "reply_to": a}).get(c) for c in mailrules.COLUMNS)) for a in ("a@b.c", "a..b@c.d", "a@b..c", "a@.b.c", "a@b.c.", "a@b", "a@-.c")]
    found = mailrules.findings(spark.createDataFrame(made, f"name string, {schema}"), "name", mailrules.RULES).filter("symbol = 'REPLYTO_INVALID'").collect()
    assert {r.name for r in found} == {"a@b..c", "a@.b.c", "a@b.c.", "a@b"}


def test_header_classes_read_the_header_that_is_named(spark):
    schema = ", ".join(f"{c} {'int' if c in INTS else 'boolean' if c == 'last_tls' else 'string'}" for c in mailrules.COLUMNS)
    raw = "Subject:  Re: Lunch\nsubject: second\nTo: Bob <bob@x>\nX-Empty:\n"
    rows = spark.createDataFrame([("m", *((CLEAN | {"raw": raw}).get(c) for c in mailrules.COLUMNS))], f"name string, {schema}")
    rules = [mailkeys.class_rule(str(i), k, p, of=h) for i, (k, h, p) in enumerate([("header", "SUBJECT", "^Re: Lunch$"), ("rawheader", "Subject", "^  Re: Lunch$"), ("rawheader", "SUBJECT", "."), ("header", "To", "^Bob"), ("header", "Subject", "second"), ("header", "X-Empty", "."), ("header", "Cc", ".")])]
    assert {r.symbol for r in mailrules.findings(rows, "name", rules).collect()} == {"0", "1", "3"}


def test_message_tests_call_every_test_on_messages():
    from gristmill.plans import mail

    assert {name for name, *_ in mail.TEST_CALLS} == set(mailkeys.TESTS)
    assert {"is_recipients_sorted", "compare_recipients_distance"} < set(mailkeys.TESTS) and len(mail.TEST_RULES) == 20


def test_tests_on_recipients(spark):
    schema = ", ".join(f"{c} {'int' if c in INTS else 'boolean' if c == 'last_tls' else 'string'}" for c in mailrules.COLUMNS)
    cases = {"clean": {}, "listed": {"n_to": 7, "n_to_named_addr": 7}, "six": {"n_to": 6, "n_to_named_addr": 6}, "near": {"to_addr": "an@a.example"}}
    rows = spark.createDataFrame([(n, *((CLEAN | m).get(c) for c in mailrules.COLUMNS)) for n, m in cases.items()], f"name string, {schema}")
    rules = [mailkeys.test_rule("sorted", "is_recipients_sorted"), mailkeys.test_rule("near", "compare_recipients_distance", 3)]
    assert {(r.name, r.symbol) for r in mailrules.findings(rows, "name", rules).collect()} == {("listed", "sorted"), ("near", "near")}
