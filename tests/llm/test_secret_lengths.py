"""The scanner stays linear in long words and many hits."""

import re
import time

from gristmill.llm import secrets


def spans(spark, text, tmp_path):
    docs = spark.createDataFrame([(1, text, "clash", "clash")], "doc_id long, text string, blob string, found string")
    return [(s["kind"], s["start"], s["end"]) for s in secrets.scan(docs, str(tmp_path / "ledger")).first().found]


def test_one_word_of_two_million_letters(spark, tmp_path):
    began = time.time()
    assert spans(spark, "a" * 2_000_000 + "://u:p@", tmp_path) == [("hex", 0, 2_000_000), ("login", 2_000_000 - 31, 2_000_007)]
    assert spans(spark, "eyJz" * 50_000 + "." + "x" * 200_000, tmp_path) == []
    assert time.time() - began < 90


def test_two_hundred_thousand_hits(spark, tmp_path):
    text = "é token=abcdef12; " * 200_000
    began = time.time()
    got = spans(spark, text, tmp_path)
    assert time.time() - began < 90
    assert got == [("assign", m.start(), m.end()) for m in re.finditer("token=[a-z0-9]+", text)]
