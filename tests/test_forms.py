"""Word forms and stored sets on cases written by hand."""

from gristmill.functions import wordforms as W
from gristmill.operators import fuzzystore, trigrams
from pyspark.sql import functions as F

#: Words and stems that Porter's article gives.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
    "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
    "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "as": "as", "yes": "ye", "enjoy": "enjoi",
}


def test_stems(spark):
    rows = spark.createDataFrame([(list(STEMS),)], "w array<string>").select(W.stems("w").alias("s"))
    assert dict(zip(STEMS, rows.first().s, strict=True)) == STEMS


def test_mixed_words(spark):
    rows = spark.createDataFrame([("paypal",), ("pаypal",), ("раураl",), ("1а",), ("a" * 50 + "а",)], "w string")
    assert [r[0] for r in rows.select(W.mixed_score(F.col("w"))).collect()] == [0.0, 1.0, 0.0, 0.25, 0.0]


def test_stored_digests(spark):
    rows = [("d", 1, "add", 2, 10, 1), ("d", 1, "delete", 0, 20, 2), ("d", 1, "add", 3, 20, 3), ("d", 1, "refresh", 0, 40, 4), ("e", 1, "refresh", 0, 5, 5), ("f", 2, "add", 1, 5, 6), (None, 2, "add", 1, 5, 7)]
    stored = fuzzystore.apply(spark.createDataFrame(rows, "digest string, flag int, command string, value long, t long, id long"), "id")
    assert {tuple(r) for r in stored.collect()} == {("d", 1, 3, 40), ("f", 2, 1, 5)}
    assert [r.digest for r in fuzzystore.expire(stored, 50, 20).collect()] == ["d"]
    many = spark.createDataFrame([("d", i, "add", 1 + i, 1, i) for i in range(12)], "digest string, flag int, command string, value long, t long, id long")
    assert sorted(r.flag for r in fuzzystore.apply(many, "id").collect()) == list(range(4, 12))


def test_trigram_profiles_sent_and_joined_agree(spark):
    """Long texts are cut into slices, and profiles beyond the broadcast bound give the same rows."""
    texts = [(1, "a", "aaaa Bbbb"), (2, "b", "bbbbb ééé"), (3, None, "aaa bbb bbb 123 ab"), (4, "c", "x1yy"), (5, "a", None), (6, None, "zzz"), (7, None, "b" * 50), (7, None, "aaa"), (None, "b", "ccc")]
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    want = sorted(map(tuple, trigrams.likeliest(df, "doc_id", "lang").collect()))
    assert [r[:2] for r in want] == [(1, 4), (2, 4), (3, 3), (7, 49)]
    assert sorted(map(tuple, trigrams.likeliest(df, "doc_id", "lang", most=0).collect())) == want
    owner, codes = zip(*[(int(o), int(c)) for os, cs in trigrams._slices([(0, "abcd" * 400_000), (1, "abc")]) for o, c in zip(os, cs, strict=True)], strict=True)
    assert owner.count(0) == 1_599_998 and owner.count(1) == 1 and len(set(codes)) == 4
