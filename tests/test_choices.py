"""Links, recipients and look-alikes against loops in plain Python."""

import random

import pytest
from gristmill.functions import confusables, recipients
from gristmill.operators import links
from pyspark.sql import functions as F


def chosen(rows, limit, per_domain):
    """Round by round, as the rule is told."""
    def score(r):
        return 0 if r["image"] or r["displayed"] else 1 if r["url"].startswith("mailto:") else 3 if r["obscured"] else 2 if r["has_port"] or r["phished"] else 1

    domains, endings = {}, {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        if not r["domain"]:
            continue
        item = (score(r), r["pos"], r["url"])
        own = domains.setdefault(r["domain"], [])
        if len(own) < per_domain:
            own.append(item)
        endings.setdefault(r["domain"].split(".", 1)[1], []).append(item)
    exact = len(domains) > limit
    groups = sorted((sorted(g) for g in (endings if exact else domains).values()), key=lambda g: (-g[-1][0], len(g), g[-1][1]))
    out, left = [], limit
    while left > 0 and any(groups):
        for g in groups:
            if g and not (exact and left == 0):
                out.append(g.pop()[2])
                left -= 1
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("limit", "per_domain"), [(1, 9), (4, 2), (5, 9999), (50, 3), (0, 5)])
def test_links_in_rounds(spark, limit, per_domain):
    rng = random.Random(limit)
    rows = []
    for i in range(12):
        for pos in range(rng.randrange(1, 40)):
            flags = {f: rng.random() < 0.15 for f in ("image", "displayed", "obscured", "has_port", "phished")}
            host = rng.choice(["a.com", "b.com", "c.org", "d.co.uk", "e.org", "f.net", None, ""])
            rows.append({"id": i, "pos": pos, "url": rng.choice(["mailto:", "http://"]) + f"{host}/{rng.randrange(12)}", "domain": host, **flags})
    df = spark.createDataFrame(rows, "id long, pos long, url string, domain string, image boolean, displayed boolean, obscured boolean, has_port boolean, phished boolean")
    got = {}
    for r in links.diversified(df, limit, per_domain, images=True).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.url)
    want = {i: chosen([r for r in rows if r["id"] == i], limit, per_domain) for i in range(12)}
    assert got == {i: w for i, w in want.items() if w}


def test_very_many_links_of_one_id(spark):
    df = spark.range(50_000).select(F.lit(1).alias("id"), F.col("id").alias("pos"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("d"), F.col("id") % 9, F.lit(".com")).alias("domain"))
    got = links.diversified(df, 20, 10_000).collect()
    assert len(got) == 27 and {r.domain for r in got} == {f"d{k}.com" for k in range(9)} and min(r.pos for r in got) >= 50_000 - 27
    assert links.diversified(df.limit(0), 5).count() == 0


def test_recipients(spark):
    long = ["abc1@x.org", "abd2@x.org", "abc3@x.org", "abc4@yy.org", "zzz9@x.org", "abcdef@x.org", "ab@"]
    rows = [(1, [f"a{k}@x" for k in range(7)]), (2, [f"a{k}@x" for k in range(6)]), (3, ["A1@x", "a1@X", *[f"b{k}@x" for k in range(6)]]), (4, None), (5, long), (6, [])]
    got = {r.id: (r.o, r.k, r.a) for r in spark.createDataFrame(rows, "id long, r array<string>").select("id", recipients.in_order(F.col("r")).alias("o"), recipients.likeness(F.col("r")).alias("k"), recipients.alike(F.col("r"), 0.5).alias("a")).collect()}
    assert got == {1: (True, 0.0, False), 2: (False, 0.0, False), 3: (False, 0.5, True), 4: (False, 0.0, False), 5: (False, 0.0, False), 6: (False, 0.0, False)}


def test_skeletons():
    assert confusables.skeleton_of("раураӏ".replace("ӏ", "l")) == "paypal" and confusables.skeleton_of("rnicrosoft") == confusables.skeleton_of("microsoft")
    assert confusables.skeleton_of("ＰａｙＰａｌ") == "paypal" and confusables.skeleton_of("pa​ypal") == "paypal" and confusables.skeleton_of("g00gle") == confusables.skeleton_of("google") and confusables.skeleton_of(None) is None
    assert confusables.transliterated("Zoë Ünal – ﬁn") == "Zoe Unal  fin" and confusables.decoded_host("xn--mnchen-3ya.de") == "münchen.de" and confusables.decoded_host("xn--\x00.de") == "xn--\x00.de"
    assert confusables.scripts("paypal") == {"LATIN"} and confusables.scripts("pаypal") == {"LATIN", "CYRILLIC"}


def test_lookalike_hosts(spark):
    known = spark.createDataFrame([("paypal.com",), ("google.com",), ("modern.org",), (None,), ("",), ("paypal.com",)], "host string")
    rows = [(1, "pаypal.com"), (2, "paypal.com"), (3, "PAYPAL.com"), (4, "g00gle.com"), (5, "modem.org"), (6, "other.com"), (7, None), (8, "xn--pypal-4ve.com"), (8, "xn--pypal-4ve.com")]
    got = confusables.lookalikes(spark.createDataFrame(rows, "id long, host string"), "host", known)
    assert sorted((r.id, r.looks_like) for r in got.collect()) == [(1, "paypal.com"), (4, "google.com"), (5, "modern.org"), (8, "paypal.com"), (8, "paypal.com")]


def test_normal_forms(spark):
    got = spark.createDataFrame([("é",), ("ﬁ",), (None,), ("a",)], "t string").select(confusables.normal_form(F.col("t"), "NFKC").alias("k"), confusables.normal_form(F.col("t"), "NFD").alias("d"), confusables.transliterate("t").alias("a"), confusables.mixes_scripts("t").alias("m")).collect()
    assert [tuple(r) for r in got] == [("é", "é", "e", False), ("fi", "ﬁ", "fi", False), (None, None, None, False), ("a", "a", "a", False)]
