"""Patterns, networks and suffixes against brute force."""

import ipaddress
import random

import pytest
from gristmill.operators import networks, suffixes, trie


@pytest.mark.parametrize("shard", [trie.SHARD_PATTERNS, 7])
def test_every_place_of_every_pattern(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD_PATTERNS", shard)
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.randrange(60))), "x") for i in range(60)] + [(None, "abab", "x"), (None, "abab", "x"), (7, None, "x"), (8, "", "x")]
    words = sorted({"".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))) for _ in range(40)})
    docs = spark.createDataFrame(texts, "doc_id long, text string, pattern string")
    got = trie.occurrences(docs, spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "pattern string"))
    want = sorted((i or -1, w, k, k + len(w)) for i, t, _ in texts if t for w in words for k in range(len(t)) if t.startswith(w, k))
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == want


def test_fifty_thousand_patterns(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(50_000)]
    texts = [(i, "".join(rng.choice("abcdefghijK ") for _ in range(500))) for i in range(50)]
    got = trie.occurrences(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(w,) for w in words], "pattern string"), ignore_case=True, first_only=True)
    known = set(words)
    want = {(i, t.lower()[k : k + n]): k for i, t in texts for k in range(len(t) - 1, -1, -1) for n in range(3, 9) if t.lower()[k : k + n] in known and k + n <= len(t)}
    assert {(r.doc_id, r.pattern): r.start for r in got.collect()} == want


def test_no_patterns(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert trie.occurrences(docs, spark.createDataFrame([], "pattern string")).count() == 0


@pytest.mark.parametrize("most", [networks.INTERVALS_BROADCAST, 0])
def test_addresses_of_both_families(spark, most):
    rng = random.Random(7)
    nets = []
    for _ in range(150):
        if rng.random() < 0.5:
            nets.append(f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.choice([0, 7, 8, 15, 16, 24, 25, 31, 32])}")
        else:
            nets.append(f"2001:db8:{rng.randrange(4):x}::{rng.randrange(64):x}/{rng.choice([16, 32, 46, 48, 64, 122, 127, 128])}")
    entries = [(n, f"{i:03d}") for i, n in enumerate(nets)] + [("bad", "x"), (None, "x"), ("10.0.0.0/33", "x"), ("10.0.0.0/-1", "x"), ("::1/x", "x"), ("10.9.9.9", "alone")]
    addresses = [f"10.{rng.randrange(4)}.{rng.randrange(5)}.{rng.randrange(256)}" for _ in range(200)] + [f"2001:db8:{rng.randrange(6):x}::{rng.randrange(80):x}" for _ in range(200)] + ["::1", "ffff::", "0.0.0.0", "255.255.255.255", "nonsense", "", None, "10.0.0.0/8", "10.9.9.9", "::ffff:10.9.9.9", "[2001:db8::1]"]
    parsed = {}
    for key, value in entries:
        try:
            net = ipaddress.ip_network(key.split("/")[0] + ("/" + key.split("/")[1] if "/" in key else ""), strict=False)
            parsed[net] = max(value, parsed.get(net, ""))
        except (ValueError, AttributeError):
            pass

    def innermost(a):
        try:
            ip = ipaddress.ip_address(a.strip("[]"))
        except (ValueError, AttributeError):
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        fit = [n for n in parsed if n.version == ip.version and ip in n]
        return parsed[max(fit, key=lambda n: n.prefixlen)] if fit else None

    rows = spark.createDataFrame([(i, a, "clash") for i, a in enumerate(addresses)], "id long, address string, value string")
    got = networks.lookup(rows, "address", spark.createDataFrame(entries, "key string, value string"), most=most)
    assert got.columns == ["id", "address", "value"]
    assert {r.id: r.value for r in got.collect()} == {i: innermost(a) for i, a in enumerate(addresses)}


def test_suffix_rules(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "// note", "", "jp", "*.kobe.jp", "!city.kobe.jp", "COM"]
    want = {
        "example.com": ("com", "example.com"), "WWW.Example.COM.": ("com", "example.com"), "com": ("com", None), "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", None), "x.uk": ("uk", "x.uk"), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "b.ck": ("b.ck", None), "a.b.ck": ("b.ck", "a.b.ck"), "ck": ("ck", None),
        "city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "x.c.kobe.jp": ("c.kobe.jp", "x.c.kobe.jp"), "c.kobe.jp": ("c.kobe.jp", None), "kobe.jp": ("jp", "kobe.jp"), "host.unknown": ("unknown", "host.unknown"), "10.0.0.1": (None, None), "a..b": (None, None), "": (None, None), None: (None, None), "::1": (None, None),
    }
    rows = spark.createDataFrame([(h, "clash") for h in want] + [("example.com", "again")], "host string, suffix string")
    got = suffixes.registered(rows, "host", spark.createDataFrame([(r,) for r in rules], "rule string")).collect()
    assert len(got) == len(want) + 1
    assert {r.host: (r.suffix, r.domain) for r in got} == want
