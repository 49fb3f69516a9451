"""The audit against a plain count over every pair and term."""

import re
from collections import Counter, defaultdict

import pytest
from gristmill.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term string, v1 string, rank string"


def naive(rows, least, ranks):
    docs = [(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), lang or "", source or "") for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[1] for d in docs}:
        seen, n = Counter(), defaultdict(Counter)
        for words, own, source in docs:
            if own == lang:
                seen.update(set(words))
                n[source].update(words)
        kept = [t for t, k in seen.items() if k >= least]
        whole = sum(n.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))

        for s in n:
            pairs = [(-sum((share(n[s], t) - share(n[o], t)) ** 2 // share(n[o], t) for t in kept), o) for o in n if o != s]
            tops = [(-((share(n[s], t) - share(whole, t)) ** 2 // share(whole, t)), t) for t in kept if n[s][t] and share(n[s], t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(tops)[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


ROWS = [
    (1, "The cat, the DOG \u00c9t\u00e9 \u00e9t\u00e9", "en", "a", "x", "x", "x"),
    (2, "the cat\u2014sat", "en", "b", None, None, None),
    (2, "the cat\u2014sat", "en", "b", None, None, None),
    (3, "dog dog \u00c9t\u00e9 the under_score", "en", "c", None, None, None),
    (4, None, "en", "d", None, None, None),
    (5, "", None, None, None, None, None),
    (6, "...", None, "a", None, None, None),
    (7, "once only", "fr", "a", None, None, None),
    (8, "uno dos", "es", "a", None, None, None),
    (9, "uno dos tres", "es", "a", None, None, None),
    (None, "uno dos", "es", "", None, None, None),
    (None, "the dog", "en", None, None, None, None),
    (10, "zeta alpha beta zeta gamma", "en", "a", None, None, None),
]


@pytest.mark.parametrize(("least", "ranks"), [(1, 200), (2, 200), (3, 200), (1, 2)])
def test_against_a_plain_count(spark, least, ranks):
    got = divergence.audit(spark.createDataFrame(ROWS, COLUMNS), least, ranks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == naive(ROWS, least, ranks)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).count() == 0


def test_counts_handed_on_early_and_long_texts_in_portions(spark, monkeypatch):
    text = "alpha \u00e9\u00e9 beta! " * 500
    assert [t for part in divergence.terms(text) for t in part] == text.replace("!", "").encode().split()
    monkeypatch.setattr(divergence, "STEP", 7)
    assert [t for part in divergence.terms(text) for t in part] == text.replace("!", "").encode().split()
    assert [t for part in divergence.terms("x" * 100) for t in part] == [b"x" * 100]


def test_vectors_keep_sources_apart(spark):
    """Equal counts in other sources are another vector."""
    rows = [(i, f"w{i % 7} v{i % 5} u", "en", "abc"[i % 3], None, None, None) for i in range(90)]
    got = divergence.audit(spark.createDataFrame(rows, COLUMNS), 1, 200)
    assert sorted(tuple(r) for r in got.collect()) == naive(rows, 1, 200)
