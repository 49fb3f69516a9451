"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from gristmill.llm import decontaminate, jaccard, langid, mixing, orderhash, repeats, secrets, tokenfile, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string, n long, id string, sha string, path string"
LONG = "one two three four five six seven eight " * 4000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n", "de", "b"),
    (5, LONG, "en", None),
    (6, LONG, "en", "b"),
    (7, "kurz", "de", "c"),
    (8, "12345 !!", None, "c"),
    (None, "der schnelle braune fuchs springt", "de", "c"),
    (9, "der schnelle braune fuchs springt", "de", ""),
]
ADDED = (0, 0.5, 7, "k", 1, "i", "s", "p")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ADDED for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, empty):
    got = langid.predict(docs, langid.train(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


def test_jaccard(docs, empty):
    got = [(r.id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()]
    assert sorted(x for x in got if x[0] in (1, 5, 6)) == [(1, 8, 1), (1, 8, 1), (5, 8, 5), (6, 8, 5)]
    assert {x for x in got if x[0] in (2, 3, 4)} == {(2, 0, 2), (3, 0, 3), (4, 0, 4)}
    assert [x for x in got if x[0] is None] == [(None, 1, None)] and (9, 1, 9) in got
    assert jaccard.jaccard_classes(empty).count() == 0


def test_jaccard_of_an_id_with_two_texts(spark):
    """Id 2 copies one text and is the least id of another, whose near copy is found all the same."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:59] + ["other"])
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, " ".join(words)), (4, " ".join(words)), (5, near), (6, "h i j k l m n")]
    got = {(r.id, r.component_id) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 6)}


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c lazy dog again and again quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x"), (4, LONG[:200])], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {5: [4], 6: [4]}
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_templates_find_new_parameters(spark):
    bench = spark.createDataFrame([(1, "A train leaves Boston at 10:30 and goes 60 km in one hour how far does it go in 3 hours")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Intro text. A train leaves Denver at 11:45 and goes 80 km in one hour how far does it go in 5 hours and more"), (2, "A train is late today because of the snow and nobody knows when it will arrive at the station")], "doc_id long, text string")
    assert [(r.doc_id, r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, [1])]


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    for d in (docs, empty):
        for known in (labels, labels.limit(0)):
            got = toxicity.score(d, toxicity.train(d, known)).collect()
            assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)


def test_secrets(spark, docs, empty):
    ledger = secrets.scan_new(docs).cache()
    assert secrets.findings(docs, ledger).count() == len(ROWS)
    assert secrets.scan_new(docs, ledger).count() == 0 and secrets.scan_new(empty).count() == 0
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{8,}"))
    assert {r.rule for r in secrets.scan_new(docs, ledger, newer).collect()} == {"hex@2"}


def test_repeats(docs, empty):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect())
    assert [x for x in got if x[0] in (5, 6)] == [(5, len(LONG), len(LONG), 1), (6, len(LONG), len(LONG), 1)]
    assert all(x[2] == 0 for x in got if x[0] not in (5, 6)) and repeats.remove_repeats(empty).count() == 0


def test_fingerprints(docs, empty):
    got = orderhash.edited_neighbours(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert orderhash.edited_neighbours(empty).count() == 0 and orderhash.fingerprints(docs).count() == len(ROWS)


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    assert sorted((r.doc_id or 0, r["size"], r.taken) for r in got) == sorted((r.doc_id or 0, r["size"], r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mixture(docs).columns == docs.columns


def test_token_files(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted((r.start, r.n_tokens) for r in tokenfile.read(*tokenfile.write(docs, path)).collect())
    assert len(got) == len(ROWS) and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    assert tokenfile.read(*tokenfile.write(empty, path)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "http://A.Example.org/es/1?q", "x"), (3, "http://A.Example.org/es/1?q", "x"), (4, "http://x.com", "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block")], urlfilter.RULE_SCHEMA)
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect())
    assert got[2:4] == [(3, "a.example.org", "/es/1", "example.org/es/", "block")] * 2 and got[0][:4] == (1, "", "", None) and got[4][1:4] == ("x.com", "", None)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0 and urlfilter.judge(pages, rules.limit(0)).count() == 5
