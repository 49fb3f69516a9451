"""The methods against naive versions of themselves, and the cases that once went wrong."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from gristmill.llm import decontaminate, langid, orderhash, repeats, secrets, tokenfile, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def test_phrases_are_those_of_one_parse():
    samples = {"a": "the quick brown fox jumps over", "b": "der schnelle braune fuchs", "c": "aaaaaaa"}
    m = langid.LanguageModel(samples)
    rng = random.Random(1)
    texts = ["the fox", "a" * 9000, "x", "".join(rng.choice("abcdefgh ") for _ in range(3000)), "quick brown " * 200]
    rates = m.rates(texts)
    for i, t in enumerate(texts):
        symbols = "".join(chr(1000 + c) for c in m.encode([t])[0])
        for k, name in enumerate(m.langs):
            sample, n, at = "".join(chr(1000 + c) for c in m.encode([samples[name]])[0]), 0, 0
            while at < len(symbols):
                end = at + 1
                while end <= len(symbols) and symbols[at:end] in sample:
                    end += 1
                at, n = max(end - 1, at + 1), n + 1
            assert rates[i, k] == pytest.approx(n * np.log2(len(sample) + langid.ALPHABET) / len(symbols))


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en", "x"), (4, "die katze", "de", "x"), (2, "½ ② Ⅷ ٣", None, "x"), (3, "ª", None, "x")], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[2] == "und" and got[3] != "und"


def test_a_language_of_long_texts_only_is_learned(spark):
    docs = spark.createDataFrame([(i, "kurzer satz hier " * 3, "de") for i in range(40)] + [(i, "long words there " * 40, "en") for i in range(40, 60)], "doc_id long, text string, lang string")
    assert langid.train(docs, chars_per_language=100).langs == ["de", "en"]


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(spark, items, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    return {r.doc_id: r["items"] for r in decontaminate.decontaminate(docs, bench(spark, *items)).collect()}


def test_windows_against_plain_python(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(12)]
    texts = []
    for n in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        item = rng.choice(items).split()
        if n % 2:
            cut = rng.randint(1, len(item))
            words[len(words) // 2 : len(words) // 2] = item[:cut] if n % 4 == 1 else item[-cut:]
        texts.append(" ".join(words))
    grams = [{tuple(i.split()[k : k + 8]): k for k in range(len(i.split()) - 7)} for i in items]
    want = {}
    for n, t in enumerate(texts):
        w, hit = t.split(), defaultdict(set)
        for k in range(len(w) - 7):
            for i, g in enumerate(grams):
                if tuple(w[k : k + 8]) in g:
                    hit[i].add(g[tuple(w[k : k + 8])])
        items_of = sorted(i for i, at in hit.items() if len(at) >= len(grams[i]) / 2 or len(at) >= 13)
        if items_of:
            want[n] = items_of
    assert found(spark, items, *texts) == want


def test_slots_must_agree(spark):
    item = "Tom has 5 apples and gives 5 of them away , then Tom buys 7 pears and eats 7 of them"
    same = "yes . Ann has 9 apples and gives 9 of them away , then Ann buys 4 pears and eats 4 of them"
    apart = "yes . Ann has 9 apples and gives 3 of them away , then Bob buys 4 pears and eats 6 of them"
    assert found(spark, [item], same, apart) == {0: [0]}


def test_items_without_templates_are_matched_by_their_words(spark):
    items = ["Who wrote Hamlet?", "12 15 18 21 24 27 30 33 36", "Yes"]
    assert found(spark, items, "Well, who wrote Hamlet and when?", "so 12 15 18 21 24 27 30 33 36 more", "yes", "who wrote Macbeth") == {0: [0], 1: [1]}


def test_toxic_counts_against_plain_python(spark):
    texts = ["you are awful", "a calm day", "Awful, awful!", "", None, "calm and kind"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, y string")
    want = Counter()
    for i in (0, 1, 2, 5):
        t = texts[i].lower()
        want.update((int(i in (0, 2)), g) for g in {t[k : k + n] for n in toxicity.GRAMS for k in range(len(t) - n + 1)})
    rows = docs.selectExpr("text", "cast(id in (0, 2) as int) y").mapInArrow(toxicity._count, "feature long, clean long, toxic long").collect()
    assert sum(r.toxic for r in rows if r.feature >= 0) == sum(n for (y, _), n in want.items() if y)
    assert sum(r.clean for r in rows if r.feature >= 0) == sum(n for (y, _), n in want.items() if not y)
    assert sum(r.toxic for r in rows if r.feature < 0) == 2 and sum(r.clean for r in rows if r.feature < 0) == 4


def test_every_feature_seen_has_a_weight(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words[:200] if i % 3 else words[150:], k=30)), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(docs, docs, kept_features=20)
    assert ((m.weight != 0) | (m.ratio != 0)).sum() > 1000 and m.shared > 0


def test_ledger_lasts_and_scans_only_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([("a", 1, "token = abcdef1"), ("b", 1, "nothing")], "path string, version int, text string")
    assert [(r.path, len(r.found)) for r in secrets.scan(first, path).orderBy("path").collect()] == [("a", 1), ("b", 0)]
    later = first.unionByName(spark.createDataFrame([("a", 2, "https://me:pw@host and token = abcdef1"), ("c", 1, "token = abcdef1"), ("c", 2, None)], first.schema))
    assert {r.blob for r in secrets.scan_new(later, secrets.read_ledger(spark, path), secrets.RULES + secrets.MORE_RULES).collect()} == {r.blob for r in secrets.with_blob(later).filter("version = 2").collect()}
    got = {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.found] for r in secrets.scan(later, path).collect()}
    assert got == {("a", 1): [("assign", 0, 15)], ("b", 1): [], ("a", 2): [("login", 0, 14), ("assign", 23, 38)], ("c", 1): [("assign", 0, 15)], ("c", 2): []}
    rules = len(secrets.RULES + secrets.MORE_RULES)
    assert secrets.read_ledger(spark, path).count() == rules * 4
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert {(r.path, r.version): len(r.found) for r in secrets.findings(later, secrets.read_ledger(spark, path + "2")).collect()}[("a", 1)] == 1


def test_repeats_over_many_partitions(spark):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))

    shared, loop = prose(60)[:330], prose(12)
    texts = [prose(150) for _ in range(40)]
    for i in range(0, 40, 4):
        texts[i] = texts[i][:300] + " " + shared + " " + texts[i][300:]
    texts[1] += (" " + loop) * 12
    texts[5] = texts[9] = texts[13]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sha string, k1 int").repartition(7)
    count = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        assert got[i].n_removed == gone.sum(), i
    assert {i for i, r in got.items() if r.repeats_passage} == {*range(0, 40, 4), 5, 9, 13}


def naive_sketch(text):
    k = orderhash.K
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    bins, seen = defaultdict(list), Counter()
    for at, g in enumerate(grams):
        h = 0
        for j in range(k):
            h = (h * 0x9E3779B97F4A7C15 + (ord(g[j]) + 1 if j < len(g) else 0)) & M
        h = mix(h)
        e = mix((h + seen[g] * 0xA0761D6478BD642F) & M)
        seen[g] += 1
        bins[e >> 58].append((e, at))
    out = [0] * orderhash.BINS
    for b, held in bins.items():
        v = 0
        least = sorted(sorted(held)[: orderhash.TUPLE], key=lambda x: x[1])
        for j in range(orderhash.TUPLE):
            v = mix((v * 0x9E3779B97F4A7C15 + (least[j][0] if j < len(least) else 0) + j + 1) & M)
        out[b] = v % 65535 + 1
    return out


def test_sketches_against_plain_python():
    rng = random.Random(6)
    texts = ["", "a", "abcdefgh", "abc " * 50, "é漢字" * 30] + ["".join(rng.choices("abcde ", k=n)) for n in (9, 70, 900, 6000)]
    assert orderhash.sketches(texts).tolist() == [naive_sketch(t) for t in texts]


@pytest.mark.parametrize("ids", ["ends", "hot", "outlier"])
def test_runs_hold_any_ids(spark, ids, monkeypatch):
    monkeypatch.setattr(orderhash, "RUN_ROWS", 20)
    rng = random.Random(7)
    if ids == "ends":
        keys = [2**63 - 1, -(2**63), 0, None, -5, 2**62 + 1, 2**62 + 2]
    elif ids == "hot":
        keys = [7] * 300 + list(range(8, 200)) + [None] * 100
    else:
        keys = [*range(300), 2**61]
    rows = [(k, "".join(rng.choices("abcdef ", k=rng.randint(0, 40)))) for k in keys]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = orderhash.in_runs(docs).filter("tail = 0").groupBy("run").count().collect()
    assert sum(r["count"] for r in runs) == len(rows) and max(r["count"] for r in runs) <= 90
    got = Counter((r.doc_id, r.n_chars) for r in orderhash.edited_neighbours(docs).collect())
    assert got == Counter((k, len(t)) for k, t in rows)


def test_other_vocabularies_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Hello  World\n\nagain", "", "  UPPER lower  ", "naïve café 12345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in tokenfile.read(*tokenfile.write(docs, path)).collect())
    assert got == [(i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in enumerate(texts)]


RULES = [("shop.io/deals/1", "block"), ("shop.io/deals/2", "block"), ("shop.io/news/", "allow"), ("shop.io/blog/", "allow")]


def judged(spark, urls, rules=RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r.page_id]: r for r in urlfilter.judge(pages, spark.createDataFrame(rules, urlfilter.RULE_SCHEMA)).collect()}


def test_a_template_is_rejected_and_siblings_merge(spark):
    urls = [f"http://shop.io/deals/{n}" for n in range(100, 400)] + [f"http://shop.io/{s}/{n}" for s in ("news", "blog") for n in range(50)] + ["http://shop.io/about/us", "http://other.io/deals/1"]
    got = judged(spark, urls)
    assert got["http://shop.io/deals/350"].rule is None and got["http://shop.io/deals/350"].verdict == "block"
    assert got["http://shop.io/deals/350"].template == "/deals/*" and got["http://shop.io/deals/350"].purity > urlfilter.REJECT
    assert got["http://shop.io/news/1"].template == got["http://shop.io/blog/7"].template != got["http://shop.io/about/us"].template
    assert got["http://shop.io/about/us"].verdict == got["http://other.io/deals/1"].verdict == "allow"


def test_paths_of_any_depth_are_read(spark):
    deep = "/".join(f"d{n}" for n in range(7))
    rules = [(f"deep.io/{deep}/bad/1", "block"), (f"deep.io/{deep}/bad/2", "block"), (f"deep.io/{deep}/good/", "allow")]
    urls = [f"http://deep.io/{deep}/{s}/{n}" for s in ("bad", "good") for n in range(100, 340)] + ["http://deep.io/" + "x/" * 3000]
    got = judged(spark, urls, rules)
    assert got[f"http://deep.io/{deep}/bad/333"].verdict == "block" and got[f"http://deep.io/{deep}/good/333"].verdict == "allow"
    assert got[urls[-1]].verdict == "allow"


def test_short_questions_with_other_numbers(spark):
    items = ["What is 5 times 7 plus 2?", "Add 3 to 4 now please", "Who wrote the Odyssey"]
    got = found(spark, items, "so: what is 8 times 9 plus 4? tell me", "What is 5 times 7 plus 2?", "what is 8 times 9 minus 4", "add 9 to 12 now please", "who wrote the Iliad", "he asked who wrote the Odyssey then", "add 9 to many now please")
    assert got == {0: [0], 1: [0], 3: [1], 5: [2]}

