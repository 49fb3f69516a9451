"""The queries against plain Python over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gristmill.llm import catalog

D = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(((r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{D}/documents.parquet").collect()))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language(spark, rows):
    lang = {i: g for i, _, g in rows}
    got = catalog.op1_language_id(spark, D).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) >= 0.95


def test_jaccard(spark, rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in catalog.op2_ngram_jaccard_join(spark, D).collect()}
    assert got == {(i, len(sets[i]), find(i)) for i in ids}


def test_repeats(spark, rows):
    raw = {i: t.encode() for i, t, _ in rows}
    count = Counter(t[k : k + 400] for t in raw.values() for k in range(len(t) - 399))
    for r in catalog.op6_suffix_array_dedup(spark, D).collect():
        t = raw[r.doc_id]
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), gone.sum(), (gone[1:] < gone[:-1]).sum(), hashlib.sha256(kept).hexdigest())


def test_fingerprints(spark, rows):
    got = sorted(catalog.op7_document_fingerprints(spark, D).collect())
    texts = [t for _, t, _ in rows]
    for k, r in enumerate(got):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest() and r.n_chars == len(t)
    assert np.mean([r.near_edited for r in got]) > 0.25 > 0.02 > np.mean([r.near_next for r in got])


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for (i, t, _), r in zip(rows, sorted(catalog.op9_token_ids(spark, D).collect()), strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decontamination(spark, rows):
    words = lambda t: [w.strip(".,!?").lower() for w in t.split()]
    grams = defaultdict(set)
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(r.text)
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].add(r.item_id)
    full = {i for i, t, _ in rows if sum(tuple(words(t)[k : k + 8]) in grams for k in range(len(words(t)) - 7)) >= 15}
    got = {r.doc_id for r in catalog.op3_benchmark_decontamination(spark, D).collect() if r.contaminated}
    assert full <= got


def test_toxicity_separates(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.score, truth[r.doc_id]) for r in catalog.op4_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in got if y], [s for s, y in got if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.7


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    one = corpus_pipeline.one_of_each_group(spark, docs, D)
    heads = {r.component_id for r in catalog.op2_ngram_jaccard_join(spark, D).collect()}
    assert {r.doc_id for r in one.select("doc_id").collect()} == heads and one.columns == docs.columns
    out = corpus_pipeline.run(spark, D)
    assert {r.doc_id for r in out.collect()} <= heads and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
