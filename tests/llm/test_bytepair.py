"""The matrix encoder against the library, over whole tables and hard texts."""

import hashlib
import random

import numpy as np
import oracle
import pytest
from gristmill.llm import bytepair, catalog

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.read_ranks(PATH), special_tokens={})


def test_every_document_as_the_library_encodes_it(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = catalog.op11_byte_bpe(spark, oracle.DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_hard_texts(library):
    rng = random.Random(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(rng.choice(points)) for _ in range(50)) for _ in range(500)]
    texts += ["".join(rng.choice("abcde") for _ in range(k)) for k in range(0, 700, 9)] + [" " * k + "x" for k in range(40)]
    texts += ["\n\n  \t x\u3000y'll 'S don't 123 \u00bd\x85", "a" * 300_000, "".join(rng.choice("0123456789abcdef") for _ in range(200_000)), "<|endoftext|>"]
    model = bytepair.load(PATH, public_tokenizers.PATTERN)
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert model.decode(ids) == text.encode()


def test_a_text_beyond_one_portion(library):
    text = "one two\n three " * 200_000
    model = bytepair.load(PATH, public_tokenizers.PATTERN)
    assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_letters_are_those_of_the_library(library):
    cutter = bytepair.Cutter(public_tokenizers.PATTERN)
    lead = {b"a": 0, b"1": 1, b"!": 2}
    ranks = {bytes([b]): b for b in range(256)} | {k + bytes([b]): 256 + 256 * n + b for k, n in lead.items() for b in range(256)}
    classes = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in range(0, 0x34000, 7):
        if not 0xD800 <= c < 0xE000:
            for k in "a1!":
                assert (len(cutter.cut(k + chr(c))) == 1) == (classes.encode_ordinary(k + chr(c))[0] >= 256), hex(c)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "tie", None), (None, "tie", None), (3, "caf\u00e9 <|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bytepair.encode(docs, PATH, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = bytepair.decode(coded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, (r.text or "")) for r in back) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bytepair.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(bytepair.decode(nulls, PATH, public_tokenizers.PATTERN).first().decoded) == b""


def test_pair_table_finds_every_pair():
    ranks = bytepair.read_ranks(PATH)
    t = bytepair.PairTable(ranks)
    keys = np.array(list(t.pairs), dtype=np.uint64)
    found = t.find((keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    assert found.tolist() == list(t.pairs.values())
    assert t.find(np.array([50_000], np.uint32), np.array([bytepair.NONE], np.uint32))[0] == bytepair.NONE
