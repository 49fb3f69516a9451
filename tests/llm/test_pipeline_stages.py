"""Each stage of the pipeline on nulls, empty tables, repeated rows, long texts and clashing columns."""

import shutil
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
D = "/root/testdata/sf0.001"
LONG = " ".join(f"wort{i % 97}{'abcdefg'[i % 7]}" for i in range(9000))
BASE = "the quick brown fox jumps over the lazy dog again and again until the evening comes and everyone goes home"
ROWS = [
    (1, BASE, "en", "a"),
    (1, BASE, "en", "a"),
    (2, BASE, "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "123 !!", None, "c"),
    (6, LONG, "de", None),
    (7, "x" * 200_000, "en", "b"),
    (None, "eine kleine geschichte ohne nummer", "de", "c"),
    (8, "eine andere geschichte mit nummer", "de", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, score double, lang_pred string, items string, sig long, k1 long, taken int"
ADDED = (1, "i", 2, 0.5, "fr", "x", 3, 4, 5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ADDED for r in ROWS], SCHEMA)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_filters_keep_what_they_should(spark, docs):
    import corpus_pipeline as p

    known = p.identify_language(spark, docs, D)
    assert known.columns == docs.columns
    assert kept(known) == Counter((i, t) for i, t, *_ in ROWS if any(c.isalpha() for c in t or ""))
    one = p.one_of_each_group(spark, docs, D)
    assert one.columns == docs.columns
    assert kept(one) == Counter({(i, t) for i, t, *_ in ROWS if i != 2})
    clean = p.drop_benchmark_copies(spark, docs, D)
    assert clean.columns == docs.columns and kept(clean) == kept(docs)
    mixed = p.mix_sources(spark, docs, D)
    assert mixed.columns == docs.columns and set(kept(mixed)) <= {(i, t) for i, t, *_ in ROWS if (t or "").split()} and max(kept(mixed).values()) <= 6


def test_empty_tables_stay_empty(spark, docs):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0


def test_stages_in_plain_python(spark, tmp_path):
    """run() gives the documents that each stage, judged on its own input, lets through."""
    import corpus_pipeline as p

    for name in ("documents", "benchmark"):
        shutil.copy(f"{D}/{name}.parquet", tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:3]:
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r.doc_id for r in table.collect()}
    sizes = {r.doc_id: len((r.text or "").split()) for r in table.collect()}
    end = Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect())
    assert set(end) <= ids and all(1 <= n <= 3 for n in end.values())
    total = sum(sizes.values())
    assert abs(sum(sizes[i] * n for i, n in end.items()) - total) <= max(sizes.values())
    starts = sorted((r.start, r.n_tokens) for r in p.run(spark, str(tmp_path)).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
