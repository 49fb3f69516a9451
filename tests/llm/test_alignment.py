"""Alignment of two tokenizers against a plain pass over tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from gristmill.llm import alignment, catalog

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def naive(rows):
    """(doc_id, text) to the contract's columns, one token at a time with the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + k): b for k, b in enumerate([b for b in range(256) if b not in shown])}
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    out, linked = [], []
    for doc_id, text in rows:
        groups, want = [], (" " + (text or "")).encode()
        if text:
            a = [(i, bytes(table[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()) for i in s.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                at, size = [0, 0], [0, 0]
                for end in sorted(ends[0] & ends[1]):
                    group = []
                    for k, side in enumerate((a, b)):
                        own = []
                        while size[k] < end:
                            own.append(side[at[k]][0])
                            size[k] += len(side[at[k]][1])
                            at[k] += 1
                        group.append(own)
                    groups.append(group)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        linked.append(links)
        sha = hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest() if groups else ""
        out.append([doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), sha])
    count = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(d, a, b, g, n, sum(m for p, m in links.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links.items()), sha) for (d, a, b, g, n, sha), links in zip(out, linked, strict=True)], count, best


def table(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[7], r[1]))


def test_sf001_against_a_plain_pass(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want, _, _ = naive(docs)
    got = catalog.op12_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert table(tuple(r) for r in got.collect()) == table(want)


HARD = [
    (1, None),
    (2, ""),
    (3, "a▁b"),
    (4, "plain text, twice  spaced   out \n\n end "),
    (4, "plain text, twice  spaced   out \n\n end "),
    (None, "null id one"),
    (None, "null id two"),
    (5, " "),
    (6, "   "),
    (7, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (8, "日本語 русский \U0001f600\U0001f468‍\U0001f469 ﬁ"),
    (9, "x" * 300 + " " + "qzjxkvw" * 200),
    (10, "\x00 \t tab\r\n café naïve 12345 don't"),
]


@pytest.mark.parametrize("portion", [alignment.PORTION, 40])
def test_hard_texts_in_any_portion(spark, monkeypatch, portion):
    """Small portions and blocks put every document across several of them."""
    rows = [(r[0], r[1], "clash") for r in HARD]
    want, count, best = naive(HARD)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(2)
    a, b = alignment.load(alignment.ByteLevelSide, A), alignment.load(alignment.PieceSide, B)
    if portion != alignment.PORTION:
        got = fed(a, b, HARD, portion)
        assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted((w[0] or 0, *w[1:5], w[7]) for w in want)
        return
    result, pairs = alignment.align(docs, A, B)
    assert table(tuple(r) for r in result.collect()) == table(want)
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def fed(a, b, rows, portion):
    """The state machine by itself, with blocks of a few tokens."""
    machine = alignment.Sweep((len(a.tokens), len(b.tokens)), (a.id_type.str, b.id_type.str), (a.size_type.str, b.size_type.str))
    blocks = []
    for i, (doc_id, text) in enumerate(rows):
        own = [s.encode([" " + text])[0] if text else None for s in (a, b)]
        if None in own:
            blocks.append(alignment.Block(i, doc_id, 0, 0, b"", b""))
            continue
        found = []
        for k, s in enumerate((a, b)):
            ids = np.frombuffer(own[k], s.id_type)
            ends = np.cumsum(s.lengths[ids], dtype=np.int64)
            block = (ends - 1) // 16
            for n in np.unique(block).tolist():
                at = np.flatnonzero(block == n)
                found.append((n, k, alignment.Block(i, doc_id, k, int(ends[at[0] - 1]) if at[0] else 0, ids[at].tobytes(), s.lengths[ids[at]].tobytes())))
        blocks += [x[2] for x in sorted(found, key=lambda x: x[:2])]
    out, links = [], defaultdict(int)
    for lo in range(0, len(blocks), 3):
        out += machine.feed(blocks[lo : lo + 3])
    out += machine.close()
    for r in out:
        links[r[0]] += sum(r[9])
    totals = [r for r in out if r[3] is not None]
    assert all(links[r[0]] == r[6] for r in totals)
    return [(r[1], *r[3:8]) for r in totals]


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    a, b = alignment.load(alignment.ByteLevelSide, A), alignment.load(alignment.PieceSide, B)
    rows = [(1, "qzjxkvw" * 50 + " tail end")]
    want = fed(a, b, rows, 40)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    monkeypatch.setattr(alignment, "LINKS", 2)
    assert fed(a, b, rows, 40) == want


def test_long_text_and_empty_table(spark):
    text = "word café  and\n" * 60_000
    docs = spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string")
    result, _ = alignment.align(docs, A, B)
    got = {r.doc_id: r for r in result.collect()}
    assert got[1].n_a > 60_000 * 4 and got[1].n_groups > 0 and len(got[1].groups_sha256) == 64
    result, pairs = alignment.align(docs.limit(0), A, B)
    assert result.count() == 0 and pairs.count() == 0


def test_other_sizes_of_the_test_data(spark):
    """Totals of the whole table add up."""
    got = catalog.op12_tokenizer_alignment(spark, oracle.DATA)
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{oracle.DATA}/documents.parquet").count()
    assert all(r.n_links >= max(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in rows if r.n_a)
