"""Small cases of learning, running sums, HTML, quality and distances."""

import math
import random
import time

import numpy as np
import pytest
from gristmill.functions import html as H
from gristmill.functions import quality
from gristmill.functions import strings as S
from gristmill.functions import text as T
from gristmill.operators import bayes, neural, running
from gristmill.plans import catalog
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("raw", "at", "want"),
    [(bytes(range(4)), 3, -0.2), (b"aaaa", 3, -100000), (b"x", 3, -100000), (b"", 0, 0), (b"AAAABBBB", 0, 1.0), (b"AAAABBBB", 1, 65.5), (bytes(range(256)), 2, 64), (b"\xff" * 6, 4, 1.0), (b"\xff" * 5, 4, 0)],
)
def test_byte_statistics(raw, at, want):
    assert math.isclose(quality.statistics_of(raw)[at], want, abs_tol=1e-12)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_edits_by_bits_are_those_of_the_table(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcdefg"[: 2 + seed % 6]) for _ in range(r.choice((0, 1, 5, 63, 64, 65, 130)))] for _ in range(2))
    assert quality.edits(a, b) == _edits(a, b)


def test_edits_of_the_longest_texts_take_no_table():
    r, began = random.Random(1), time.process_time()
    a, b = ([f"w{r.randrange(4000)}" for _ in range(quality.MOST_WORDS)] for _ in range(2))
    assert 0 < quality.edits(a, b) < quality.MOST_WORDS and time.process_time() - began < 5


def test_word_distance(spark):
    draw = random.Random(3)
    pairs = [([draw.choice("a bb ccc d é 中".split()) for _ in range(draw.randrange(9))], [draw.choice("a bb ccc d é 中".split()) for _ in range(draw.randrange(9))]) for _ in range(60)]
    pairs.append((["w"] * (quality.MOST_WORDS + 3), ["w"]))
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", quality.word_distance("a", "b").alias("d")).collect()
    assert all(r.d == (abs(len(r.a) - len(r.b)) if len(r.a) > quality.MOST_WORDS else _edits(r.a, r.b)) for r in got)


def _edits_by_rows(a, b):
    """As ``_edits``, a row of the table at once."""
    at = np.arange(len(b) + 1)
    names = {w: i for i, w in enumerate({*a, *b})}
    x, row = np.array([names[w] for w in b], dtype=np.int64), at.copy()
    for i, w in enumerate(a, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (x != names[w]))])
        row = np.minimum.accumulate(best - at) + at
    return int(row[-1])


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_edits_do_not_depend_on_blocks(block):
    r = random.Random(block)
    for i in range(60):
        a, b = ([r.choice("abcdefg"[: 1 + i % 7]) for _ in range(r.choice((0, 1, 5, 63, 64, 65, 130)))] for _ in range(2))
        assert quality.edits(a, b, block) == quality.edits(a, b) == _edits(a, b) == _edits_by_rows(a, b)


@pytest.mark.parametrize("words", [quality.MOST_WORDS, quality.MOST_WORDS + 1, 2 * quality.MOST_WORDS + 5])
def test_word_distance_is_one_rule_at_every_length(spark, words):
    r = random.Random(words)
    a = [f"w{i}" for i in range(words)]
    swapped = [w if i % 1000 else "other" for i, w in enumerate(a)]
    pairs = [(a, swapped, len(range(0, words, 1000))), (a, ["new", *a[5:]], 5), (a[::-1], a, None), ([r.choice("abc") for _ in a], [r.choice("abcd") for _ in range(3000)], None)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>, want int").withColumn("d", quality.word_distance("a", "b")).collect()
    assert [g.d for g in got] == [_edits_by_rows(p, q) if d is None else d for p, q, d in pairs]


def test_turn_distances_of_long_turns(spark, tmp_path):
    said = [f"w{i}" for i in range(quality.MOST_WORDS + 100)]
    turns = [(1, 0, " ".join(said)), (1, 1, " ".join(["x", *said[1:-1], "y"])), (1, 2, "x"), (2, 0, "x y"), (2, 1, " ".join(said))]
    spark.createDataFrame([(c, t, "user", w) for c, t, w in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.distance, r.words) for r in catalog.QUERIES["turn_distances"](spark, str(tmp_path)).collect()}
    n = len(said)
    assert got == {(1, 1): (2, 2 * n), (1, 2): (n - 1, n + 1), (2, 1): (n, n + 2)}


def test_turn_distances(spark):
    data = "/root/testdata/sf0.01"
    said = {(r.conv_id, r.turn): r.text.lower().split() for r in spark.read.parquet(f"{data}/conversations.parquet").collect() if r.conv_id < 8}
    got = {(r.conv_id, r.turn): r.distance for r in catalog.QUERIES["turn_distances"](spark, data).filter("conv_id < 8").collect()}
    assert got == {(c, t): _edits(said[c, t - 1], w) for (c, t), w in said.items() if (c, t - 1) in said}


def test_quality_of_odd_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("\x01\x02" * 40,), ("short",)], "text string").select(quality.confidence("text").alias("c")).collect()
    assert rows[0].c == 1.0 and rows[1].c is None and rows[2].c < 0.5 and rows[3].c == 1.0


def test_phished_links(spark):
    page = '<p><a href="http://evil.example.net/x">www.bank.com</a> <A HREF=mailto:a@b.c>mail <b>us</b></A> <a href="https://www.bank.com/">bank.com/login</a><a href="#">&lt;up&gt;</a>'
    row = spark.createDataFrame([(page,)], "html string").select(F.transform(H.links(F.col("html")), lambda x: F.struct(H.link_kind(x["href"]).alias("kind"), x["shown"].alias("shown"), H.is_phished(x["href"], x["shown"]).alias("phished"))).alias("l")).first()
    assert [tuple(x) for x in row.l] == [("absolute", "www.bank.com", True), ("mailto", "mail us", False), ("absolute", "bank.com/login", False), ("relative", "<up>", False)]


def test_hidden_and_visible(spark):
    page = '<!-- no --><style>p{}</style><p style="color:red; display : none">a</p><b style="opacity:0.5">b &amp;lt;</b><i style="opacity:0">c</i>'
    row = spark.createDataFrame([(page,), (None,)], "html string").select(H.hidden_elements(F.col("html")).alias("n"), H.visible_text(F.col("html")).alias("t")).collect()
    assert (row[0].n, row[0].t) == (2, "a b &lt; c") and (row[1].n, row[1].t) == (0, None)


def test_running_sums_over_slots(spark):
    rows = [(k, None if t is None else float(t), i, v) for i, (k, t, v) in enumerate([("a", 0, 1), ("a", 0, 2), ("a", 90_000, 4), ("a", 400_000, None), ("a", 400_001, 8), (None, 1, 16), ("b", None, 32)])]
    df = spark.createDataFrame(rows, "k string, s double, i int, v int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.before for r in running.running_sums(df, ["k"], "ts", "i", {"before": F.coalesce("v", F.lit(0))}).collect()}
    assert got == {0: 0, 1: 1, 2: 3, 3: 7, 4: 7}


def test_look_back_across_slots(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 5, 9, 11, 12, 30)], "k string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.s: r.n for r in running.look_back(df, ["k"], "ts", 5, {"n": F.count("*")}, slot_s=10).collect()}
    assert got == {0: 1, 5: 2, 9: 2, 11: 2, 12: 3, 30: 1}


def test_no_class_learned(spark):
    tokens = spark.createDataFrame([(1, 7)], "doc_id long, token long")
    counts, learns = bayes.learn_classes(tokens, spark.createDataFrame([], "doc_id long, label int"), [0, 1])
    assert bayes.classify_classes(tokens, counts, learns, [0, 1]).count() == 0


def _clusters(spark, events):
    df = spark.createDataFrame([(i, f"2024-01-{d:02d} 00:00:00", 1, e, float(v)) for i, d, e, v in events], "event_id long, ts string, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return sorted((r.event_id, r.n_elements, r.total, r.cluster_score) for r in running.clusters(df, "user_id", "event_type", "ts", "event_id", F.col("value") - 50).collect())


def test_three_elements_are_three_tenths(spark):
    events = [(1, 1, "a", 49), (2, 2, "b", 49), (3, 3, "c", 50), (4, 4, "a", 50)]
    assert _clusters(spark, events)[3] == (4, 3, -2.0, None)


def test_a_repeated_event_is_one_new_element(spark):
    events = [(1, 1, "a", 51), (1, 1, "a", 51), (1, 1, "a", 51), (2, 3, "b", 51)]
    assert [r[1:3] for r in _clusters(spark, events)] == [(0, 0.0), (1, 1.0), (1, 2.0), (1, 3.0)]


def test_tokens_made_in_tasks_are_the_hashes_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(bayes, "ROWS", 2)  # many batches of output
    texts = [(1, "One two, one TWO three"), (2, ""), (3, None), (4, "alone"), (5, "É x\u212ay z9 z9 z9"), (6, "a b a b c")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = df.select("doc_id", F.explode(F.array_distinct(T.word_pairs(F.col("text")))).alias("p")).select("doc_id", T.hash60(F.col("p")))
    assert sorted(map(tuple, bayes.tokens(df).collect())) == sorted(map(tuple, want.collect()))
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (6, 1), (9, 1)], "doc_id long, label int")
    for a, b in zip(bayes.learn_texts(df, labels), bayes.learn(bayes.tokens(df), labels), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for a, b in zip(bayes.learn_class_texts(df, labels, [0, 1]), bayes.learn_classes(bayes.tokens(df), labels, [0, 1]), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_unlabelled_texts_are_not_learned(spark):
    """Labels meet the texts before these are cut into words, and only whole texts' tokens meet the counts."""
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    counts, _ = bayes.learn_texts(df, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and [r.spam_n for r in counts.collect()] == [1]


def test_base32_is_that_of_the_bits(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "abcdef", "é\u20ac", None, "x" * 32, "xyz" * 70_000]
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.base32(F.col("t")).alias("c")).collect()}
    for t in texts:
        if t is None:
            assert got[t] is None
            continue
        bits = "".join(f"{byte:08b}" for byte in t.encode())
        assert got[t] == "".join(S._BASE32[int(bits[i : i + 5].ljust(5, "0"), 2)] for i in range(0, len(bits), 5))


def test_confidence_reads_each_text_once_a_count(spark):
    df = spark.createDataFrame([(1, "some words of prose"), (2, None), (3, "!!!???!!!???"), (4, "x")], "doc_id long, text string")
    made = quality.with_quality(df, "text").select("doc_id", quality.confidence().alias("c"))
    assert made.collect() == df.select("doc_id", quality.confidence("text").alias("c")).collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 3 and plan.count("regexp_extract_all") <= 2


def test_perceptron_trains_on_stored_features_of_the_drawn_texts(spark, monkeypatch):
    class Enough(Exception):
        pass

    def train(rows, features, label_col):
        assert rows.storageLevel.useDisk and set(rows.columns) == {*features, label_col}
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan
        raise Enough

    monkeypatch.setattr(neural, "train", train)
    with pytest.raises(Enough):
        catalog.QUERIES["neural_scores"](spark, "/root/testdata/sf0.001")
