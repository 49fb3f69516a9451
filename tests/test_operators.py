"""Small cases of the operators: nulls, ties, empty tables, streams, files."""

import math
import time

import pytest
from gristmill.functions import selectors
from gristmill.functions import text as T
from gristmill.operators import maps, state
from gristmill.sources import readers
from gristmill.streaming import buckets
from pyspark.sql import functions as F


def test_inverse_chi_square(spark):
    got = spark.range(1).select(T.inverse_chi_square(F.lit(-3.0), F.lit(5))).first()[0]
    assert math.isclose(got, 0.8152632445237721)


def test_ip_numbers(spark):
    rows = spark.createDataFrame([("10.0.0.1",), ("300.1.1.1",), ("x",), (None,)], "ip string").select(T.ip_number(F.col("ip")).alias("n")).collect()
    assert [r.n for r in rows] == [167772161, None, None, None]


def test_longest_prefix(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("bad", "c")], "key string, value string")
    rows = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.2.2.3"), (3, "11.0.0.1"), (4, None)], "id long, ip string")
    got = {r.id: r.value for r in maps.join_longest_prefix(rows, "ip", nets).collect()}
    assert got == {1: "b", 2: "a", 3: None, 4: None}


@pytest.mark.parametrize("text", ["nope", "words.nope", "words..first", "words("])
def test_bad_selectors(text):
    with pytest.raises(selectors.SelectorError):
        selectors.compile_selector(text)


def test_selector_zip(spark):
    df = spark.createDataFrame([("b a b", "s")], "text string, source string")
    assert df.select(selectors.combine("words;from", ":")).first()[0] == ["b:s", "a:s", "b:s"]


def test_map_reader(spark, tmp_path):
    (tmp_path / "m.list").write_text('# head\nA.com 1.5 # note\n"two words" SYM:2\n\nplain\n')
    got = {r.key: r.value for r in readers.read_map(spark, str(tmp_path / "m.list")).collect()}
    assert got == {"A.com": "1.5", "two words": "SYM:2", "plain": None}


def test_mail_reader(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: a@x.org\r\nTo: b@y.org, c@z.org\r\nSubject: hi\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody text\r\n")
    row = readers.read_mail(spark, str(tmp_path)).first()
    assert row.subject == "hi" and row.rcpts == ["b@y.org", "c@z.org"] and row.parts[0].text.strip() == "body text"


def test_scan_log(spark, tmp_path):
    (tmp_path / "s.log").write_text("2024-01-01 00:00:01 #1(normal) <ab>; task; write_log: id: <m1>, qid: <q>, ip: 1.2.3.4, (default: F (add header): [7.10/15.00] [A(5.10){x;},B(-2.00)], len: 10, time: 3.5ms\nnoise\n")
    row = readers.read_scan_log(spark, str(tmp_path / "s.log")).first()
    assert (row.mid, row.action, row.score) == ("m1", "add header", 7.1)
    assert [(f.symbol, f.score) for f in row.findings] == [("A", 5.1), ("B", -2.0)]


def test_fold_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, ts timestamp, v double, i long")
    assert state.fold(empty, "k", "ts", "v", "i", state.greylist(1, 2), "verdict string").count() == 0


def test_streams_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = buckets.limited(stream, "user_id", "ts", "event_id", 5, 0.0001).writeStream.format("memory").queryName("lim").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(120):  # the idle timeout keeps the query alive, so it is stopped once all rows are out
        if spark.table("lim").count() >= events.count():
            break
        time.sleep(0.5)
    q.stop()
    batch = state.fold(events, "user_id", "ts", "value", "event_id", state.token_bucket(5, 0.0001), "level double, limited boolean")
    assert {(r.event_id, r.limited) for r in spark.table("lim").collect()} == {(r.event_id, r.limited) for r in batch.collect()}
