"""Small cases of headers, lookups, settings, sinks and attachments."""

import datetime
import io
import tarfile
import zipfile

from gristmill.functions import headers
from gristmill.operators import lookups
from gristmill.sources import parts, readers, sinks
from pyspark.sql import functions as F


def _one(spark, value, make, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(make(F.col("v")).alias("x")).first().x


def test_addresses(spark):
    assert tuple(_one(spark, '"A. B" <u.v@Mail.Example.org>', headers.address)) == ("A. B", "u.v", "mail.example.org", "example.org")
    assert tuple(_one(spark, "x@y.net", headers.address)) == (None, "x", "y.net", "y.net")
    assert tuple(_one(spark, "nobody", headers.address)) == (None, None, None, None)
    assert tuple(_one(spark, None, headers.address)) == (None, None, None, None)


def test_content_type(spark):
    got = _one(spark, 'Text/HTML; Charset="utf-8"; name=a.htm; charset=x', headers.content_type)
    assert (got.type, got.subtype, got.params) == ("text", "html", {"charset": "utf-8", "name": "a.htm"})
    assert _one(spark, "", headers.content_type).type is None


def test_received(spark):
    got = _one(spark, "from Mx.a.org (rdns [10.0.0.7])\r\n\tby in.b.org (Postfix) with ESMTPS id 7;\r\n\tMon, 2 Jan 2006 15:04:05 -0700 (MST)", headers.received)
    assert (got.from_host, got.from_ip, got.by_host, got.protocol) == ("mx.a.org", "10.0.0.7", "in.b.org", "esmtps")
    assert got.time.astimezone(datetime.UTC) == datetime.datetime(2006, 1, 2, 22, 4, 5, tzinfo=datetime.UTC)
    assert tuple(_one(spark, "odd", headers.received)) == (None,) * 5


def test_humanize(spark):
    assert [_one(spark, n, headers.humanize, "v long") for n in (0, 999, 1500, 2_000_000, -3_000)] == ["0", "999", "1.50K", "2.00M", "-3.00K"]


def test_map_rule(spark):
    rows = spark.createDataFrame([(1, ["A", "a", "b"]), (2, None), (3, [None, "z"])], "id long, keys array<string>")
    entries = spark.createDataFrame([("a", "OTHER:2"), ("B", None)], "key string, value string")
    assert sorted(map(tuple, lookups.map_rule(rows, "id", F.col("keys"), entries, "HIT", 3.0).collect())) == [(1, "HIT", 3.0, "b"), (1, "OTHER", 6.0, "a")]


def test_aliases(spark):
    rows = spark.createDataFrame([("a",), ("d",), ("x",), (None,)], "v string")
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "name string, target string")
    assert {r.v: r.resolved for r in lookups.resolve_aliases(rows, "v", aliases, 4).collect()} == {"a": "d", "d": "d", "x": "x", None: None}


def test_log_lines_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5), "m@x", "1.2.3.4", "reject", 16.5, [("A", 17.0), ("B_C", -0.5)], 10, 2.5)], "ts timestamp, mid string, ip string, action string, score double, findings array<struct<symbol:string,score:double>>, len long, time_ms double")
    rows.select(sinks.log_line().alias("value")).write.text(str(tmp_path / "log"))
    back = readers.read_scan_log(spark, str(tmp_path / "log")).first()
    want = rows.first()
    assert (back.ts, back.mid, back.ip, back.action, back.score, back.len, back.time_ms) == (want.ts, want.mid, want.ip, want.action, want.score, want.len, want.time_ms)
    assert [tuple(f) for f in back.findings] == [("A", 17.0), ("B_C", -0.5)]


def test_counts_are_restored(spark, tmp_path):
    counts = spark.createDataFrame([(7, 1, 2), (8, 0, 3)], "token long, spam_n long, ham_n long")
    sinks.dump_counts(counts, str(tmp_path / "dump"))
    assert sorted(map(tuple, sinks.restore_counts(spark, str(tmp_path / "dump")).collect())) == [(7, 1, 2), (8, 0, 3)]


def test_lines(spark):
    df = spark.createDataFrame([("a.b", 3)], "k string, n long")
    assert sinks.bulk_lines(df, "ix", "k").first().value == '{"index":{"_index":"ix","_id":"a.b"}}\n{"k":"a.b","n":3}'
    assert sinks.metric_lines(df, "m", F.col("k"), F.col("n"), F.lit(9)).first().value == "m.a_b 3 9"


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/a.txt", "abc")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("b.bin")
        info.size = 4
        f.addfile(info, io.BytesIO(b"1234"))
    df = spark.createDataFrame([(1, z.getvalue()), (2, t.getvalue()), (3, z.getvalue()[:30]), (4, None), (5, b"")], "id long, content binary")
    got = {r.id: (r.broken, [tuple(m) for m in r.members]) for r in parts.archive_members(df, "id", "content").collect()}
    assert got == {1: (False, [("d/a.txt", 3)]), 2: (False, [("b.bin", 4)]), 3: (True, []), 4: (False, []), 5: (True, [])}
    assert [r.t for r in df.orderBy("id").select(parts.file_type(F.col("content")).alias("t")).collect()][:2] == ["zip", "gz"]


def test_types_and_sizes(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (258).to_bytes(2, "little")
    rows = spark.createDataFrame([(0, png), (1, gif), (2, b" <HTML><p>"), (3, b"plain"), (4, b"\x00\x01"), (5, None)], "i int, v binary").orderBy("i").select(parts.file_type(F.col("v")).alias("t"), parts.image_size(F.col("v")).alias("s")).collect()
    assert [r.t for r in rows] == ["png", "gif", "html", "text", None, None]
    assert (tuple(rows[0].s), tuple(rows[1].s), rows[3].s) == ((640, 480), (3, 258), None)


def test_encoded_text(spark):
    assert _one(spark, "=?utf-8?B?w6k=?= =?iso-8859-1?Q?=E8a?=", parts.decode_words) == "éèa"
    assert _one(spark, "=?nope?B?xx?=", parts.decode_words) == "=?nope?B?xx?="
    assert _one(spark, "a=C3=A9=\nb", parts.decode_quoted) == "aéb"
    assert _one(spark, None, parts.decode_quoted) is None
