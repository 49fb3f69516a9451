"""Readers of maps, scan logs and mail, and the writers of results."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) lines: ``#`` starts a comment, a quoted key may hold spaces, a missing value is null."""
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    rows = spark.read.text(path).select(line.alias("line")).filter("line != ''")
    key = F.when(F.col("line").startswith('"'), F.regexp_extract("line", r'^"([^"]*)"', 1)).otherwise(F.regexp_extract("line", r"^(\S+)", 1))
    rest = F.trim(F.regexp_replace("line", r'^("[^"]*"|\S+)', ""))
    return rows.select(key.alias("key"), F.when(rest != "", rest).alias("value"))


#: One scan-log line: id, ip, action, score, required score, symbols, length, time.
LOG_LINE = r"id: <([^>]*)>.*?ip: ([^,]+),.*?\(.*?: [A-Z] \(([^)]+)\): \[(-?[0-9.]+)/(-?[0-9.]+)\] \[([^\]]*)\].*?len: (\d+), time: ([0-9.]+)ms"


def read_scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a scan log (plain or gzip): ts, mid, ip, action, score, required, findings, len, time_ms."""
    cell = [F.regexp_extract("value", LOG_LINE, i) for i in range(1, 9)]
    symbol = F.transform(
        F.filter(F.split(cell[5], r",(?=[A-Z][A-Z0-9_]*\()"), lambda s: s != ""),
        lambda s: F.struct(F.regexp_extract(s, r"^([A-Z0-9_]+)", 1).alias("symbol"), F.regexp_extract(s, r"\((-?[0-9.]+)\)", 1).try_cast("double").alias("score")),
    )
    ts = F.try_to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1))
    return spark.read.text(path).filter(F.col("value").rlike(LOG_LINE)).select(
        ts.alias("ts"), cell[0].alias("mid"), cell[1].alias("ip"), cell[2].alias("action"), cell[3].cast("double").alias("score"), cell[4].cast("double").alias("required"), symbol.alias("findings"), cell[6].cast("long").alias("len"), cell[7].cast("double").alias("time_ms")
    )


MAIL = "path string, message_id string, subject string, sender string, rcpts array<string>, headers array<struct<name:string,value:string>>, parts array<struct<ctype:string,filename:string,text:string>>"


def _parse_mail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            m = message_from_bytes(bytes(content), policy=policy.compat32)
            parts = []
            for p in m.walk():
                if not p.is_multipart():
                    raw = p.get_payload(decode=True) or b""
                    is_text = p.get_content_maintype() == "text"
                    try:
                        text = raw.decode(p.get_content_charset() or "utf-8", "replace") if is_text else None
                    except LookupError:
                        text = raw.decode("utf-8", "replace")
                    parts.append({"ctype": p.get_content_type(), "filename": p.get_filename(), "text": text})
            rcpts = [x.strip() for h in ("To", "Cc") for x in str(m.get(h) or "").split(",") if x.strip()]
            rows.append((path, m.get("Message-ID"), str(m.get("Subject") or ""), str(m.get("From") or ""), rcpts, [{"name": k, "value": str(v)} for k, v in m.items()], parts))
        yield pd.DataFrame(rows, columns=["path", "message_id", "subject", "sender", "rcpts", "headers", "parts"])


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """One row for each mail file: headers in order, decoded text parts, attachments by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content").mapInPandas(_parse_mail, MAIL)


def write_results(df: DataFrame, path: str, ts_col: str) -> None:
    """Append results partitioned by day, so that old days can be dropped as folders."""
    df.withColumn("day", F.to_date(ts_col)).write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Results from ``since`` (a date) on; the day folders before it are not read."""
    return spark.read.parquet(path).filter(F.col("day") >= F.to_date(F.lit(since)))
