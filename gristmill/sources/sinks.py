"""Text forms of results for other systems, and the readers of what was dumped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def log_line(score: str = "score", required: float = 15.0) -> Column:
    """One scan-log line from columns ts, mid, ip, action, score, findings, len, time_ms, as ``read_scan_log`` reads."""
    found = F.array_join(F.transform("findings", lambda f: F.concat(f["symbol"], F.lit("("), F.format_string("%.2f", f["score"]), F.lit("){}"))), ",")
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" #1(normal) <"), F.substring(F.md5(F.col("mid").cast("binary")), 1, 6), F.lit(">; task; write_log: id: <"), "mid", F.lit(">, ip: "), "ip",
        F.lit(", (default: "), F.when(F.col("action") == "reject", "T").otherwise("F"), F.lit(" ("), "action", F.format_string(f"): [%.2f/{required:.2f}] [", score), found,
        F.lit("], len: "), F.col("len").cast("string"), F.lit(", time: "), F.format_string("%.1f", "time_ms"), F.lit("ms"),
    )


def bulk_lines(df: DataFrame, index: str, id_col: str) -> DataFrame:
    """(value): for every row a line that names the document and a line of its JSON, as bulk loaders take them."""
    head = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id")).alias("index")))
    return df.select(F.concat(head, F.lit("\n"), F.to_json(F.struct(*df.columns))).alias("value"))


def metric_lines(df: DataFrame, prefix: str, name: Column, value: Column, at: Column) -> DataFrame:
    """(value): ``prefix.name value seconds``, one line a row."""
    return df.select(F.concat_ws(" ", F.concat(F.lit(f"{prefix}."), F.regexp_replace(name, "[^A-Za-z0-9_]", "_")), value.cast("string"), at.cast("string")).alias("value"))


def exposition_lines(df: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """(value): ``metric{label="x"} value``, one line a row."""
    return df.select(F.concat(F.lit(f'{metric}{{{label}="'), F.replace(F.col(label), F.lit('"'), F.lit('\\"')), F.lit('"} '), F.col(value).cast("string")).alias("value"))


def dump_counts(counts: DataFrame, path: str) -> None:
    """Token counts as JSON lines, gzip; a dump is whole or absent."""
    counts.write.mode("errorifexists").option("compression", "gzip").json(path)


def restore_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token long, spam_n long, ham_n long").json(path)
