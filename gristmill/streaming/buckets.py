"""Structured Streaming forms: windowed counts with watermarks, and stateful token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.state import token_bucket


def windowed_counts(stream: DataFrame, ts: str, key: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and window; rows later than ``late`` are dropped with their state."""
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return rows.groupBy(F.window("__ts", length, slide or length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def limited(stream: DataFrame, key: str, ts: str, tie: str, burst: float, rate: float, forget: str = "1 hour") -> DataFrame:
    """(key, tie, level, limited) of every row; a key's bucket is forgotten when idle past ``forget``."""
    step = token_bucket(burst, rate)
    idle_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "tie"])
        out = []
        for t, tie_value in zip(rows["t"], rows["tie"], strict=True):
            held, made = step(held, t / 1e6, 0.0)
            out.append((k[0], tie_value, made["level"], made["limited"]))
        state.update(held)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, tie, "level", "limited"])

    rows = stream.select(F.col(key).cast("string").alias(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("tie"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, {tie} long, level double, limited boolean", "level double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
