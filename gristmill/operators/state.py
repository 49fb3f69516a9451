"""Per-key state over an ordered stream of rows: token buckets, averages, greylists, archives.

Keys are partitioned and rows sorted by time within partitions; a task streams
its rows with the state of the current key only, so no group is ever held in
memory. ``streaming`` runs the same step functions incrementally.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[tuple | None, float, float], tuple[tuple, dict[str, object]]]


def fold(df: DataFrame, key: str, ts: str, value: str, tie: str, step: Step, out: str) -> DataFrame:
    """``df`` folded by ``step(state, seconds, value) -> (state, columns)`` per key in time order.

    The result has key, tie and the columns of schema ``out``. Rows with a null
    key or time are left out; equal times are ordered by ``tie``.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"), F.col(tie).cast("long").alias("tie"))
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            made: dict[str, list] = {n: [] for n in names}
            for k, t, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != current:
                    current, state = k, None
                state, columns = step(state, t / 1e6, 0.0 if v is None else v)
                for n in names:
                    made[n].append(columns[n])
            yield pa.record_batch([b.column(0), b.column(3), *(pa.array(made[n]) for n in names)], [key, tie, *names])

    return rows.repartition("k").sortWithinPartitions("k", "t", "tie").mapInArrow(run, f"{key} string, {tie} long, {out}")


def token_bucket(burst: float, rate: float) -> Step:
    """Leaky bucket: one token a row, leaking ``rate`` a second; ``limited`` beyond ``burst``."""

    def step(state: tuple | None, now: float, _: float) -> tuple[tuple, dict[str, object]]:
        level, last = state or (0.0, now)
        level = max(0.0, level - max(0.0, now - last) * rate)
        limited = level + 1 > burst
        level = level if limited else level + 1
        return (level, now), {"level": level, "limited": limited}

    return step


def moving_average(window_s: float) -> Step:
    """Exponential average with weight 1 - exp(-dt / window); the first value is stored as it is."""

    def step(state: tuple | None, now: float, value: float) -> tuple[tuple, dict[str, object]]:
        if state is None:
            return (value, now, 1), {"average": value, "n": 1}
        average, last, n = state
        alpha = 1 - math.exp(-max(0.0, now - last) / window_s)
        average = alpha * value + (1 - alpha) * average
        return (average, now, n + 1), {"average": average, "n": n + 1}

    return step


def greylist(timeout_s: float, expire_s: float) -> Step:
    """First sight defers; a retry passes once older than ``timeout_s``; entries expire."""

    def step(state: tuple | None, now: float, _: float) -> tuple[tuple, dict[str, object]]:
        first = state[0] if state and now - state[0] <= expire_s else None
        if first is None:
            return (now,), {"verdict": "new"}
        return (first,), {"verdict": "pass" if now - first >= timeout_s else "defer"}

    return step


def reputation_score(average: str, n: str, reject: float = 10.0, least: int = 10, mult: float = 1.0) -> Column:
    """Score of an average: 0 below ``least`` rows, else a shifted tanh of its share of the reject score."""
    return F.when(F.col(n) < least, 0.0).otherwise(F.tanh(F.col(average) / reject * 1.83178 - 0.5493) * mult)


def rounded(n: Column, d: Column) -> Column:
    """n / d of two whole numbers, d positive, to the nearest whole one, halves upwards; exact."""
    twice = 2 * n + d
    return ((twice - F.pmod(twice, 2 * d)) / (2 * d)).cast("long")


def archive(df: DataFrame, ts: str, value: str, step_s: int, steps: int, xff: float = 0.5, group: list[str] | None = None) -> DataFrame:
    """Round-robin consolidation: averages over primary points of ``step_s``, ``steps`` to a row.

    A consolidated row is null when more than ``xff`` of its points are unknown.
    Columns: group, slot (start in seconds), average, maximum, minimum, known.
    """
    group = group or []
    seconds = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000)
    points = df.groupBy(*group, (F.floor(seconds / step_s) * step_s).alias("point")).agg(F.sum(F.round(F.col(value) * 1e6).cast("long")).alias("total"), F.count(value).alias("rows"))
    points = points.filter("rows > 0").withColumn("pdp", rounded(F.col("total"), F.col("rows")))  # in millionths
    size = step_s * steps
    rows = points.groupBy(*group, (F.floor(F.col("point") / size) * size).alias("slot")).agg(F.sum("pdp").alias("sum"), F.max("pdp").alias("maximum"), F.min("pdp").alias("minimum"), F.count("pdp").alias("known"))
    enough = (F.lit(steps) - F.col("known")) <= steps * xff
    hundred = F.lit(100).cast("long")
    shown = {"average": rounded(F.col("sum"), hundred * F.col("known")), "maximum": rounded(F.col("maximum"), hundred), "minimum": rounded(F.col("minimum"), hundred)}
    return rows.select(*group, "slot", *[F.when(enough, c / 1e4).alias(n) for n, c in shown.items()], "known")


def newest(df: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows of every key, a ring of history; equal times are ordered by ``tie``."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
