"""Leaky buckets without one task a key: each time slot of a key becomes a function of the level before it.

What an event does to the level (leak, then add or refuse) is piecewise linear
with slopes 0 and 1, and so is a whole run of events. Three passes:

1. every slot of every key, by itself: its runs as lists of pieces;
2. every key: one evaluation a run, so a key costs as many steps as it has runs;
3. every slot by itself again: its events, from the level that pass 2 gives.

Levels are whole numbers of a small unit, so all three passes agree exactly with
a walk over all events.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run of events ends when its function has more pieces than this.
PIECES = 2_000
_RUN = "k string, slot long, t long, tie long, t_last long, n decimal(38,0), limit decimal(38,0), leak decimal(38,0), starts array<decimal(38,0)>, values array<decimal(38,0)>, slopes array<int>"
_BIG = pa.decimal128(38, 0)


def after(level: int, passed: int, n: int, limit: int, leak: int) -> tuple[int, bool]:
    """Level after one event that ``passed`` microseconds after the last one, and whether it was refused."""
    left = max(0, level - max(0, passed) * leak)
    refused = left + n > limit
    return (left if refused else left + n), refused


class Pieces:
    """A function of the level: from each start on, a value and the slope 0 or 1."""

    def __init__(self) -> None:
        self.starts, self.values, self.slopes = [0], [0], [1]

    def then(self, passed: int, n: int, limit: int, leak: int) -> None:
        """Compose with one more event."""
        lost, most = max(0, passed) * leak, limit - n
        starts: list[int] = []
        values: list[int] = []
        slopes: list[int] = []

        def add(a: int, v: int, s: int) -> None:
            if starts and ((s == slopes[-1] == 0 and values[-1] == v) or (s == slopes[-1] == 1 and values[-1] + a - starts[-1] == v)):
                return
            starts.append(a)
            values.append(v)
            slopes.append(s)

        def gate(a: int, b: float, z: int, s: int) -> None:
            """Add where there is room, from a to b."""
            if s == 0:
                add(a, z + n if z <= most else z, 0)
                return
            full = a + most - z + 1
            if a < full:
                add(a, z + n, 1)
            if full < b:
                add(max(a, full), z + max(0, full - a), 1)

        for a, b, v, s in zip(self.starts, [*self.starts[1:], float("inf")], self.values, self.slopes, strict=True):
            if s == 0:
                gate(a, b, max(0, v - lost), 0)
                continue
            dry = a + lost - v
            if a < dry:
                gate(a, min(b, dry), 0, 0)
            if dry < b:
                gate(max(a, dry), b, max(0, v - lost), 1)
        self.starts, self.values, self.slopes = starts, values, slopes

    def at(self, level: int) -> int:
        return value_at(self.starts, self.values, self.slopes, level)


def value_at(starts: list[int], values: list[int], slopes: list[int], level: int) -> int:
    i = bisect_right(starts, level) - 1
    return int(values[i]) + slopes[i] * (level - int(starts[i]))


def limits(events: DataFrame, key: str, ts: str, tie: str, burst: float, rate: float, weight: str | None = None, burst_factor: str | None = None, rate_factor: str | None = None, slot_s: int = 86_400) -> DataFrame:
    """(key, tie, level, limited) of every event: a bucket a key that takes ``weight`` (1) tokens an event up to ``burst`` and leaks ``rate`` a second.

    An event that does not fit is refused and adds nothing. ``burst_factor`` and
    ``rate_factor`` name columns of multipliers as they stand at the event; they
    count in parts of 10,000, nought as one part. Equal times are ordered by ``tie``; events
    with a null key or time are left out; null weights are 0, null factors 1.
    A key's slots of ``slot_s`` seconds are separate tasks but for one short step a run.
    """
    per_second = Fraction(str(rate))
    unit = per_second.denominator * 1_000_000 * 10_000  # of a token

    def part(c: str | None) -> F.Column:
        return F.greatest(F.lit(1), F.floor(F.coalesce(F.col(c).cast("double"), F.lit(1.0)) * 10_000)) if c else F.lit(10_000)

    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("tie"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("weight"), part(burst_factor).cast("long").alias("bf"), part(rate_factor).cast("long").alias("rf"),
    )
    rows = rows.withColumn("slot", F.floor(F.col("t") / (slot_s * 1_000_000)))
    dealt = rows.repartition("k", "slot")
    most = Fraction(str(burst))

    def amounts(weight: float, bf: int, rf: int) -> tuple[int, int, int]:
        return int(Fraction(str(weight)) * unit), int(most * bf * unit / 10_000), per_second.numerator * rf

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first, f, last = None, None, None, 0
        names = [c.split()[0] for c in _RUN.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _BIG, _BIG, _BIG, pa.list_(_BIG), pa.list_(_BIG), pa.list_(pa.int32())]

        def ended() -> tuple:
            return (*first[:4], last, *first[4:], f.starts, f.values, f.slopes)

        for b in batches:
            out = []
            for k, t, tie, weight, bf, rf, slot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, limit, leak = amounts(weight, bf, rf)
                if (k, slot) != here or len(f.starts) > PIECES:
                    if here is not None:
                        out.append(ended())
                    here, first, f = (k, slot), (k, slot, t, tie, n, limit, leak), Pieces()
                else:
                    f.then(t - last, n, limit, leak)
                last = t
            if out:
                yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if here is not None:
            yield pa.record_batch([pa.array([v], x) for v, x in zip(ended(), kinds, strict=True)], names)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, level, last = None, 0, 0
        for b in batches:
            out = []
            for k, slot, t, tie, t_last, n, limit, leak, starts, values, slopes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != current:
                    current, level, last = k, 0, t
                out.append((k, slot, t, tie, level, last))
                level, _ = after(level, t - last, int(n), int(limit), int(leak))
                level, last = value_at(starts, values, slopes, level), t_last
            yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), _BIG, pa.int64()), strict=True)], ["k", "slot", "t", "tie", "level", "last"])

    starts = dealt.sortWithinPartitions("k", "slot", "t", "tie").mapInArrow(runs, _RUN).repartition("k").sortWithinPartitions("k", "t", "tie").mapInArrow(levels, "k string, slot long, t long, tie long, level decimal(38,0), last long")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, last = 0, 0
        for b in batches:
            out = []
            for k, t, tie, weight, bf, rf, _slot, known, since in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if known is not None:
                    level, last = int(known), since
                    continue
                level, refused = after(level, t - last, *amounts(weight, bf, rf))
                last = t
                out.append((k, tie, level / unit, refused))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], [key, tie_name, "level", "limited"])

    tie_name = tie
    marks = starts.select("k", "t", "tie", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("bf"), F.lit(0).cast("long").alias("rf"), "slot", F.col("level").alias("known"), F.col("last").alias("since"))
    mixed = rows.withColumns({"known": F.lit(None).cast("decimal(38,0)"), "since": F.lit(None).cast("long")}).unionByName(marks)
    ordered = mixed.repartition("k", "slot").sortWithinPartitions("k", "slot", "t", "tie", F.col("known").isNull())
    return ordered.select("k", "t", "tie", "weight", "bf", "rf", "slot", "known", "since").mapInArrow(replay, f"`{key}` string, `{tie}` long, level double, limited boolean")
