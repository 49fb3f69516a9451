"""Running sums, look-backs and clusters over time, without one task a key.

Every key is cut into time slots. Work inside a slot is a window over that slot
alone; what came before it is an offset, or a short run of copied rows. A key
with a third of all rows is thus spread over as many tasks as it has slots.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def running_sums(df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, Column], slot_s: int = 86_400, then: list[Column] | None = None) -> DataFrame:
    """``df`` with, for each value, its sum over the earlier rows of the same keys (0 at first).

    Rows are ordered by ``ts``, equal times by ``tie``, equal ties by ``then``. Rows with a null key or
    time have no place in the order and are left out. Integer values give the
    same sums however rows are dealt.
    """
    rows = df.dropna(subset=[*keys, ts]).withColumn("__slot", F.floor(_micros(ts) / (slot_s * 1_000_000)))
    made = {f"__v{i}": v for i, v in enumerate(values.values())}
    rows = rows.withColumns(made)
    per_slot = rows.groupBy(*keys, "__slot").agg(*[F.sum(c).alias(c) for c in made])
    earlier = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slot.select(*keys, "__slot", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}o") for c in made])
    inside = Window.partitionBy(*keys, "__slot").orderBy(ts, tie, *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{c}i": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in made}).join(offsets, [*keys, "__slot"])
    return out.select(*df.columns, *[(F.col(f"{c}o") + F.col(f"{c}i")).alias(n) for c, n in zip(made, values, strict=True)])


def look_back(df: DataFrame, keys: list[str], ts: str, span_s: float, aggregates: dict[str, Column], slot_s: int | None = None) -> DataFrame:
    """``df`` with aggregates over the rows of the same keys in the ``span_s`` seconds up to each row, itself included.

    A slot also holds copies of the rows of the last ``span_s`` seconds before
    it, so slots are at least that long. Rows with a null key or time are left out.
    """
    slot, span = int(1e6 * max(slot_s or 0, span_s, 1)), int(span_s * 1e6)
    rows = df.dropna(subset=[*keys, ts]).withColumn("__t", _micros(ts)).withColumn("__own", F.floor(F.col("__t") / slot))
    reached = F.floor((F.col("__t") + span) / slot)
    rows = rows.withColumn("__slot", F.explode(F.sequence("__own", reached)))
    near = Window.partitionBy(*keys, "__slot").orderBy("__t").rangeBetween(-span, 0)
    return rows.withColumns({n: a.over(near) for n, a in aggregates.items()}).filter("__slot = __own").drop("__t", "__own", "__slot")


def clusters(df: DataFrame, source: str, element: str, ts: str, tie: str, score: Column, size_mult: float = 0.1, score_mult: float = 0.1) -> DataFrame:
    """``df`` with n_elements, total and cluster_score, each from what its source has sent before.

    n_elements: distinct elements so far; total: sum of scores; an element seen
    with a score before adds the total to the size, another takes its average
    off. cluster_score is at most 1, and null where it is 0.1 or less. Of rows
    that repeat time and tie one counts as the first of its element. The size is
    counted in decimals: three elements are 0.3, not the double above it.
    """
    whole = F.round(score * 10_000).cast("long")
    rows = df.dropna(subset=[source, element, ts]).withColumn("__day", F.floor(_micros(ts) / 86_400_000_000))
    rows = rows.join(rows.groupBy(source, element).agg(F.min("__day").alias("__first")), [source, element])
    place = F.row_number().over(Window.partitionBy(source, element, "__day").orderBy(ts, tie))
    rows = rows.withColumn("__fresh", ((F.col("__day") == F.col("__first")) & (place == 1)).cast("int"))
    order = [F.col("__fresh").desc()]
    rows = running_sums(rows, [source], ts, tie, {"n_elements": F.col("__fresh"), "__total": whole}, then=order)
    rows = running_sums(rows, [source, element], ts, tie, {"__weight": F.abs(whole)}, then=order)
    n, total = F.col("n_elements"), F.col("__total") / 10_000
    size = (n.cast("decimal(19,0)") * F.lit(Decimal(str(size_mult)))).cast("double")
    made = F.least(F.lit(1.0), F.when(F.col("__weight") > 0, size + total * score_mult).when(n > 0, size - total * score_mult / n))
    return rows.withColumns({"total": total, "cluster_score": F.when(made > 0.1, made)}).drop("__day", "__first", "__fresh", "__total", "__weight")
