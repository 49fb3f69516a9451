"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents are put in a shuffled order. A document's virtual
finish time is its source's cumulative tokens up to and with it, divided by the
source's target; a source whose target exceeds its size is gone through again,
up to ``max_epochs`` times. All documents are merged by finish time and cut off
where the total budget, the size of all documents, is spent.

Cumulative sums run in two levels, so that no source is one task's work: the
shuffle key's leading digits are the buckets, bucket totals give each bucket's
base, and a window sums within a bucket. The cut is found by a histogram of
finish times that is refined until one bin is small enough to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, settle

#: Hexadecimal digits of the shuffle key that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: Bins of one histogram of finish times, and the rows that are sorted exactly.
BINS = 4096
EXACT_ROWS = 50_000


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(src, source_size, target): shares of the whole by weight, none above max_epochs times its size.

    Sources fill up in order of the level at which they reach their bound; the
    level is the excess-free share of one unit of weight. One row per source.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("src_null", "src")
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    bound = F.col("source_size") * max_epochs
    by_level = Window.orderBy(bound / F.col("weight"), "src_null", "src")
    filled = (
        ranked.withColumn("bound", bound)
        .withColumn("below", F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all") - F.col("below")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("below"), F.col("level"))))  # the first that stays below its bound
                    .over(everything)["level"])
    )
    return filled.select("src", "source_size", F.least(F.col("weight") * F.coalesce("level", F.lit(0.0)), F.col("bound").cast("double")).alias("target"))


def _cut(fin: DataFrame, budget: int, passes: int = 6) -> float:
    """The largest finish time at which the sizes up to and with it stay within the budget.

    ``fin`` has finish and size. Only one row a pass comes to the driver.
    """
    lo, width, before = 0.0, 2.0, 0
    for _ in range(passes):
        step = width / BINS
        inside = fin.filter(F.col("finish") > lo) if lo else fin
        bins = inside.filter(F.col("finish") <= lo + width).groupBy(F.least(F.floor((F.col("finish") - lo) / step), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        over = bins.withColumn("upto", F.sum("size").over(upto) + before).filter(F.col("upto") > budget).orderBy("bin").first()
        if over is None:
            return lo + width
        # One bin's width is left on both sides, where rounding could put a neighbour.
        start, end = lo + (over["bin"] - 1) * step, lo + (over["bin"] + 2) * step
        lo, width = max(lo, start), end - max(lo, start)
        before = fin.filter(F.col("finish") <= lo).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] if lo > 0 else 0
        if over["n"] <= EXACT_ROWS:
            break
    near = fin.filter((F.col("finish") > lo) & (F.col("finish") <= lo + width)) if lo > 0 else fin.filter(F.col("finish") <= width)
    near = near.groupBy("finish").agg(F.sum("size").alias("size"))
    upto = Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)
    last = near.withColumn("upto", F.sum("size").over(upto) + before).filter(F.col("upto") <= budget).agg(F.max("finish")).first()[0]
    return lo if last is None else last


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, taken.

    Sources in code-point order, null last, weigh ``weights`` repeating. size is
    the word count of the text (null: 0) unless given; taken is size times the
    epochs in which the document is within the cut, ``taken = 0`` if none.
    Documents with equal finish time are taken together or not at all. Columns
    with the added names are replaced; rows that repeat an id are documents of
    their own, in order of size and text; a null id shuffles as the text "null";
    texts of any length count in full; an empty table gives an empty result.
    Reruns agree: the shuffle key is a hash of the id and ``seed``.
    """
    added = ("size", "source_size", "target", "taken")
    base = docs.drop(*added, "__src", "__key", "__bucket", "__before", "__tie", "__cum")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    base = base.withColumns({"size": word_count(text_col) if size is None else size, "__src": F.coalesce(F.concat(F.lit("="), source_col), F.lit("")), "__key": key, "__tie": F.xxhash64(text_col) if text_col in docs.columns else F.lit(0).cast("long")}).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    sizes = settle(base.select(F.col("__src"), F.col("__key"), F.col("__bucket"), F.col(id_col).alias("__id"), "__tie", "size"))
    buckets = sizes.groupBy("__src", "__bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    totals = sizes.groupBy(F.col("__src").alias("src")).agg(F.sum("size").alias("source_size")).withColumn("src_null", F.col("src") == "")
    targets = _targets(totals, weights, max_epochs)
    plan = settle(buckets.join(targets, F.col("__src") == F.col("src")).drop("src"))

    def with_finish(rows: DataFrame, id_name: str) -> DataFrame:
        within = Window.partitionBy("__src", "__bucket").orderBy("__key", id_name, "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("__cum", F.sum("size").over(within)).join(plan, ["__src", "__bucket"]).withColumn("__cum", F.col("__cum") + F.col("__before"))

    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))

    def finish(e: Column) -> Column:
        return (e * F.col("source_size") + F.col("__cum")) / F.col("target")

    budget = totals.agg(F.sum("source_size")).first()[0] or 0
    timed = settle(with_finish(sizes, "__id").filter("size > 0 and target > 0").select("size", F.explode(F.transform(epochs, finish)).alias("finish")))
    cut = _cut(timed, budget) if budget else -1.0
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * F.size(F.filter(epochs, lambda e: finish(e) <= F.lit(cut)))).otherwise(F.lit(0)).cast("long")
    rows = sizes.withColumnRenamed("__id", id_col) if set(docs.columns) <= {id_col} else base
    return with_finish(rows, id_col).withColumn("taken", taken).select(*[c for c in docs.columns if c not in added], *added)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken, columns as in ``docs``."""
    columns = docs.columns
    mixed = mix(docs, **options).filter("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return mixed.select(*columns)
