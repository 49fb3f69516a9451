"""Audit of how the sources of a language differ in the terms they use.

The share of each term in each source is compared with its share in every other
source and in the whole language. Terms that occur equally often in every
source (one sparse vector of counts by source) contribute alike, so everything
is worked out once for each distinct vector and multiplied by the number of its
terms; only the ranking goes back to the terms themselves. Vectors are named by
128 bits of hash, so no vector is ever gathered in one place.

Most counts are nought. A pair's sum over all kept terms starts from "both
nought" for every term; corrections follow for the terms of one source (by its
histogram of shares) and for those of both (by joining the vectors' entries).
Shares are whole numbers: parts of 1,000,000,000, rounded down, plus one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import lookup, settle

#: Every ASCII letter to its lower case, every other ASCII character to a space; the rest stays.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are split into terms at a time.
STEP = 4_000_000
#: A task hands on its counts when it holds so many terms.
HELD = 400_000
#: Groups are joined by broadcast up to this many rows of about 60 bytes.
GROUPS_BROADCAST = 200_000
#: Parts into which the pairs of one language are dealt.
SALT = 16


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, portion by portion; portions end at spaces."""
    raw = text.encode().translate(_FOLD)
    lo = 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + STEP) if lo + STEP < len(raw) else -1
        hi = len(raw) if hi < 0 else hi
        yield raw[lo:hi].split()
        lo = hi


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within each task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                found = list(n)
                yield pa.record_batch(
                    [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in found], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for part in terms(text):
                    n.update(part)
                    own.update(part)
                df.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from handed_on()
        yield from handed_on()

    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)); null for a language without terms."""
    return F.expr(f"CASE WHEN vocabulary > 0 THEN 1 + (cast({n} + 1 AS decimal(19, 0)) * 1000000000BD) DIV cast({total} + vocabulary AS decimal(20, 0)) END")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV {q}"


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of lang and source.

    Part ``pair``: item is another source of the language, value the sum of
    floor((p - q)^2 / q) over all terms that at least ``least_docs`` documents of
    the language hold, p this source's share and q the other's; all ranks. Part
    ``term``: item is a term that is more frequent here than in the language,
    value that term of the sum against the language; ranks to ``ranks``.

    Null text, lang and source are empty ones; empty texts have no terms; a
    language without kept terms gives pairs of value 0 and no terms. Every row
    is a document, repeated rows and ids included; equal values rank by item,
    so there are no ties. An empty table gives no rows. Only lang, source and
    text are read, whatever other columns there are. A sum beyond 64 bits is
    an error, not a wrong value.
    """
    groups = settle(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    counts = settle(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.bit_xor(F.xxhash64("source", "n")).alias("v1"), F.bit_xor(F.xxhash64(F.lit("second"), "n", "source")).alias("v2")
    )
    kept = settle(by_term.filter(F.col("docs") >= least_docs).drop("docs"))
    distinct = kept.groupBy("lang", "v1", "v2").agg(F.count("*").alias("times"), F.min("term").alias("term"), F.first("lang_n").alias("lang_n"))
    entries = settle(counts.drop("docs").join(distinct, ["lang", "term"]).drop("term"))

    totals = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    sizes = settle(sizes.withColumn("none", _share("0", "total")))

    shares = lookup(entries, sizes, ["lang", "source"], "inner", GROUPS_BROADCAST)
    shares = settle(shares.select("lang", "v1", "v2", "source", "times", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"), "none"))
    pairs = _pairs(sizes, shares)
    tops = _terms(kept, shares, ranks)
    return pairs.unionByName(tops)


def _pairs(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """The sum of every ordered pair of sources of a language, and its rank."""
    here = sizes.select("lang", "source", F.col("none").alias("p0"), "vocabulary", F.pmod(F.xxhash64("source"), F.lit(SALT)).alias("salt"))
    there = sizes.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("salt"))
    both = settle(here.join(there, ["lang", "salt"]).filter("source != item").drop("salt").withColumn("base", F.expr(_gap("p0", "q0"))))

    shown = shares.groupBy("lang", "source", "p").agg(F.sum("times").alias("times"))
    of_source = both.join(shown, ["lang", "source"]).select("lang", "source", "item", F.expr(f"times * ({_gap('p', 'q0')} - base)").alias("value"))
    of_item = both.join(shown.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr(f"times * ({_gap('p0', 'p')} - base)").alias("value"))
    one = shares.select("lang", "v1", "v2", "source", "times", "p", F.col("none").alias("p0"))
    other = shares.select("lang", "v1", "v2", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("q0"))
    shared = one.join(other, ["lang", "v1", "v2"]).filter("source != item")
    shared = shared.select("lang", "source", "item", F.expr(f"times * ({_gap('p', 'q')} - {_gap('p', 'q0')} - {_gap('p0', 'q')} + {_gap('p0', 'q0')})").alias("value"))
    start = both.select("lang", "source", "item", F.expr("CASE WHEN vocabulary > 0 THEN vocabulary * base ELSE 0 END").alias("value"))
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (of_source, of_item, shared)]
    summed = start.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, shares: DataFrame, ranks: int) -> DataFrame:
    """The terms of every group that stand out most against the language.

    The terms of one vector have one value and rank by themselves, so no more
    than the first ``ranks`` of each vector can be among the first of a group.
    """
    within = Window.partitionBy("lang", "v1", "v2").orderBy("term")
    first = kept.select("lang", "v1", "v2", "term", F.row_number().over(within).alias("place")).filter(F.col("place") <= ranks)
    more = shares.filter("p > q").select("lang", "v1", "v2", "source", F.expr(_gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = more.join(first, ["lang", "v1", "v2"]).select("lang", "source", F.col("term").alias("item"), "value")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
