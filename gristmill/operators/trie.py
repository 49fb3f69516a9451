"""Many fixed patterns in one pass: an Aho-Corasick automaton a shard of the pattern table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns and characters of one shard; its automaton takes some 100 bytes a character.
SHARD_PATTERNS, SHARD_CHARACTERS = 200_000, 2_000_000
#: Rows of a batch of output, roughly.
ROWS = 50_000

_built: dict[tuple, object] = {}


def _automaton(patterns: list[str]):
    """The automaton of a shard, kept by the worker for its next tasks; one at a time."""
    import ahocorasick

    key = (len(patterns), hash(tuple(patterns)))
    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for p in patterns:
            a.add_word(p, p)
        a.make_automaton()
        _built[key] = a
    return _built[key]


def occurrences(texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern_col: str = "pattern", ignore_case: bool = False, first_only: bool = False) -> DataFrame:
    """(id_col, pattern, start, end): every place where a pattern occurs, overlapping ones too, in code points.

    ``patterns`` are counted first. Up to ``SHARD_PATTERNS`` rows of
    ``SHARD_CHARACTERS`` together they are one automaton; a larger table is dealt
    to shards by hash, each with a pass of its own over the texts, so that no task
    holds more than one shard. ``ignore_case`` folds A to Z on both sides.
    ``first_only`` keeps the first place of each pattern in each row.
    Null and empty patterns and null texts have no places; repeated patterns
    count once; repeated rows and ids are kept; other columns are ignored.
    """

    def fold(c):
        return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if ignore_case else F.col(c)

    known = patterns.select(fold(pattern_col).alias("pattern")).filter("pattern <> ''").distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("characters")).first()
    shards = max(1, -(-size["n"] // SHARD_PATTERNS), -(-size["characters"] // SHARD_CHARACTERS))
    rows = texts.select(id_col, fold(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    context = texts.sparkSession.sparkContext

    def scan(k: int) -> DataFrame:
        own = sorted(r["pattern"] for r in (known if shards == 1 else known.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k)).collect())
        shared = context.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not shared.value:
                    return
                find, owner, word, end = _automaton(shared.value).iter, [], [], []

                def found(b=b, owner=owner, word=word, end=end) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(word), pa.array([e - len(w) for e, w in zip(end, word, strict=True)], pa.int64()), pa.array(end, pa.int64())], [id_col, "pattern", "start", "end"])

                for i, text in enumerate(b.column(1)):
                    text, seen = text.as_py(), set()
                    for last, p in find(text) if text else ():
                        if first_only:
                            if p in seen:
                                continue
                            seen.add(p)
                        owner.append(i)
                        word.append(p)
                        end.append(last + 1)
                        if len(owner) >= ROWS:
                            yield found()
                            owner.clear(), word.clear(), end.clear()
                if owner:
                    yield found()

        return rows.mapInArrow(run, f"`{id_col}` {kind}, pattern string, start long, end long")

    return reduce(DataFrame.unionByName, [scan(k) for k in range(shards)])
