"""Trigrams of letters counted in tasks, and the language whose profile makes a text likeliest.

A trigram is one integer, three code points of 21 bits. Texts of any length are
cut into slices of a bounded number of characters, and profiles are sums, so
work grows with the characters and no row is made for a single trigram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import maps

#: Characters that are counted at once.
SLICE = 500_000
#: Profiles of up to this many trigrams, those of all languages together, are sent to the tasks; larger ones are joined by shuffle.
PROFILE_BROADCAST = 1_000_000


def _slices(texts: Iterable[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners and trigrams of (owner, text), in slices. Texts are runs of letters with one space between them."""
    owners, pieces, size = [], [], 0

    def cut() -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(" ".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        inside = points != 32
        kept = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:])
        owner = np.repeat(np.array(owners, dtype=np.int64), [len(p) + 1 for p in pieces])
        return owner[kept], points[kept] << 42 | points[kept + 1] << 21 | points[kept + 2]

    for owner, text in texts:
        for lo in range(0, len(text), SLICE):
            pieces.append(text[lo : lo + SLICE + 2])
            owners.append(owner)
            size += len(pieces[-1])
            if size >= SLICE:
                yield cut()
                owners, pieces, size = [], [], 0
    if pieces:
        yield cut()


def _letters(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.filter("text is not null").select(*columns, F.regexp_replace(F.lower("text"), r"\P{L}+", " ").alias("__letters"))


def profiles(docs: DataFrame, lang_col: str) -> DataFrame:
    """(lang, g, n): how often each trigram occurs in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            index = {n: i for i, n in enumerate(dict.fromkeys(names))}
            for lang, i in index.items():
                of = ((i, t.as_py()) for n, t in zip(names, b.column(1), strict=True) if n == lang)
                for _, codes in _slices(of):
                    g, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "g", "n"])

    rows = _letters(docs.filter(F.col(lang_col).isNotNull()), lang_col).mapInArrow(run, "lang string, g long, n long")
    return rows.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _gained(docs: DataFrame, id_col: str, known: pa.Table) -> DataFrame:
    """(id_col, lang, gained, n): a row a text with the number of its trigrams, and a row a language that knows any of them."""
    langs = sorted(set(known.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(langs)}
    g, lang = known.column("g").to_numpy(), np.array([place[x] for x in known.column("lang").to_pylist()], dtype=np.int64)
    order = np.argsort(g, kind="stable")
    codes, first = np.unique(g[order], return_index=True)
    sent = docs.sparkSession.sparkContext.broadcast((codes, np.append(first, len(g)), lang[order], known.column("gain").to_numpy()[order].astype(np.float64), langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, first, lang, gain, langs = sent.value
        width = len(langs)
        for b in batches:
            size = b.num_rows
            total, gained, met = np.zeros(size, np.int64), np.zeros(size * width, np.int64), np.zeros(size * width, bool)
            for owner, found in _slices((i, t.as_py()) for i, t in enumerate(b.column(1))):
                total += np.bincount(owner, minlength=size)
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                hit = codes[at] == found
                at, owner = at[hit], owner[hit]
                many = first[at + 1] - first[at]
                entry = np.arange(many.sum()) + np.repeat(first[at] - (np.cumsum(many) - many), many)
                key = np.repeat(owner, many) * width + lang[entry]
                # Sums of whole numbers below 2^53: exact as doubles.
                lo, hi = (int(key.min()), int(key.max()) + 1) if len(key) else (0, 0)
                gained[lo:hi] += np.bincount(key - lo, gain[entry], minlength=hi - lo).astype(np.int64)
                met[key] = True
            cell = np.flatnonzero(met)
            owner = np.concatenate([np.arange(size), cell // width])
            name = pa.concat_arrays([pa.nulls(size, pa.string()), pa.array(langs, pa.string()).take(pa.array(cell % width))])
            columns = [b.column(0).take(pa.array(owner)), name, pa.array(np.concatenate([np.zeros(size, np.int64), gained[cell]])), pa.array(np.concatenate([total, np.zeros(len(cell), np.int64)]))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "lang", "gained", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _letters(docs, id_col).mapInArrow(run, f"`{id_col}` {kind}, lang string, gained long, n long")


def _gained_by_join(docs: DataFrame, id_col: str, weights: DataFrame) -> DataFrame:
    """The same by a join of each text's trigrams with profiles of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1)):
                for _, codes in _slices([(0, t.as_py())]):
                    g, k = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(g), i))), pa.array(g), pa.array(k.astype(np.int64))], [id_col, "g", "k"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = _letters(docs, id_col).mapInArrow(run, f"`{id_col}` {kind}, g long, k long")
    met = counted.join(weights, "g").select(id_col, "lang", (F.col("k") * F.col("gain")).alias("gained"), F.lit(0).cast("long").alias("n"))
    return met.unionByName(counted.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("gained"), F.col("k").alias("n")))


def likeliest(docs: DataFrame, id_col: str, lang_col: str, most: int = PROFILE_BROADCAST) -> DataFrame:
    """(id_col, n_trigrams, guess, score) of every text that has a trigram of a known language; equal scores: the first name.

    Logs are rounded to units of 1e-6 and summed as integers. Rows of one id are one text.
    """
    profile = profiles(docs, lang_col)
    totals = profile.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    base = F.round(F.log(1 / (F.col("total") + F.col("kinds"))) * 1e6).cast("long")
    gain = F.round(F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))) * 1e6).cast("long") - base
    weights = profile.join(maps.small(totals), "lang").select("lang", "g", gain.alias("gain"))
    known = weights.limit(most + 1).toArrow()
    if not known.num_rows:
        rows = docs.limit(0).select(id_col, F.col(lang_col).alias("lang"), F.lit(0).cast("long").alias("gained"), F.lit(0).cast("long").alias("n"))
    else:
        rows = _gained(docs, id_col, known) if known.num_rows <= most else _gained_by_join(docs, id_col, weights)
    per = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col, "lang").agg(F.sum("gained").alias("gained"), F.sum("n").alias("n"))
    per = per.join(maps.small(totals.select("lang", base.alias("base"))), "lang", "left")
    # As many entries as there are languages.
    of = per.groupBy(id_col).agg(F.sum("n").alias("n_trigrams"), F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("gained", "base", "lang"))).alias("of"))
    best = F.array_min(F.transform("of", lambda x: F.struct((-(x["gained"] + F.col("n_trigrams") * x["base"])).alias("neg"), x["lang"].alias("lang"))))
    return of.filter(F.size("of") > 0).select(id_col, "n_trigrams", best.alias("b")).select(id_col, "n_trigrams", F.col("b.lang").alias("guess"), (-F.col("b.neg")).alias("score"))
