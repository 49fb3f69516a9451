"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence, so that each element is distinct.
Their hashes deal them to ``BINS`` bins (one permutation serves all sketches);
of each bin the ``TUPLE`` least elements are put back into text order and hashed
together. Moving or editing text changes which elements are least, or their
order, so agreement of bins falls with edit distance and not just with the
overlap of the sets. Likeness is the share of agreeing bins among those that
are filled in either text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import settle
from gristmill.llm.wordhash import mix, slices

_U = np.uint64
K, BINS, TUPLE = 8, 64, 2
_BIN_BITS = BINS.bit_length() - 1
#: Elements kept for a bin before sorting, on average; texts that miss one are done in full.
_KEPT = 12.0
#: Characters of text that are hashed at once.
SLICE = 1_000_000
#: Rows that a run of neighbouring ids holds on average, and how many runs there are at most.
RUN_ROWS, RUNS = 1000, 1_000_000
#: Quantiles of the ids between which runs are equal stretches.
QUANTILES = 1000
#: An id with so many times RUN_ROWS rows is cut by the hash of the text; bits for its number.
HOT, HOT_BITS = 4, 20


def _elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, position, hash) of the occurrence-numbered k-mers; a shorter text is one k-mer."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    filled = np.concatenate([points, np.zeros(K, np.uint64)])
    start = np.cumsum(size) - size
    grams = np.maximum(size - K + 1, (size > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    place = at + start[owner]
    h = np.zeros(len(owner), dtype=np.uint64)
    short = (size < K)[owner]
    for j in range(K):
        c = filled[place + j] + _U(1)
        if short.any():
            c = np.where(short & (j >= size[owner]), _U(0), c)
        h = h * _U(0x9E3779B97F4A7C15) + c
    h = mix(h)
    key = h + owner.astype(np.uint64) * _U(0xD1B54A32D192ED03)
    order = np.argsort(key)
    same = np.zeros(len(order), dtype=bool)
    same[1:] = key[order][1:] == key[order][:-1]
    seen = np.zeros(len(order), dtype=np.uint64)
    if same.any():
        run = np.cumsum(~same)
        many = same | np.append(same[1:], False)
        rows, runs = order[many], run[many]
        by_place = np.lexsort((rows, runs))
        rows, runs = rows[by_place], runs[by_place]
        first = np.flatnonzero(np.diff(runs, prepend=-1))
        seen[rows] = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return owner, at, mix(h + seen * _U(0xA0761D6478BD642F))


def _bins(owner: np.ndarray, at: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled counts) per text and bin; value 0 marks an empty bin."""
    slot = owner * BINS + (e >> _U(64 - _BIN_BITS)).astype(np.int64)
    order = np.lexsort((e, slot))
    slot, at, e = slot[order], at[order], e[order]
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    count = np.diff(np.append(first, len(slot)))
    values, filled = np.zeros(n * BINS, dtype=np.uint64), np.zeros(n * BINS, dtype=np.int64)
    took = np.minimum(count, TUPLE)
    places = np.full((len(first), TUPLE), np.iinfo(np.int64).max)
    hashes = np.zeros((len(first), TUPLE), dtype=np.uint64)
    for j in range(TUPLE):
        live = took > j
        places[live, j], hashes[live, j] = at[first[live] + j], e[first[live] + j]
    hashes = np.take_along_axis(hashes, np.argsort(places, axis=1, kind="stable"), axis=1)
    out = np.zeros(len(first), dtype=np.uint64)
    for j in range(TUPLE):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[:, j] + _U(j + 1))
    values[slot[first]] = out % _U(65535) + _U(1)
    filled[slot[first]] = took
    return values.astype(np.uint16).reshape(n, BINS), filled.reshape(n, BINS)


def sketches(texts: list[str]) -> np.ndarray:
    """(texts, BINS) of 16-bit bin values."""
    if not texts:
        return np.zeros((0, BINS), np.uint16)
    owner, at, e = _elements(texts)
    n = np.bincount(owner, minlength=len(texts))
    share = np.minimum(1.0, _KEPT * BINS / np.maximum(n, 1))
    rank = ((e << _U(_BIN_BITS)) >> _U(12)).astype(np.float64) / 2.0**52
    kept = rank <= share[owner]
    values, filled = _bins(owner[kept], at[kept], e[kept], len(texts))
    missed = (filled < TUPLE).any(axis=1) & (share < 1)
    if missed.any():
        again = missed[owner]
        values[missed] = _bins(owner[again], at[again], e[again], len(texts))[0][missed]
    return values


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing bins among those filled in either; two empty texts are alike (1)."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def _hex(v: np.ndarray) -> list[str]:
    raw = v.astype(">u2").tobytes().hex()
    return [raw[i : i + 4 * BINS] for i in range(0, len(raw), 4 * BINS)]


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and fingerprint, 4 hex digits a bin. A null text counts as empty."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in slices(texts, SLICE):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_hex(sketches(texts[lo:hi])))], names=[*part.schema.names, "fingerprint"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, fingerprint string")


def _with_stretch(rows: DataFrame) -> DataFrame:
    """``rows`` and stretch, a number that never falls as the id grows; -1 for null.

    Quantiles of the ids bound the ranges, so that outlying ids do not matter, and
    each range is cut into equal stretches. All in doubles, which cannot overflow
    and keep the order. An id that fills a whole range has one of its own.
    """
    n = rows.count()
    ranges = max(1, min(QUANTILES, n // RUN_ROWS))
    per_range = max(1, min(RUNS, n // RUN_ROWS) // ranges)
    found = rows.select("id").approxQuantile("id", [k / ranges for k in range(ranges + 1)], 0.25 / ranges) if n else []
    bounds = sorted({*found, *(math.nextafter(b, math.inf) for b in found if found.count(b) > 1)}) or [0.0]
    at = F.col("id").cast("double")
    inside = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__at", outputCol="__range", handleInvalid="keep").transform(rows.withColumn("__at", at))
    place = F.col("__range").cast("int")
    start = F.coalesce(F.get(F.lit(bounds), place - 1), F.lit(bounds[0]))
    end = F.coalesce(F.get(F.lit(bounds), place), F.lit(bounds[-1]))
    share = F.when(end > start, (at - start) / (end - start)).otherwise(0.0)
    inner = F.greatest(F.lit(0), F.least(F.floor(share * per_range), F.lit(per_range - 1)))
    return inside.withColumn("stretch", F.when(F.col("id").isNull(), -1).otherwise(place * F.lit(per_range).cast("long") + inner).cast("long")).drop("__at", "__range")


def in_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, tail, id, text): runs of neighbouring ids, sorted, each closed by the next run's first row.

    The closing row has tail = 1; the last run is closed by the very first row.
    Null ids come first; equal ids are ordered by text, and where there are many,
    first by its hash, which then cuts their run too. Only the text is shuffled,
    once; the runs' first ids, at most some ``RUNS`` rows by construction, are
    broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _with_stretch(rows)
    held = rows.groupBy("stretch").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    hot = settle(held.filter((F.col("n") >= HOT * RUN_ROWS) & F.col("low").eqNullSafe(F.col("high"))).select("stretch", F.least(F.ceil(F.col("n") / RUN_ROWS), F.lit(1 << HOT_BITS)).alias("parts")))
    if hot.isEmpty():
        rows = rows.select(F.shiftleft(F.col("stretch") + 1, HOT_BITS).alias("run"), F.lit(0).cast("long").alias("part"), "id", "text")
    else:
        order = F.when(F.col("parts").isNotNull(), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(0)
        rows = rows.join(F.broadcast(hot), "stretch", "left").withColumn("part", order)
        rows = rows.select((F.shiftleft(F.col("stretch") + 1, HOT_BITS) + F.floor(F.col("part") / 2.0**62 * F.coalesce("parts", F.lit(1)))).alias("run"), "part", "id", "text")
    firsts = rows.groupBy("run").agg(F.min(F.struct("id", "part")).alias("first")) if not hot.isEmpty() else rows.groupBy("run").agg(F.struct(F.min("id").alias("id"), F.lit(0).cast("long").alias("part")).alias("first"))
    order = Window.orderBy("run")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select("run", "first.id", "first.part", F.coalesce(F.lag("run").over(order), F.max("run").over(everything)).alias("receiver"))
    same = F.col("h.id").eqNullSafe(F.col("r.id")) & (F.col("h.run") == F.col("r.run")) & (F.col("h.part") == F.col("r.part"))
    heads = rows.alias("r").join(F.broadcast(before).alias("h"), same).groupBy(F.col("h.receiver").alias("run"), F.col("h.id").alias("id")).agg(F.min("r.text").alias("text"))
    both = rows.select("run", F.lit(0).alias("tail"), "part", "id", "text").unionByName(heads.select("run", F.lit(1).alias("tail"), F.lit(0).cast("long").alias("part"), "id", "text"))
    return both.repartition("run").sortWithinPartitions("run", "tail", F.col("id").asc_nulls_first(), "part", "text").select("run", "tail", "id", "text")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Edited: the last floor(n/4) code points give way to as many first ones of
    the next document by id (after the last comes the first). Columns: id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty; rows that repeat an id are documents of
    their own; null ids come first; ids may be any 64-bit numbers; texts of any
    length are taken whole; other columns are ignored; an empty table gives an
    empty result.
    """
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judged(ids: list, runs: list, tails: list, texts: list[str], marks: np.ndarray) -> pa.RecordBatch:
        own = [i for i in range(len(ids) - 1) if not tails[i]]
        cut = [len(texts[i]) // 4 for i in own]
        edited = [texts[i][: len(texts[i]) - q] + texts[i + 1][:q] for i, q in zip(own, cut, strict=True)]
        changed = sketches(edited)
        a, b = marks[own], marks[[i + 1 for i in own]]
        return pa.record_batch(
            [
                pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array(_hex(a), pa.string()), pa.array(_hex(changed), pa.string()), pa.array(likeness(a, changed)), pa.array(likeness(a, b)),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        marks = np.zeros((0, BINS), np.uint16)
        weight = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, marks, weight
            marks = np.concatenate([marks, sketches(held[3][len(marks) :])])
            out = judged(*held, marks)
            held, marks, weight = [x[-1:] for x in held], marks[-1:], 0
            return out

        for b in batches:
            runs, tails, ids, texts = (b.column(k).to_pylist() for k in range(4))
            for row in zip(ids, runs, tails, texts, strict=True):
                for k, v in enumerate(row):
                    held[k].append(v)
                weight += len(row[3])
                if weight >= SLICE or len(held[0]) >= 5000:
                    yield flush()
        if held[0]:
            yield flush()

    return in_runs(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
