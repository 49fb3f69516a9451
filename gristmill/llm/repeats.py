"""Removal of bytes covered by long strings that occur more than once.

The work is that of a sparse suffix sort: a *sample* of positions is sorted by
the text that follows them, equal neighbours are found, and all other positions
are placed through the sampled position next to them.

The sample is chosen by content: the sampled position of a window of ``length``
bytes is the place of the least k-gram hash among its first ``SPAN`` starts.
Equal windows thus have their sample at the same distance, and the windows that
share a sample at ``a`` start in one interval [s, e] and all hold the bytes
[a, a + length - SPAN + 1). Rows with that *core* in common are brought together:

* a core that occurs once rules out all its windows;
* rows that agree on all bytes of [s, e + length) repeat each other as a whole;
* only where cores agree and surroundings differ, at the edges of repeated
  passages, are single windows written out, one row a window start, for one row
  of each distinct surrounding, and counted by their own hash.

Texts that are equal as a whole are one text here, named by 128 bits of their
SHA-256. Cores and surroundings together, and single windows, are compared by
two 64-bit hashes each.

Two lengths are looked for, one inside the other. The shorter one finds passages
of some fifty words, which are reported but not removed; only stretches made of
such repeats can hold a repeat of the longer one, so the second search reads
those alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, settle
from gristmill.llm.wordhash import _BYTE_CODE, _power_table, mix

_U = np.uint64
#: Window starts among which a sample is chosen (a power of two), and the bytes hashed for the choice.
SPAN, GRAM = 128, 16
#: Bits that hold a place within a piece; longer texts are cut into overlapping pieces.
PLACE_BITS = 23
PIECE = 1_000_000
#: Keys up to this many are broadcast (16 bytes each), else joined by shuffle.
KEYS_BROADCAST = 500_000
#: The two columns that name a text.
KEY = ["k1", "k2"]
_SPANS = "array<struct<s:bigint,e:bigint,across:boolean>>"
#: Byte codes of the second hash.
_OTHER_CODE = mix(np.arange(1001, 1257, dtype=np.uint64))


def _hash(run: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((run[end] - run[start]) * down[start])


def _prefix(raw: np.ndarray, code: np.ndarray = _BYTE_CODE) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_table(len(raw) + 1)
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(code[raw] * up[: len(raw)], out=run[1:])
    return run, down


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, owner, place in text, start in bytes) of pieces laid end to end; together about PIECE bytes."""
    held, owner, place, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            held.append(part)
            owner.append(i)
            place.append(at)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(owner), np.array(place), np.cumsum([0, *map(len, held)])
                held, owner, place, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(owner), np.array(place), np.cumsum([0, *map(len, held)])


def samples(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, first start, last start, core hash, hash of all its windows' bytes) of every sample."""
    core = length - SPAN + 1
    for raw, owner, place, bounds in _pieces(texts, length):
        run, down = _prefix(raw)
        n = len(raw)
        grams = n - GRAM + 1
        key = (run[GRAM:] - run[:grams]) * down[:grams]
        key = mix(key)
        key >>= _U(PLACE_BITS)
        key <<= _U(PLACE_BITS)
        key |= np.arange(grams, dtype=np.uint64)
        step = 1
        while step < SPAN:  # the least key of the next 2, 4, ... SPAN places
            key = np.minimum(key[: len(key) - step], key[step:])
            step *= 2
        at = (key & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(at))
        piece = np.searchsorted(bounds, starts, side="right") - 1
        whole = starts + length <= bounds[piece + 1]
        starts, at, piece = starts[whole], at[whole], piece[whole]
        edge = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]))) if len(at) else np.zeros(0, np.int64)
        s, e, a, p = starts[edge], starts[np.append(edge[1:], len(at)) - 1] if len(at) else edge, at[edge], piece[edge]
        around = mix(_hash(run, down, s, e + length) + ((a - s).astype(np.uint64) << _U(20)) + (e - s).astype(np.uint64))
        shift = place[p] - bounds[p]
        yield owner[p], s + shift, e + shift, _hash(run, down, a, a + core), around


def windows(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, other hash) of all windows that start within the inclusive spans."""
    out_at, out_hash, out_other = [], [], []
    spans = sorted(spans)
    i = 0
    while i < len(spans):  # spans that lie close together are hashed in one go
        lo, hi, j = spans[i][0], spans[i][1], i + 1
        while j < len(spans) and spans[j][1] - lo < PIECE and spans[j][0] <= hi + 4 * length:
            hi, j = max(hi, spans[j][1]), j + 1
        raw = np.frombuffer(text[lo : hi + length], np.uint8)
        at = np.concatenate([np.arange(s, e + 1) for s, e in spans[i:j]]) - lo
        out_at.append(at + lo)
        for code, out in ((_BYTE_CODE, out_hash), (_OTHER_CODE, out_other)):
            run, down = _prefix(raw, code)
            out.append(_hash(run, down, at, at + length))
        i = j
    return np.concatenate(out_at), np.concatenate(out_hash), np.concatenate(out_other)


def merged(spans: list[dict], least: int = 0) -> list[list[int]]:
    """Maximal runs of byte spans; spans are of one run if they share ``least`` bytes."""
    runs: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if runs and s + least <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def _sampled(length: int, shorter: int):
    """Rows to be shuffled: one for each distinct pair of core and surroundings of a batch, with its count.

    Samples that repeat within the batch are known to be repeated windows at
    once; they come out with ``sent`` false for all but the first of them, so a
    passage that fills the input reaches the shuffle once a batch. Where spans of
    repeats of the ``shorter`` length are given, only stretches in which every
    shorter window is repeated are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            pieces, of, base = [], [], []
            for i, (t, spans) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                raw = t.encode("utf-8", "surrogatepass")
                for s, e in [(0, len(raw))] if spans is None else merged(spans, shorter - 1):
                    if e - s >= length:
                        pieces.append(raw[s:e])
                        of.append(i)
                        base.append(s)
            parts = list(samples(pieces, length))
            if not parts:
                continue
            owner, s, e, core, around = (np.concatenate(x) for x in zip(*parts, strict=True))
            row, shift = np.array(of)[owner], np.array(base)[owner]
            order = np.lexsort((row, around, core))
            new = np.append(True, (core[order][1:] != core[order][:-1]) | (around[order][1:] != around[order][:-1]))[: len(order)]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            sent, count, held = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
            sent[order] = new
            count[order] = np.repeat(times, times)
            other = np.append(True, row[order][1:] != row[order][:-1])[: len(order)] | new
            held[order] = np.repeat(np.add.reduceat(other.astype(np.int64), first), times)
            yield pa.record_batch([pa.array(core.view(np.int64)), pa.array(around.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]), pa.array(s + shift), pa.array(e + shift), pa.array(count), pa.array(held), pa.array(sent)], ["core", "around", *KEY, "s", "e", "count", "texts", "sent"])

    return run


def _windowed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, text, spans in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for lone in (True, False):
                    some = [(x["s"], x["e"]) for x in spans if x["lone"] == lone]
                    if some:
                        at, h, g = windows(raw, some, length)
                        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2)), pa.array(at), pa.array(np.full(len(at), lone))], ["h", "g", *KEY, "at", "lone"])

    return run


def _cut(words: int, shorter: int):
    """Per text: bytes removed, maximal removed runs, the hash of what is left, and whether a stretch of which every ``shorter`` bytes repeat has over ``words`` words."""

    def passage(raw: bytes, s: int, e: int) -> bool:
        held = len(raw[s:e].split())
        held -= bool(s and raw[s - 1 : s].strip() and raw[s : s + 1].strip())
        return held - bool(e < len(raw) and raw[e : e + 1].strip() and raw[e - 1 : e].strip()) > words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k1, k2, text, near, spans in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs = merged(spans or [])
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((k1, k2, sum(e - s for s, e in runs), len(runs), kept.hexdigest(), any(passage(raw, s, e) for s, e in merged([x for x in near if x["across"]], shorter - 1))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], [*KEY, "n_removed", "n_spans", "kept_sha256", "passage"])

    return run


def _in(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the key, by broadcast if the keys are provably few."""
    few = keys.count() <= KEYS_BROADCAST
    return rows.join(F.broadcast(keys) if few else keys, KEY, how)


def repeated_spans(texts: DataFrame, length: int, within: DataFrame | None = None, shorter: int = 0) -> DataFrame:
    """(k1, k2, spans) of the texts in which a string of ``length`` bytes starts that also starts elsewhere; across: in another text.

    ``texts`` has k1, k2 and text, each text once. ``within`` is the result for
    the ``shorter`` length, where that is at hand.
    """
    rows = texts.withColumn("spans", F.lit(None).cast(_SPANS)) if within is None else _in(texts, within.select(*KEY), "left_semi").join(within, KEY)
    by_core, by_both = Window.partitionBy("core"), Window.partitionBy("core", "around")
    sampled = settle(rows.select(*KEY, "text", "spans").mapInArrow(_sampled(length, shorter), "core long, around long, k1 long, k2 long, s long, e long, count long, texts long, sent boolean"))
    met = (
        sampled.filter("sent")
        .withColumns({"n": F.sum("count").over(by_core), "low": F.min("around").over(by_core), "high": F.max("around").over(by_core)})
        .filter("n > 1")
        .withColumns({"same": F.sum("count").over(by_both), "texts": F.sum("texts").over(by_both), "nth": F.row_number().over(by_both.orderBy(*KEY, "s"))})
        .withColumn("least", F.min("texts").over(by_core))
        .select(*KEY, "s", "e", "count", "same", "texts", (F.col("texts") == 1).alias("lone"), ((F.col("low") != F.col("high")) & (F.col("least") == 1) & (F.col("nth") == 1)).alias("open"))
    )
    met = settle(met)
    span = (*KEY, "s", (F.col("e") + length).alias("e"), (F.col("texts") > 1).alias("across"))
    whole = met.filter("same > 1").select(*span).unionByName(sampled.filter("count > 1 and not sent").select(*span))
    same = Window.partitionBy("h", "g")
    todo = settle(met.filter("open").groupBy(*KEY).agg(F.collect_list(F.struct("s", "e", "lone")).alias("spans")))
    found = (
        _in(texts, todo.select(*KEY), "left_semi")
        .join(todo, KEY)
        .select(*KEY, "text", "spans")
        .mapInArrow(_windowed(length), "h long, g long, k1 long, k2 long, at long, lone boolean")
        .withColumns({"n": F.count("*").over(same), "across": F.min(F.struct(*KEY)).over(same) != F.max(F.struct(*KEY)).over(same)})
        .filter("n > 1 and lone")
        .select(*KEY, F.col("at").alias("s"), (F.col("at") + length).alias("e"), "across")
    )
    return settle(whole.unionByName(found).groupBy(*KEY).agg(F.collect_list(F.struct("s", "e", "across")).alias("spans")))


def remove_repeats(docs: DataFrame, length: int = 400, passage_length: int = 250, passage_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id_col, n_bytes, n_removed, n_spans, kept_sha256, repeats_passage.

    A byte is removed if a string of ``length`` UTF-8 bytes that covers it also
    starts at any other place of the input, in the same text or another.
    repeats_passage tells whether a stretch in which every ``passage_length``
    bytes (fifty words of five bytes) start in another text too has over
    ``passage_words`` whole words; such passages are often shorter than ``length`` and then stay. Null texts are empty; shorter texts keep all; rows
    that repeat an id, or a whole text, are texts of their own, so both lose all
    their bytes if long enough. Texts of any length are read whole, in pieces of
    a million bytes. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    if not SPAN + GRAM <= passage_length <= length:
        raise ValueError(f"{SPAN + GRAM} <= passage_length <= length must hold")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumns({k: F.xxhash64(F.lit(k), "sha") for k in KEY})
    profile = settle(base.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", *KEY))
    copied = settle(profile.filter(F.col("n_bytes") >= passage_length).groupBy(*KEY).count().filter("count > 1").select(*KEY))
    long_texts = base.filter(F.octet_length("text") >= passage_length).select(*KEY, "text")
    single = _in(long_texts, copied, "left_anti")
    twice = settle(_in(long_texts, copied, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text")))
    texts = single.unionByName(twice)
    near = repeated_spans(texts, passage_length)
    spans = repeated_spans(texts, length, near, passage_length)
    rows = _in(single, near.select(*KEY), "left_semi").join(near.withColumnRenamed("spans", "near"), KEY).join(spans, KEY, "left")
    cut = settle(rows.select(*KEY, "text", "near", "spans").mapInArrow(_cut(passage_words, passage_length), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, passage boolean"))
    out = profile.join(cut, KEY, "left")
    marked = twice.select(*KEY, (F.regexp_count("text", F.lit(WORD)) > passage_words).alias("gone"))
    out = out.join(F.broadcast(marked) if copied.count() <= KEYS_BROADCAST else marked, KEY, "left")
    gone = F.col("gone").isNotNull() & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.coalesce("gone", "passage", F.lit(False)).alias("repeats_passage"),
    )
