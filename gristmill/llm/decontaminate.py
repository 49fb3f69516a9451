"""Benchmark decontamination by template canonicalisation.

Tokens are lower-cased and stripped of outer punctuation; numbers, units and
names become typed placeholders, those of one type in a row a single one, so a
question that was only re-parameterised keeps its template. A capitalised first
word of a sentence may be a name or not: benchmark texts are read both ways.
Every window of ``width`` template tokens is hashed, and document windows are
hash-joined with benchmark windows. Windows of one item on neighbouring diagonals
of a document form an alignment, so that words put in or left out do not split
it; it counts as a copy if it covers enough of the item's windows and its slots
are consistent: one benchmark value always faces one document value, and the
reverse. Items too short for a window, or with too few literal words for any,
are compared by windows of their very words instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import settle
from gristmill.llm.wordhash import mix, slices

_U = np.uint64
#: Bits of the bit map of benchmark windows that every task holds: 2 MiB whatever the benchmark's size.
MAP_BITS = 24
#: Benchmark windows up to this many are broadcast (about 100 bytes each), else joined by shuffle.
WINDOWS_BROADCAST = 200_000
#: Templates with fewer literal tokens than this say too little; items without any other are matched word by word.
LEAST_LITERALS = 3
#: Added to the number of words, this is the form of windows that hold their very words.
EXACT = 2
#: Added to the number of tokens, this is the form of templates that are shorter than a window.
SHORT = 1_000
#: Words a worker remembers; it starts afresh beyond that.
REMEMBERED = 500_000

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_QUANTITY = re.compile(r"[+-]?\d[\d.,]*[^\W\d_]{1,4}")
#: Units of measure that are placeholders of their own.
UNITS = frozenset("mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs oz ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kph km/h m/s hz khz mhz ghz w kw kwh j kj cal kcal v a c f k pa kpa usd eur gbp dollar dollars cent cents euro euros percent".split())
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_PLAIN, _NUM, _QTY, _UNIT, _NAME = range(5)
_FULL = (1 << 64) - 1
_MARK = mix(np.array([101, 102, 103, 104, 105], dtype=np.uint64))


def _hash(word: str) -> int:
    h = 0xCBF29CE484222325
    for c in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


class Canoniser:
    """Turns texts into template tokens; an amount and a unit after it are one quantity."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.value = np.zeros(1024, np.uint64)
        self.kind = np.zeros(1024, np.int8)
        self.capital, self.ends = np.zeros(1024, bool), np.zeros(1024, bool)

    def _learn(self, words: set[str]) -> None:
        at = len(self.index)
        if at + len(words) > len(self.value):
            grow = max(at + len(words), 2 * len(self.value)) - len(self.value)
            self.value, self.kind, self.capital, self.ends = (np.concatenate([x, np.zeros(grow, x.dtype)]) for x in (self.value, self.kind, self.capital, self.ends))
        first = at
        glued: list[tuple[int, str]] = []
        for w in words:
            core = _OUTER.sub("", w)
            low = core.lower()
            self.index[w] = at
            self.kind[at] = _NUM if _NUMBER.fullmatch(low) else _QTY if _QUANTITY.fullmatch(low) else _UNIT if low in UNITS else _PLAIN
            if self.kind[at] == _QTY:
                amount = low.rstrip("".join(c for c in low if c.isalpha()))
                glued.append((at, low[len(amount) :]))
                low = amount
            self.value[at] = _hash(low)
            self.capital[at] = core[:1].isupper() and not core[1:2].isupper()
            self.ends[at] = w.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
            at += 1
        self.value[first:at] = mix(self.value[first:at])
        if glued:  # a quantity has the value of its amount and its unit written apart
            where = np.array([k for k, _ in glued])
            self.value[where] += mix(np.array([_hash(u) for _, u in glued], dtype=np.uint64))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(value, kind without names, capital, begins a sentence) of all words, and the word count of each text."""
        cut = [_WORD.findall(t or "") for t in texts]
        fresh = set().union(*cut).difference(self.index) if cut else set()
        if len(self.index) + len(fresh) > REMEMBERED:
            self._reset()
            fresh = set().union(*cut)
        self._learn(fresh)
        count = np.array([len(c) for c in cut], dtype=np.int64)
        known = self.index.__getitem__
        i = np.fromiter((x for c in cut for x in map(known, c)), np.int64, int(count.sum()))
        kind = self.kind[i]
        starts = np.ones(len(i), dtype=bool)
        starts[1:] = self.ends[i][:-1]
        starts[(np.cumsum(count) - count)[count > 0]] = True
        return self.value[i], kind, self.capital[i] & (kind == _PLAIN), starts, count


def _merged(kind: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds with amount and unit as quantities, and where tokens begin: placeholders of one kind in a row are one token."""
    kind = kind.copy()
    amount = np.flatnonzero((kind[:-1] == _NUM) & (kind[1:] == _UNIT) & (text[:-1] == text[1:]))
    kind[amount] = kind[amount + 1] = _QTY
    new = np.ones(len(kind), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _PLAIN) | (text[1:] != text[:-1])
    return kind, np.flatnonzero(new)


def _windows(value: np.ndarray, kind: np.ndarray, text: np.ndarray, at: np.ndarray, width: int, form: int, mixed: bool = True):
    """(first token, hash, slots) of all windows of the tokens that begin at the words ``at``."""
    n = max(0, len(at) - width + 1)
    total = np.add.reduceat(value, at) if len(at) else value[:0]
    kind, text = kind[at], text[at]
    h = np.where(kind == _PLAIN, total, _MARK[kind])
    out = np.full(n, form, dtype=np.uint64)
    for j, factor in enumerate(_factors(width)):
        out += h[j : j + n] * factor
    literal = np.cumsum(np.append(0, kind == _PLAIN))
    first = np.flatnonzero((literal[width : width + n] - literal[:n] >= min(LEAST_LITERALS, width)) & (text[:n] == text[width - 1 : width - 1 + n]))

    def slots(which: np.ndarray) -> pa.ListArray:
        grid = first[which][:, None] + np.arange(width)
        filled = kind[grid] != _PLAIN
        ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(total[grid[filled]].view(np.int64)))

    return first, mix(out[first]) if mixed else out[first], slots


def _factors(width: int) -> np.ndarray:
    return mix(np.arange(201, 201 + width, dtype=np.uint64)) | _U(1)


class _Item:
    """All windows of one benchmark text in all its readings.

    A sentence's first word, if capitalised and no known name, is read as a name
    and as a literal, those of one run of capitalised words alike. A unit that
    begins the text and an amount that ends it may be half of a quantity.
    """

    def __init__(self, value: np.ndarray, kind: np.ndarray, open_: np.ndarray, width: int):
        """``kind`` has names, open first words among them."""
        self.width, self.value, self.factor = width, value.tolist(), _factors(width).tolist()
        text = np.zeros(len(kind), np.int64)
        self.merged, at = _merged(kind, text)
        self.short = len(at) < width <= len(kind)
        self.raw = kind
        self.open = open_
        self.edge = np.zeros(len(kind), dtype=bool)
        literal = np.flatnonzero(kind == _PLAIN)
        if len(literal):
            self.edge[: literal[0]] = self.edge[literal[-1] + 1 :] = True

    def windows(self, form: int) -> Iterator[tuple[int, int, list[int | None]]]:
        """(word, hash, slots) of the merged (form 0 or SHORT + width) or word-by-word (form 1) template; a slot at the text's edge or that may be no name is None."""
        kind = (self.raw if form == 1 else self.merged).tolist()
        choices = [(k, _PLAIN) if o else (k,) for k, o in zip(kind, self.open.tolist(), strict=True)]
        if form != 1:
            if kind[0] == _UNIT:
                choices[0] = (_UNIT, _QTY)
            if kind[-1] == _NUM:
                choices[-1] = (_NUM, _QTY)
        many, tied = [len(c) for c in choices], [False] * len(kind)
        for i in range(1, len(kind)):
            tied[i] = kind[i] == kind[i - 1] == _NAME
        for i in [*range(1, len(kind)), *range(len(kind) - 1, 0, -1)]:
            if tied[i]:
                many[i] = many[i - 1] = max(many[i], many[i - 1])
        known = (~self.open & ~self.edge).tolist()
        marks = _MARK.tolist()
        for p in range(len(kind)):
            inside = form != 1 and p and kind[p] == kind[p - 1] != _PLAIN and len(choices[p]) == len(choices[p - 1]) == 1
            if not inside:
                for h, slots in self._from(p, form, choices, many, tied, known, marks).items():
                    yield p, h, slots

    def _from(self, p: int, form: int, choices: list, many: list, tied: list, known: list, marks: list) -> dict[int, list[int | None]]:
        done: dict[int, list[int | None]] = {}
        live: list[tuple] = [(0, form, 0, None, 0, [])]
        for i in range(p, len(choices) + 1):
            after = []
            for n, h, literals, last, option, slots in live:
                options = (None,) if i == len(choices) else (option,) if i > p and tied[i] else range(many[i])
                for o in options:
                    kind = None if o is None else choices[i][min(o, len(choices[i]) - 1)]
                    if form != 1 and n and kind is not None and kind == last != _PLAIN:
                        value = (slots[-1] + self.value[i]) & _FULL if known[i] and slots[-1] is not None else None
                        after.append((n, h, literals, last, o, [*slots[:-1], value]))
                    elif n == self.width:
                        if literals >= min(LEAST_LITERALS, self.width):
                            done.setdefault(h & _FULL, slots)
                    elif kind == _PLAIN:
                        after.append((n + 1, h + self.value[i] * self.factor[n], literals + 1, kind, o, slots))
                    elif kind is not None:
                        after.append((n + 1, h + marks[kind] * self.factor[n], literals, kind, o, [*slots, self.value[i] if known[i] else None]))
            live = after
        return done


def _known_names(value: np.ndarray, text: np.ndarray, capital: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First words of sentences that are capitalised within a sentence of the same text too."""
    key = mix(value[capital] + text[capital].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    known = np.zeros(len(value), dtype=bool)
    known[capital] = np.isin(key, key[~starts[capital]])
    return known & starts


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, cover: float = 0.5, consistent: float = 0.8, shift: int = 16, run: int = 13, shortest: int = 3) -> DataFrame:
    """One row per distinct id with a copied item: id_col, items (sorted array), cover (the largest).

    A document copies an item if a chain of diagonals, each at most ``shift``
    words from the next, holds at least ``cover`` of the item's windows or
    ``run`` of them, and at least ``consistent`` of its slot pairs agree with a
    one-to-one mapping. An item of fewer tokens than ``width``, with at least two
    placeholders and three literals, is one window of its own length. Items that yield no template are matched by their very
    words, folded and without outer punctuation; below ``shortest`` words they
    say nothing and never match. Null ids and null or empty texts of either side
    match nothing; texts of any length are read whole. Rows that repeat an id are pooled; repeated items count
    each; other columns are ignored; empty tables give an empty result.
    """

    def bench(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canoniser()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                value, kind, capital, starts, count = canon.words(texts[lo:hi])
                text = np.repeat(np.arange(hi - lo), count)
                maybe = capital & starts & ~_known_names(value, text, capital, starts)
                named = np.where(capital, _NAME, kind)
                rows = []
                for k, (a, z) in enumerate(zip(np.cumsum(count) - count, np.cumsum(count), strict=True)):
                    found = len(rows)
                    if z - a >= width:
                        item = _Item(value[a:z], named[a:z], maybe[a:z], width)
                        for form in (0, 1) if item.short else (0,):
                            got = list(item.windows(form))
                            total = len({p for p, _, _ in got})
                            rows += [(k + lo, form, p, h, total, s) for p, h, s in got]
                    w = len(_merged(named[a:z], text[a:z])[1])
                    if len(rows) == found and LEAST_LITERALS + 2 <= w < width and (named[a:z] != _PLAIN).sum() >= 2:
                        got = list(_Item(value[a:z], named[a:z], maybe[a:z], w).windows(SHORT + w))
                        rows += [(k + lo, SHORT + w, p, h, len({p for p, _, _ in got}), s) for p, h, s in got]
                    if len(rows) == found and z - a >= shortest:
                        w = min(width, int(z - a))
                        first, h, _ = _windows(value[a:z], np.zeros(z - a, np.int8), text[a:z], np.arange(z - a), w, EXACT + w, False)
                        rows += [(k + lo, EXACT + w, int(p), int(x), len(first), []) for p, x in zip(first, h, strict=True)]
                if rows:
                    row, form, at, h, total, slots = zip(*rows, strict=True)
                    held = pa.array([[None if v is None else v - (v >> 63 << 64) for v in s] for s in slots], pa.list_(pa.int64()))
                    yield pa.record_batch([ids.take(pa.array(row)), pa.array(form, pa.int64()), pa.array(at, pa.int64()), pa.array(mix(np.array(h, dtype=np.uint64)).view(np.int64)), pa.array(total, pa.int64()), held], ["item", "form", "ipos", "h", "total", "islots"])

    items = settle(benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(bench, "item long, form long, ipos long, h long, total long, islots array<long>"))
    forms = sorted({0, *(r["form"] for r in items.select("form").distinct().collect())})  # 2 * width + 2 at most

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
        for b in batches:
            bit = (b.column(0).to_numpy().view(np.uint64) >> _U(64 - MAP_BITS)).astype(np.int64)
            np.bitwise_or.at(held, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at].astype(np.int64))], ["byte", "bits"])

    filled = items.select("h").mapInArrow(marks, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
    bitmap[filled["byte"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap, bitorder="little").astype(bool))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, wanted = Canoniser(), shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                value, kind, capital, starts, count = canon.words(texts[lo:hi])
                text = np.repeat(np.arange(hi - lo), count)
                begin = np.cumsum(count) - count
                # Every capitalised word as a name, and first words that are no known names as literals.
                maybe = capital & starts & ~_known_names(value, text, capital, starts)
                for named, literal in ((capital, None), (capital & ~maybe, maybe)):
                    for form in forms:
                        if SHORT > form >= EXACT:
                            if literal is None:
                                first, h, slots = _windows(value, np.zeros(len(value), np.int8), text, np.arange(len(value)), form - EXACT, form)
                                hit = np.flatnonzero(wanted[(h >> _U(64 - MAP_BITS)).astype(np.int64)])
                                if len(hit):
                                    word = first[hit]
                                    yield pa.record_batch([ids.take(pa.array(text[word] + lo)), pa.array(word - begin[text[word]]), pa.array(h[hit].view(np.int64)), slots(hit)], ["doc", "pos", "h", "dslots"])
                            continue
                        read = np.where(named, _NAME, kind)
                        read, at = (read, np.arange(len(read))) if form == 1 else _merged(read, text)
                        wide = form - SHORT if form >= SHORT else width
                        first, h, slots = _windows(value, read, text, at, wide, form)
                        hit = np.flatnonzero(wanted[(h >> _U(64 - MAP_BITS)).astype(np.int64)])
                        if literal is not None and len(hit):
                            so_far = np.cumsum(np.append(0, literal[at]))
                            hit = hit[so_far[first[hit] + wide] > so_far[first[hit]]]
                        if len(hit):
                            word = at[first[hit]]
                            yield pa.record_batch([ids.take(pa.array(text[word] + lo)), pa.array(word - begin[text[word]]), pa.array(h[hit].view(np.int64)), slots(hit)], ["doc", "pos", "h", "dslots"])

    seen = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(scan, "doc long, pos long, h long, dslots array<long>")
    side = F.broadcast(items) if items.count() <= WINDOWS_BROADCAST else items
    met = seen.join(side, "h").select("doc", "item", "form", (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos", "total", F.filter(F.arrays_zip("islots", "dslots"), lambda p: p["islots"].isNotNull()).alias("slots"))
    along = Window.partitionBy("doc", "item", "form").orderBy("diagonal")
    met = met.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > shift).cast("int")).withColumn("chain", F.sum(F.coalesce("new", F.lit(0))).over(along))
    aligned = met.groupBy("doc", "item", "form", "chain").agg(F.count_distinct("ipos").alias("n"), F.max("total").alias("total"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    left, right = F.transform("pairs", lambda p: p["islots"]), F.transform("pairs", lambda p: p["dslots"])
    one_to_one = F.least(F.size(F.array_distinct(left)), F.size(F.array_distinct(right))) >= F.size("pairs") * consistent
    enough = (F.col("n") >= F.col("total") * cover) | (F.col("n") >= run)
    return aligned.filter(enough & one_to_one).groupBy(F.col("doc").alias(id_col)).agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("n") / F.col("total")).alias("cover"))
