"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of
labelled texts, each of them whole. A document is parsed greedily into phrases, each the longest
string from there on that occurs in the sample; a new phrase begins where the
automaton has no transition. Text needs few, long phrases under its own
language. The phrase count times the bits of a pointer into the sample or the
alphabet, divided by the document's length, is its cross entropy, and the
language with the least wins (ties: the first by name). Samples may differ in
length: pointers into a short one are cheap, but never below a single symbol's
bits, and lead to short phrases.

So that numpy can walk texts of any length in step, they are laid out in rows of
``SEGMENT`` symbols. A row is first walked from the start state, and again from
the state in which the row before it ended, until no row's entry changes: the
phrases are those of one parse of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gristmill.llm.common import held_out
from gristmill.llm.wordhash import slices

#: Symbols of one row, and how often rows are walked together before the rest is walked one by one.
SEGMENT, ROUNDS = 256, 4
#: Symbols of the automata: letters outside the sample, a run of non-letters, letters, padding.
ALPHABET = 64
UNSEEN, BREAK, PAD = 0, 1, ALPHABET - 1
#: Where the samples hold more letters than there are symbols, the rarer ones are spelled as so many digits.
DIGITS, BASE = 5, 16
SPELLED, DIGIT = -1, PAD - BASE
POINTS = 0x110000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


class SuffixAutomaton:
    """Smallest automaton of all substrings of a sequence of symbols, as one dense table.

    ``step[state * ALPHABET + symbol]`` is the next state; where the sample has no
    such continuation, and from the start state, it is ``~next``: a phrase begins
    with the symbol and leads to state next, the start state again if the sample
    lacks the symbol.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.length = n
        link, size, edges = [-1], [0], [{}]
        last = 0
        for c in symbols.tolist():
            cur = len(size)
            size.append(size[last] + 1)
            link.append(0)
            edges.append({})
            p = last
            while p != -1 and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if p != -1:
                q = edges[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    edges.append(dict(edges[q]))
                    while p != -1 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        start = np.zeros(ALPHABET, dtype=np.int32)
        for c, to in edges[0].items():
            start[c] = to
        step = np.tile(~start, (len(edges), 1))
        for state, out in enumerate(edges):
            for c, to in out.items():
                step[state, c] = to if state else ~to
        step[:, PAD] = np.arange(len(edges))
        self.step = step.ravel()

    def _walk(self, rows: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state at the end, phrases begun within) of each row, from its entry state."""
        state, count = entry.copy(), np.zeros(rows.shape[1], dtype=np.int32)
        for symbols in rows:
            to = self.step[state * ALPHABET + symbols]
            broke = to >> 31
            count -= broke
            state = to ^ broke
        return state, count

    def phrases(self, rows: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases begun within each row; ``rows`` is (SEGMENT, n) of symbols, padded.

        ``follows`` is true where a row continues the one before it.
        """
        n = rows.shape[1]
        walked, count = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        leave, todo = np.zeros(n, dtype=np.int32), np.arange(n)
        for _ in range(ROUNDS):
            leave[todo], count[todo] = self._walk(rows if len(todo) == n else rows[:, todo], walked[todo])
            entry = np.where(follows, np.roll(leave, 1), 0)
            todo = np.flatnonzero(entry != walked)
            if not len(todo):
                return count
            walked[todo] = entry[todo]
        # Texts whose parse never falls into step with itself, such as one letter over and over.
        step, fresh = memoryview(self.step), np.ones(n, dtype=bool)
        fresh[todo] = False
        for j in todo.tolist():
            while j < n and follows[j] and (not fresh[j] or walked[j] != leave[j - 1]):
                state, breaks = int(leave[j - 1]), 0
                walked[j], fresh[j] = state, True
                for c in rows[:, j].tolist():
                    state = step[state * ALPHABET + c]
                    if state < 0:
                        state, breaks = ~state, breaks + 1
                leave[j], count[j] = state, breaks
                j += 1
        return count


class LanguageModel:
    """The automata of all languages and the symbol of every code point.

    Letters are folded to lower case; every run of other characters is one
    symbol, so that marks, digits and markup say nothing about the language.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen, times = np.unique(np.frombuffer("".join(samples.values()).lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        kept = [p for p in seen[np.argsort(-times, kind="stable")].tolist() if chr(p).isalpha()]
        spell = len(kept) > PAD - BREAK - 1
        letter = np.fromiter((chr(p).isalpha() for p in range(POINTS)), bool, POINTS)
        self.code = np.where(letter, SPELLED if spell else UNSEEN, BREAK).astype(np.int32)
        self.code[kept[: DIGIT - BREAK - 1 if spell else None]] = np.arange(BREAK + 1, min(BREAK + 1 + len(kept), DIGIT) if spell else BREAK + 1 + len(kept))
        self.low = np.arange(POINTS, dtype=np.int32)
        for point in np.flatnonzero(letter).tolist():
            low = chr(point).lower()
            if len(low) == 1 and low != chr(point):
                self.low[point] = ord(low)
        self.code = self.code[self.low]
        coded = [self.encode([samples[x]])[0] for x in self.langs]
        self.automata = [SuffixAutomaton(c) for c in coded]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, text after text, and how many each text has."""
        size = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.code[points]
        apart = symbols == BREAK
        starts = (np.cumsum(size) - size)[size > 0]
        again = np.zeros(len(symbols), dtype=bool)
        again[1:] = apart[1:] & apart[:-1]
        again[starts] = False
        owner = np.repeat(np.arange(len(texts)), size)[~again]
        symbols = symbols[~again]
        spelled = symbols == SPELLED
        if spelled.any():
            width = np.where(spelled, DIGITS, 1)
            point, owner = self.low[points[~again][spelled]], np.repeat(owner, width)
            first = (np.cumsum(width) - width)[spelled]
            symbols = np.repeat(symbols, width)
            for d in range(DIGITS):
                symbols[first + d] = DIGIT + (point // BASE ** (DIGITS - 1 - d)) % BASE
        return symbols, np.bincount(owner, minlength=len(texts))

    def rates(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): normalised phrases, in bits a symbol; texts are not empty."""
        symbols, size = self.encode(texts)
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        flat = np.full(int(parts.sum()) * SEGMENT, PAD, dtype=np.int32)
        shift = (np.cumsum(parts) - parts) * SEGMENT - (np.cumsum(size) - size)
        flat[np.arange(len(symbols)) + np.repeat(shift, size)] = symbols
        rows = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
        out = np.empty((len(texts), len(self.langs)))
        follows = np.append(False, owner[1:] == owner[:-1])
        for k, a in enumerate(self.automata):
            out[:, k] = np.bincount(owner, a.phrases(rows, follows), len(texts)) * np.log2(a.length + ALPHABET) / size
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_language: int = 60, chars_per_language: int = 40_000) -> LanguageModel | None:
    """Fit on a bounded sample of whole texts: at most ``docs_per_language`` rows of each label, of ``chars_per_language`` code points together.

    The rows are those with the smallest id hash among labelled rows with a
    letter that are not held out, texts above the bound last. A language whose
    texts are all above the bound learns from its shortest one. Every language
    keeps its whole sample, however short another's is. No such row: None.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & ~held_out("id"))
    rows = rows.withColumn("h", F.xxhash64("id"))
    # Rows that come into question at all: some twenty times the sample of a large language, by hash alone.
    share = F.least(F.lit(1.0), F.lit(20.0 * docs_per_language) / F.col("n"))
    known = rows.filter(F.col("text").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).select("lang", F.greatest(F.col("least").cast("double"), (share * 2 - 1) * 2.0**63).alias("cut"))
    long = F.length("text") > chars_per_language
    order = Window.partitionBy("lang").orderBy("long", "size", "h", "id", "text")

    def sample(some: DataFrame) -> list[Row]:
        chosen = (
            some.filter(F.col("text").rlike(r"\p{L}"))
            .withColumns({"long": long, "size": F.when(long, F.length("text")).otherwise(0)})
            .withColumn("r", F.row_number().over(order))
            .filter(F.col("r") <= docs_per_language)
            .withColumn("upto", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("rows", F.count("*").over(Window.partitionBy("lang")))
            .filter((F.col("upto") <= chars_per_language) | (F.col("r") == 1))
        )
        return chosen.orderBy("lang", "r").select("lang", "text", "rows").collect()

    found = sample(rows.join(F.broadcast(known), "lang").filter(F.col("h").cast("double") <= F.col("cut")))  # one row a language
    # Labels whose rows mostly lack letters: their sample is drawn from all their rows.
    full = {r["lang"] for r in found if r["rows"] >= docs_per_language}
    scarce = [r["lang"] for r in known.filter(F.col("cut") < 2.0**63).select("lang").collect() if r["lang"] not in full]
    if scarce:
        found = [r for r in found if r["lang"] not in set(scarce)] + sample(rows.filter(F.col("lang").isin(scarce)))
    texts: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda r: r["lang"]):
        texts.setdefault(row["lang"], []).append(row["text"])
    return LanguageModel({k: "\n".join(v) for k, v in texts.items()}) if texts else None


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, bits_per_char.

    A text that is null or has no letter, and any text where no language was
    learned, is ``und`` with score 0 and null bits. Otherwise score is the share
    of the winner's inverse rate in the sum of all inverse rates (0 to 1).
    Columns of ``docs`` with these three names are replaced. Ties go to the first
    name; repeated rows and other columns do not matter; texts of any length are
    parsed whole; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score", "bits_per_char")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNDETERMINED] if m else [UNDETERMINED], dtype=object)
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(texts, 3_000_000):
                best = np.full(hi - lo, len(names) - 1)
                score, bits = np.zeros(hi - lo), np.full(hi - lo, np.nan)
                live = [k for k in range(hi - lo) if m and texts[lo + k] and _LETTER.search(texts[lo + k])]
                if live:
                    rate = m.rates([texts[lo + k] for k in live])
                    best[live] = rate.argmin(axis=1)
                    bits[live] = rate.min(axis=1)
                    score[live] = 1 / bits[live] / (1 / rate).sum(axis=1)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(bits, from_pandas=True)], names=[*part.schema.names, "lang_pred", "score", "bits_per_char"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, bits_per_char double")
