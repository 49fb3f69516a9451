"""Byte-level BPE: encoding by padded merge matrices, and decoding.

A text is cut into pieces by a pattern, and each piece is merged on its own.
Pieces that a task has not seen yet are dealt to buckets by length. A bucket is
a matrix of token ids, one row a piece, padded on the right. In each round every
row merges its leftmost pair of least rank, so all rows shrink by one column;
rows without a mergeable pair leave the matrix. Ranks of pairs come from a hash
table in numpy arrays with open addressing.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types

from gristmill.llm.tokenfile import letters_below_180, spaces_below_180
from gristmill.llm.wordhash import slices

_U = np.uint64
#: Marks an empty slot, a pair that does not merge, and the padding of a row.
NONE = 0xFFFFFFFF
#: Widths of the matrices. A longer piece would take as many rounds as it has bytes, so it is merged by a heap.
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
#: Elements of one matrix at most.
ELEMENTS = 1_000_000
#: Pieces of a generation. A worker remembers two: when one is full the older is let go.
REMEMBERED = 250_000
#: Pieces of a long text, and ids, that are worked on at a time.
AT_ONCE = 100_000
#: Bytes of a slice of texts or ids.
SLICE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base-64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Hash table from a pair of token ids to the id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.shift = _U(64 - max(4, (4 * len(pairs)).bit_length()))
        self.mask = _U((1 << (64 - int(self.shift))) - 1)
        self.keys = np.full(int(self.mask) + 1, NONE << 32 | NONE, dtype=np.uint64)
        self.ranks = np.full(int(self.mask) + 1, NONE, dtype=np.uint32)
        keys, values = np.array(list(pairs), dtype=np.uint64), np.array(list(pairs.values()), dtype=np.uint32)
        at = self._slot(keys)
        while len(keys):
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.ranks[at] == NONE
            self.keys[at[first]], self.ranks[at[first]] = keys[first], values[first]
            keys, values, at = keys[~first], values[~first], (at[~first] + _U(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair joins to, NONE if it does not."""
        keys = (left.astype(np.uint64) << _U(32) | right).ravel()
        at = self._slot(keys)
        out, open_ = self.ranks[at], np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            taken = self.ranks[at[open_]] != NONE  # by another pair: look on
            out[open_[~taken]] = NONE
            open_ = open_[taken]
            at[open_] = (at[open_] + _U(1)) & self.mask
            out[open_] = self.ranks[at[open_]]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return out.reshape(left.shape)


#: The pattern that has a quicker form for text below U+0180, and that form.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = letters_below_180("L"), letters_below_180("N"), spaces_below_180
_COMMON_BELOW_180 = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
ABOVE_180 = re.compile("[^\x00-\u017f]")
#: Stands for a code point that is neither letter nor number nor white space.
_OTHER = "\ue000"


class Cutter:
    """Cuts texts into pieces by a pattern, with the letters and numbers that tiktoken knows.

    The two pattern libraries follow different versions of Unicode. A code point
    that is a letter or number here and has no category in Python's tables is
    put to tiktoken itself, once a worker.
    """

    def __init__(self, pattern: str):
        self.source, self.pattern = pattern, regex.compile(pattern)
        self.quick = _COMMON_BELOW_180 if pattern == COMMON_PATTERN else None
        self.counts = regex.compile(r"[\p{L}\p{N}]")
        self.other: dict[str, bool] = {}
        self.ask = None

    def _is_other(self, c: str) -> bool:
        """Whether tiktoken takes ``c`` neither with the letter nor with the digit before it."""
        if self.ask is None:
            import tiktoken

            ranks = {bytes([b]): b for b in range(256)} | {bytes([lead, b]): 256 + 256 * k + b for k, lead in enumerate(b"a1") for b in range(256)}
            self.ask = tiktoken.Encoding("classes", pat_str=self.source, mergeable_ranks=ranks, special_tokens={})
        if c not in self.other:
            self.other[c] = self.ask.encode_ordinary("a" + c)[0] < 256 and self.ask.encode_ordinary("1" + c)[0] < 256
        return self.other[c]

    def spans(self, text: str) -> Iterator[str]:
        """The pieces of a text, one after the other."""
        if self.quick and not ABOVE_180.search(text):
            return (m.group() for m in self.quick.finditer(text))
        doubtful = [c for c in set(text) if unicodedata.category(c) == "Cn" and self.counts.match(c)]
        odd = {ord(c): _OTHER for c in doubtful if self._is_other(c)}
        if not odd:
            return (m.group() for m in self.pattern.finditer(text))
        return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(odd)))

    def cut(self, text: str) -> list[str]:
        if self.quick and not ABOVE_180.search(text):
            return self.quick.findall(text)
        return list(self.spans(text))


class ByteBPE:
    """A vocabulary of ranks with the pattern that cuts texts; encodes and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cutter = Cutter(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.uint32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def table(self) -> PairTable:
        """Made at the first merge: decoding does without."""
        return PairTable(self.ranks)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        alone = np.array([p in self.ranks for p in pieces], dtype=bool)
        for i in np.flatnonzero(alone):
            out[i] = self.ranks[pieces[i]].to_bytes(4, "little")
        least = 0
        for width in WIDTHS:
            bucket = np.flatnonzero(~alone & (sizes > least) & (sizes <= width))
            for lo in range(0, len(bucket), max(1, ELEMENTS // width)):
                self._merge_rows(pieces, sizes, bucket[lo : lo + max(1, ELEMENTS // width)], width, out)
            least = width
        for i in np.flatnonzero(~alone & (sizes > least)):
            out[i] = self._merge_long(pieces[i])
        return out

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray, row: np.ndarray, width: int, out: list[bytes]) -> None:
        size = sizes[row]
        ids = np.full((len(row), width), NONE, dtype=np.uint32)
        ids[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in row]), dtype=np.uint8)]
        rank = self.table.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE, dtype=np.uint32)
            done = best == NONE
            if done.any():
                for i, n, own in zip(row[done].tolist(), size[done].tolist(), ids[done], strict=True):
                    out[i] = own[:n].astype("<u4").tobytes()
                live = ~done
                row, size, ids, rank, at, best = row[live], size[live], ids[live], rank[live], at[live], best[live]
                if not len(row):
                    return
            each = np.arange(len(row))
            ids[each, at] = best
            stays = np.ones(ids.shape, dtype=bool)
            stays[each, at + 1] = False
            ids = ids[stays].reshape(len(row), -1)
            stays = np.ones(rank.shape, dtype=bool)
            stays[each, at] = False
            rank = rank[stays].reshape(len(row), -1)
            size = size - 1
            right = np.flatnonzero(at < rank.shape[1])
            rank[right, at[right]] = self.table.find(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table.find(ids[left, at[left] - 1], ids[left, at[left]])
            wide = int(size.max())
            if wide < ids.shape[1]:
                ids, rank = ids[:, :wide], rank[:, : max(0, wide - 1)]

    def _merge_long(self, piece: bytes) -> bytes:
        """One long piece: a heap of (rank, place), so that time is n log n."""
        pairs, ids = self.table.pairs, self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [pairs.get(ids[i] << 32 | ids[i + 1], NONE) for i in range(n - 1)] + [NONE]
        heap = [r << 40 | i for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            if rank[i] != r:
                continue
            gone = after[i]
            ids[i], rank[gone], after[i] = r, NONE, after[gone]
            ids[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    rank[k] = pairs.get(ids[k] << 32 | ids[after[k]], NONE) if after[k] < n else NONE
                    if rank[k] != NONE:
                        heapq.heappush(heap, rank[k] << 40 | k)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _lookup(self, cut: list[list[str]]) -> Callable[[str], bytes]:
        """Ids of a piece, after all pieces of ``cut`` that are new were merged together."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        fresh = set().union(*cut).difference(self.known)
        again = [p for p in fresh if p in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = list(fresh.difference(again))
        self.known.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        return self.known.__getitem__

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers; a null text has none."""
        out = []
        for lo, hi in slices(texts, SLICE):
            if hi - lo == 1 and len(texts[lo] or "") > SLICE:
                out.append(self._encode_long(texts[lo]))
                continue
            cut = [self.cutter.cut(t) if t else [] for t in texts[lo:hi]]
            ids = self._lookup(cut)
            out += [b"".join(map(ids, pieces)) for pieces in cut]
        return out

    def _encode_long(self, text: str) -> bytes:
        found, parts = self.cutter.spans(text), []
        while pieces := list(islice(found, AT_ONCE)):
            parts.append(b"".join(map(self._lookup([pieces]), pieces)))
        return b"".join(parts)

    def decode(self, coded: bytes | None) -> bytes:
        """The bytes of the tokens, end to end."""
        ids, parts = np.frombuffer(coded or b"", dtype="<u4"), []
        for lo in range(0, len(ids), AT_ONCE):
            own = ids[lo : lo + AT_ONCE].astype(np.int64)
            size = self.lengths[own]
            ends = np.cumsum(size)
            parts.append(self.bytes[np.repeat(self.starts[own] - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """The vocabulary of a file, kept by the worker for its next tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _with_column(df: DataFrame, source: str, target: str, make: Callable[[list], list]) -> DataFrame:
    """``df`` with bytes ``target`` made of ``source``, slice by slice; a column of that name is replaced."""
    kept = [c for c in df.columns if c != target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(len(kept))), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns[: len(kept)], pa.array(make(own.column(len(kept)).to_pylist()), pa.binary())], [*kept, target])
                lo = hi

    schema = types.StructType([df.schema[c] for c in kept] + [types.StructField(target, types.BinaryType())])
    return df.select(*(df[c] for c in kept), df[source].alias("__source")).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text, as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (an empty value). Texts of any length are
    encoded whole; special tokens are ordinary text. Every row is treated by
    itself: repeated rows, null ids and ties are kept as they are, an empty
    table stays empty, and a column that is already called ``ids_col`` is replaced.
    """
    return _with_column(docs, text_col, ids_col, lambda texts: load(ranks_path, pattern).encode(texts))


def decode(coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``coded`` with the bytes that its ids stand for; null ids give no bytes.

    Ids that the vocabulary lacks are an error. A column that is already called
    ``bytes_col`` is replaced.
    """
    return _with_column(coded, ids_col, bytes_col, lambda ids: [load(ranks_path, pattern).decode(x) for x in ids])
