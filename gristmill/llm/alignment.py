"""Alignment of two tokenizers over the same bytes, by a sweep of token ends.

Each side's tokens are events: the byte offset where the token ends, and its id.
The events of both sides are united, dealt by document and sorted by offset, and
one pass over a partition cuts each document where ends of both sides meet: the
tokens between two such offsets are a group, and every pair of its tokens from
either side is a link.

An event of a few bytes a row would cost more to shuffle and sort than to make,
so events travel in blocks: one row has the events of one side within
``BLOCK`` bytes of one document, packed as ids and sizes. The sweep keeps
the tokens since the last common end, a running hash and four counters, and
takes rows in portions of about ``PORTION`` tokens, whatever a document's length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.bytepair import ABOVE_180, AT_ONCE, COMMON_PATTERN, REMEMBERED, Cutter
from gristmill.llm.common import lookup, settle
from gristmill.llm.wordhash import slices

#: Bytes of text that one row of events covers.
BLOCK = 16_384
#: Tokens that the sweep works on at a time, and links that it lists at a time.
PORTION, LINKS = 200_000, 1_000_000
#: A group with more links than this is listed by its distinct ids and how often they occur.
LARGE_GROUP = 4_096
#: Rows of the table of linked id pairs that are broadcast at most, about 40 bytes each; beyond it is a join by shuffle.
PAIRS_BROADCAST = 500_000
#: Characters beyond which a text is cut piece by piece, and new pieces that are encoded as one text.
LONG, TOGETHER = 500_000, 1_000
EVENTS = "row long, doc_id long, block long, side int, at long, ids binary, sizes binary"


class Side:
    """One tokenizer: ids of a text that begins with a space, and the bytes of each token."""

    tokens: list[bytes]

    def __init__(self):
        self.id_type = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        lengths = [len(t) for t in self.tokens]
        self.size_type = np.dtype("<u1" if max(lengths) < 1 << 8 else "<u4")
        self.lengths = np.array(lengths, dtype=self.size_type)
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    #: Tells pieces that stay pieces when others that open with a space follow.
    opens_and_ends: Callable[[str], object]

    def pieces(self, text: str) -> list[str] | Iterator[str] | None:
        """Pieces that the tokenizer treats independently, of a long text one by one; None if the text must stay whole."""
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def checked(self, text: str, ids: list[int]) -> bytes | None:
        """The ids as bytes if their tokens give the text."""
        same = b"".join(map(self.tokens.__getitem__, ids)) == text.encode()
        return np.array(ids, dtype=self.id_type).tobytes() if same else None

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text as little-endian integers; None if the tokens do not give back its bytes."""
        cut = [self.pieces(t) for t in texts]
        self._learn([c for c in cut if isinstance(c, list)])
        out = []
        for t, own in zip(texts, cut, strict=True):
            if own is None:
                out.append(self.checked(t, self.ids([t])[0]))
            else:
                out.append(self._joined(own) if isinstance(own, list) else self._encode_long(own))
        return out

    def _learn(self, lists: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        fresh = set().union(*lists).difference(self.known)
        again = fresh.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = list(fresh.difference(again))
        plain = list(filter(self.opens_and_ends, new))
        for lo in range(0, len(plain), TOGETHER):
            self._learn_together(plain[lo : lo + TOGETHER])
        rest = [p for p in new if p not in self.known]
        self.known.update((p, self.checked(p, ids)) for p, ids in zip(rest, self.ids(rest), strict=True))

    def _learn_together(self, pieces: list[str]) -> None:
        """Encode pieces that each open with a space as one text; kept if a token ends where each of them does."""
        text = "".join(pieces)
        raw = self.checked(text, self.ids([text])[0])
        if raw is None:
            return
        ends = np.cumsum(self.lengths[np.frombuffer(raw, dtype=self.id_type)], dtype=np.int64)
        stop = np.cumsum([len(p.encode()) for p in pieces])
        at = np.searchsorted(ends, stop)
        if (ends[at] == stop).all():
            cuts = ((at + 1) * self.id_type.itemsize).tolist()
            self.known.update((p, raw[s:e]) for p, s, e in zip(pieces, [0, *cuts[:-1]], cuts, strict=True))

    def _joined(self, pieces: list[str]) -> bytes | None:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except TypeError:  # a piece whose tokens do not give it back
            return None

    def _encode_long(self, pieces: Iterator[str]) -> bytes | None:
        parts: list[bytes] = []
        while own := list(islice(pieces, AT_ONCE)):
            self._learn([own])
            part = self._joined(own)
            if part is None:
                return None
            parts.append(part)
        return b"".join(parts)


class ByteLevelSide(Side):
    """A vocabulary file of the tokenizers library with byte-level tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = self.tokenizer.get_vocab()
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        said = json.loads(self.tokenizer.to_str())
        first = said.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not said.get("normalizer")
        self.cutter = Cutter(COMMON_PATTERN) if plain else None
        super().__init__()

    opens_and_ends = staticmethod(re.compile(r" [^\W\d_]+").fullmatch)

    def pieces(self, text: str) -> list[str] | Iterator[str] | None:
        if self.cutter is None or ABOVE_180.search(text):
            return None
        return self.cutter.cut(text) if len(text) <= LONG else self.cutter.spans(text)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide(Side):
    """A sentencepiece model; it adds the leading space itself."""

    _PIECES = re.compile(" *[^ ]+| +")
    opens_and_ends = staticmethod(re.compile(" +[^ ]+").fullmatch)

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        #: No token goes on over the end of a word, so words are independent.
        self.by_word = not any("▁" in n.lstrip("▁") for n in names)
        super().__init__()

    def pieces(self, text: str) -> list[str] | Iterator[str] | None:
        if not self.by_word:
            return None
        return self._PIECES.findall(text) if len(text) <= LONG else (m.group() for m in self._PIECES.finditer(text))

    def ids(self, texts: list[str]) -> list[list[int]]:
        coded = self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return [[self.space] if t == " " else ids for t, ids in zip(texts, coded, strict=True)]


_loaded: dict[tuple[type, str], Side] = {}


def load(kind: type, path: str) -> Side:
    """A tokenizer, kept by the worker for its next tasks."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def events(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The end events of both sides in blocks; a text without tokens gives one block without events.

    ``row`` tells rows apart that repeat an id. It is made of the partition and
    the place in it, so ``docs`` must give the same partitions when a task is
    run again, as tables and settled frames do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sides = load(ByteLevelSide, byte_level_path), load(PieceSide, piece_path)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            owners, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                out = []
                some = [i for i in range(lo, hi) if texts[i]]
                coded = [dict(zip(some, s.encode([" " + texts[i] for i in some]), strict=True)) for s in sides]
                for i in range(lo, hi):
                    own = [c.get(i) for c in coded]
                    if None in own:
                        out.append((row + i, owners[i], 0, 0, 0, b"", b""))
                        continue
                    for k, (s, raw) in enumerate(zip(sides, own, strict=True)):
                        sizes = s.lengths[np.frombuffer(raw, dtype=s.id_type)]
                        ends = np.cumsum(sizes, dtype=np.int64)
                        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) + BLOCK, BLOCK), side="right").tolist()
                        for block, (first, last) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                            if last > first:
                                at = int(ends[first - 1]) if first else 0
                                w = s.id_type.itemsize
                                out.append((row + i, owners[i], block, k, at, raw[first * w : last * w], sizes[first:last].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in EVENTS.split(", ")])
            row += b.num_rows

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, EVENTS)


class Block(NamedTuple):
    """One row of events."""

    row: int
    doc_id: int | None
    side: int
    at: int
    ids: bytes
    sizes: bytes


class Sweep:
    """The state machine: takes blocks in order, gives rows of results."""

    def __init__(self, vocab: tuple[int, int], id_types: tuple[str, str], size_types: tuple[str, str]):
        self.vocab, self.id_types, self.size_types = vocab, [np.dtype(t) for t in id_types], [np.dtype(t) for t in size_types]
        most = max(vocab)
        width = len(str(most - 1))
        self.digits = np.zeros((most, width + 1), dtype=np.uint8)
        self.digits[:, :width] = np.frombuffer("".join(str(i).ljust(width) for i in range(most)).encode(), dtype=np.uint8).reshape(most, width)
        self.n_digits = np.char.str_len(np.arange(most).astype(str)).astype(np.int64)
        self.row: int | None = None
        self.doc_id: int | None = None
        self.open: list[Block] = []

    def _begin(self, row: int, doc_id: int | None) -> None:
        self.row, self.doc_id, self.totals, self.hash = row, doc_id, np.zeros(4, dtype=np.int64), hashlib.sha256()

    def _add(self, totals: np.ndarray, text: bytes) -> None:
        """Further groups of the open document; ``text`` ends with a separator."""
        if text:
            self.hash.update((b";" if self.totals[2] else b"") + text[:-1])
        self.totals = self.totals + totals

    def close(self) -> list[tuple]:
        """The totals of the open document, without links."""
        if self.row is None:
            return []
        sha = self.hash.hexdigest() if self.totals[2] else ""
        done = (self.row, self.doc_id, False, *self.totals.tolist(), sha, (), ())
        self.row, self.open = None, []
        return [done]

    def feed(self, blocks: list[Block]) -> list[tuple]:
        """Results of the documents that end in ``blocks``, and links of the one that may go on."""
        out = []
        if self.row is not None and blocks[0].row != self.row:
            out += self.close()
        if self.row is None:
            self._begin(blocks[0].row, blocks[0].doc_id)
            fresh = True
        else:
            fresh = False
        blocks = self.open + blocks
        rows = np.array([b.row for b in blocks], dtype=np.int64)
        new = np.r_[True, rows[1:] != rows[:-1]]
        doc_of = np.cumsum(new) - 1
        first_of = np.flatnonzero(new)
        n_docs = len(first_of)
        side = np.array([b.side for b in blocks])
        at = np.array([b.at for b in blocks], dtype=np.int64)
        ids, ends, docs = [], [], []
        upto = np.zeros(len(blocks), dtype=np.int64)
        for k in (0, 1):
            own = np.flatnonzero(side == k)
            found = np.frombuffer(b"".join([blocks[i].ids for i in own]), dtype=self.id_types[k]).astype(np.int64)
            sizes = np.frombuffer(b"".join([blocks[i].sizes for i in own]), dtype=self.size_types[k]).astype(np.int64)
            count = np.array([len(blocks[i].sizes) for i in own], dtype=np.int64) // self.size_types[k].itemsize
            cum = np.cumsum(sizes)
            stop = np.cumsum(count)
            before = np.r_[0, cum][stop - count]
            upto[own] = at[own] + np.r_[0, cum][stop] - before
            ids.append(found)
            ends.append(cum + np.repeat(at[own] - before, count))
            docs.append(np.repeat(doc_of[own], count))
        low = np.minimum.reduceat(at, first_of)
        extent = np.maximum.reduceat(upto, first_of) - low + 1
        base = np.cumsum(extent) - extent - low
        place = [ends[k] + base[docs[k]] for k in (0, 1)]
        mark = np.zeros(int(extent.sum()) + 1, dtype=np.uint8)
        mark[place[0]] = 1
        mark[place[1]] += 2
        last = [mark[p] == 3 for p in place]
        group = [np.cumsum(x) - x for x in last]
        n_groups = int(last[0].sum())
        done = [np.searchsorted(g, n_groups, side="left") for g in group]
        self.open = []
        for k in (0, 1):
            if done[k] < len(ids[k]):
                start = int(ends[k][done[k] - 1]) if done[k] and docs[k][done[k] - 1] == n_docs - 1 else int(low[-1])
                rest = np.diff(np.r_[start, ends[k][done[k] :]])
                self.open.append(Block(blocks[-1].row, blocks[-1].doc_id, k, start, ids[k][done[k] :].astype(self.id_types[k]).tobytes(), rest.astype(self.size_types[k]).tobytes()))
        ids, docs, group, last = ([x[k][: done[k]] for k in (0, 1)] for x in (ids, docs, group, last))
        n = [np.bincount(group[k], minlength=n_groups) for k in (0, 1)]
        group_doc = docs[0][last[0]]
        texts = self._texts(ids, docs, group, last, n, n_docs)
        links = n[0] * n[1]
        per_doc = [np.bincount(docs[0], minlength=n_docs), np.bincount(docs[1], minlength=n_docs), np.bincount(group_doc, minlength=n_docs)]
        ends_of = np.cumsum(per_doc[2])
        cum_links = np.r_[0, np.cumsum(links)]
        totals = np.stack([*per_doc, cum_links[ends_of] - cum_links[ends_of - per_doc[2]]], axis=1)
        found, times = self._links(ids, n, links, group_doc)
        edge = np.searchsorted(found, np.arange(n_docs + 1) * (self.vocab[0] * self.vocab[1]))
        codes = found % (self.vocab[0] * self.vocab[1])
        for d in range(n_docs):
            own = (codes[edge[d] : edge[d + 1]], times[edge[d] : edge[d + 1]])
            b = blocks[first_of[d]]
            if d == 0 and not fresh or d == n_docs - 1:
                if d:
                    self._begin(b.row, b.doc_id)
                self._add(totals[d], texts[d])
                if len(own[0]):
                    out.append((b.row, b.doc_id, False, None, None, None, None, None, *own))
                if d < n_docs - 1:
                    out += self._closed()
            else:
                sha = hashlib.sha256(texts[d][:-1]).hexdigest() if texts[d] else ""
                out.append((b.row, b.doc_id, True, *totals[d].tolist(), sha, *own))
        return out

    def _closed(self) -> list[tuple]:
        kept = self.open
        done = self.close()
        self.open = kept
        return done

    def _texts(self, ids, docs, group, last, n, n_docs: int) -> list[bytes]:
        """``a1,a2|b1;`` of the groups of each document."""
        total = len(ids[0]) + len(ids[1])
        if not total:
            return [b""] * n_docs
        a_upto, b_before = np.cumsum(n[0]), np.cumsum(n[1]) - n[1]
        place = [np.arange(len(ids[0])) + b_before[group[0]], np.arange(len(ids[1])) + a_upto[group[1]]]
        token, mark = np.empty(total, dtype=np.int64), np.full(total, ord(","), dtype=np.uint8)
        for k, sign in ((0, "|"), (1, ";")):
            token[place[k]] = ids[k]
            mark[place[k][last[k]]] = ord(sign)
        size = self.n_digits[token]
        shown = self.digits[token]
        shown[np.arange(total), size] = mark
        raw = shown[np.arange(shown.shape[1]) <= size[:, None]].tobytes()
        count = np.bincount(docs[0], minlength=n_docs) + np.bincount(docs[1], minlength=n_docs)
        cut = np.r_[0, np.cumsum(size + 1)][np.r_[0, np.cumsum(count)]].tolist()
        return [raw[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def _links(self, ids, n, links: np.ndarray, group_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, a, b) as one ascending number each, and how often each is linked."""
        span, wide = self.vocab[0] * self.vocab[1], self.vocab[1]
        start = [np.cumsum(x) - x for x in n]
        parts = []
        small = np.flatnonzero(links <= LARGE_GROUP)
        cum = np.cumsum(links[small])
        lo = 0
        while lo < len(small):
            hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + LINKS, side="right")))
            g = small[lo:hi]
            many = links[g]
            own = np.repeat(g, many)
            k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            a, b = ids[0][start[0][own] + k // n[1][own]], ids[1][start[1][own] + k % n[1][own]]
            parts.append(np.unique(group_doc[own] * span + a * wide + b, return_counts=True))
            lo = hi
        for g in np.flatnonzero(links > LARGE_GROUP).tolist():
            (a, ca), (b, cb) = (np.unique(ids[k][start[k][g] : start[k][g] + n[k][g]], return_counts=True) for k in (0, 1))
            parts.append(((group_doc[g] * span + a[:, None] * wide + b).ravel(), (ca[:, None] * cb).ravel()))
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(parts) == 1:
            return parts[0]
        keys, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(times, first)


def sweep(ends: DataFrame, vocab: tuple[int, int], id_types: tuple[str, str], size_types: tuple[str, str]) -> DataFrame:
    """Groups and links of every document, from its end events.

    (row, doc_id, whole, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times):
    a document within one portion is one ``whole`` row; any other has rows with
    links only (a pair may be in several) and a last one with the totals. A pair
    is the number a * (ids of B) + b.
    """
    kind = "int" if vocab[0] * vocab[1] < 1 << 31 else "long"
    pair = pa.int32() if kind == "int" else pa.int64()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        plain = list(zip(*(r[:8] for r in out), strict=True))
        offsets = pa.array(np.r_[0, np.cumsum([len(r[8]) for r in out])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(r[i], dtype=np.int64) for r in out])).cast(t)) for i, t in ((8, pair), (9, pa.int64()))]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string())
        names = ["row", "doc_id", "whole", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(plain, kinds, strict=True)), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(vocab, id_types, size_types)
        held, tokens = [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                held.append(Block(*row))
                tokens += len(held[-1].sizes)
                if tokens > PORTION or len(held) >= 5_000:
                    if out := machine.feed(held):
                        yield rows(out)
                    held, tokens = [], 0
        out = (machine.feed(held) if held else []) + machine.close()
        if out:
            yield rows(out)

    schema = f"row long, doc_id long, whole boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<long>"
    return ends.repartition("row").sortWithinPartitions("row", "block", "side").mapInArrow(run, schema)


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Alignment of A (byte-level BPE of space and text) and B (sentencepiece, which adds the space).

    Two frames: one row a document (doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256), and one row an id pair (a, b, count, best): in how
    many documents the pair is linked, and whether no pair of that a is in more.

    Null and empty texts, and texts whose tokens on either side do not give back
    their bytes, have no tokens: noughts, an empty hash. Every row is a document,
    repeated rows and null ids included; ties are all best. Texts of any length
    are taken whole; an empty table gives empty frames; other columns are ignored.
    """
    a, b = load(ByteLevelSide, byte_level_path), load(PieceSide, piece_path)
    vocab = (len(a.tokens), len(b.tokens))
    types = [(x.str, y.str) for x, y in ((a.id_type, b.id_type), (a.size_type, b.size_type))]
    swept = settle(sweep(events(docs, byte_level_path, piece_path, id_col, text_col), vocab, *types))

    once = swept.filter("whole").select(F.explode("pairs").alias("pair"))
    spread = swept.filter("not whole").select("row", F.explode("pairs").alias("pair")).distinct().select("pair")
    counted = once.unionByName(spread).groupBy("pair").agg(F.count("*").alias("count"))
    highest = F.max("count").over(Window.partitionBy("a"))  # an id of A has at most as many partners as B has ids
    pairs = settle(counted.withColumn("a", F.expr(f"pair DIV {vocab[1]}")).withColumn("best", F.col("count") == highest))

    links = swept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    linked = lookup(links, pairs.select("pair", "count", "best"), ["pair"], "inner", PAIRS_BROADCAST)
    sums = linked.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    totals = swept.filter("n_a is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    result = totals.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return result.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs.select("a", F.expr(f"pair % {vocab[1]}").alias("b"), "count", "best")
