"""Vectorised word and shingle hashing shared by the text operators.

All functions work on a list of texts at once: the texts are laid end to end
as UTF-8 bytes and every step is one numpy pass over that buffer, so the cost
per document is a few array operations and not a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in slices of about this many bytes, so scratch arrays stay small.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown by doubling and kept per process."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, b in (("up", _BASE), ("down", _BASE_INV)):
            step = np.full(size, b, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about ``limit`` characters together."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word count of every text); words are ``[^\\x20\\x09-\\x0D]+``."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum([len(p) + 1 for p in parts])
    if fold:
        raw = _FOLD[raw]
    solid = ~_SPACE[raw]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_table(len(raw) + 1)
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=run[1:])
    hashed = mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))
    upto = np.searchsorted(begin, ends_of_text)
    return hashed, np.diff(upto, prepend=0)


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of every text, text after text, and their count.

    A text of fewer words than ``width`` has its whole word sequence as its only
    shingle; one without words has none. Hashes are sorted within a text.
    """
    hashed, count = words(texts)
    total = len(hashed)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(count) - count
    grams = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + first[owner]
    left = np.minimum(count, width)[owner]
    out = np.zeros(len(owner), dtype=np.uint64)
    for j in range(width):
        live = left > j
        word = hashed[np.minimum(at + j, total - 1)]
        out = np.where(live, mix(out * _U(_BASE) + word + _U(j + 1)), out)
    order = np.lexsort((out, owner)) if len(texts) > 1 else np.argsort(out)
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=len(texts))
