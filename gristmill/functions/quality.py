"""Column functions over the quality, scripts and distance of texts, and statistics of their bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that show nothing or turn the direction of writing.
INVISIBLE = r"[\u200B-\u200F\u202A-\u202E\u2060\uFEFF]"
SCRIPTS = ("latin", "cyrillic", "greek", "han", "arabic")
#: Texts below this many characters are not judged.
SHORT = 10


def _count(text: str, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", ""))


def text_quality(text: str) -> dict[str, Column]:
    """Characters in total, letters, white space, printable; words of two letters or more and their letters."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))
    return {
        "total": F.length(text),
        "letters": _count(text, r"\p{L}"),
        "spaces": _count(text, r" \t\r\n"),
        "printable": F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")),
        "words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
    }


def _band(value: Column, best: tuple[float, float], *others: tuple[Column, float]) -> Column:
    out = F.when((value >= best[0]) & (value <= best[1]), 1.0)
    for condition, score in others:
        out = out.when(condition, score)
    return out.otherwise(0.2)


def with_quality(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the columns of ``text_quality``: each text is read once for each, however often they are used."""
    return docs.withColumns(text_quality(text))


def confidence(text: str | None = None) -> Column:
    """How likely a text is prose and not debris, 0 to 1; short texts are 1, a null text is null.

    Without ``text`` it goes by the columns that ``with_quality`` made.
    """
    c = text_quality(text) if text else {n: F.col(n) for n in ("total", "letters", "spaces", "printable", "words", "word_chars")}
    black = F.when(c["total"] > c["spaces"], c["total"] - c["spaces"])
    mean, space = F.try_divide(c["word_chars"], c["words"]), F.try_divide(c["spaces"], c["total"])

    def share(part: Column, target: float, weight: float) -> Column:
        return F.coalesce(F.least(part / black / target, F.lit(1.0)) * weight, F.lit(0.0))

    length = _band(mean, (3, 10), ((mean >= 2) & (mean < 3), 0.7), ((mean > 10) & (mean <= 15), 0.5))
    gaps = _band(space, (0.08, 0.25), ((space > 0.25) & (space <= 0.4), 0.6), ((space > 0) & (space < 0.08), 0.5))
    printable = F.least(F.try_divide(c["printable"], c["total"]) / 0.95, F.lit(1.0)) * 0.25
    return F.when(c["total"] < SHORT, 1.0).when(c["total"].isNotNull(), printable + share(c["letters"], 0.6, 0.20) + share(c["word_chars"], 0.7, 0.25) + length * 0.15 + gaps * 0.15)


def scripts(text: str) -> dict[str, Column]:
    """Letters of each script."""
    return {s: _count(text, rf"\p{{Is{s.capitalize()}}}") for s in SCRIPTS}


def mixed_scripts(text: str) -> Column:
    """Places where a Latin letter touches a Cyrillic or Greek one, as in look-alike words."""
    return F.regexp_count(text, F.lit(r"\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}"))


def invisible(text: str) -> Column:
    return F.regexp_count(text, F.lit(INVISIBLE))


def normal_newlines(text: str) -> Column:
    return F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def one_line(text: str) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def split_words(text: str) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^ \t\r\n]+"), F.lit(0))


#: Fixed value: words of the longer sequence that one pass over the shorter takes, as the bits of one integer. No result depends on it.
MOST_WORDS = 8192


def edits(a: Sequence[str], b: Sequence[str], block: int = MOST_WORDS) -> int:
    """Edit distance of two sequences, one column of the table a step, its rows as the bits of one integer (H. Hyyrö, 2003).

    Rows beyond ``block`` go in blocks, each of which begins with the steps along the last row of the one above. So what
    is held grows with the two lengths alone; time grows with their product.
    """
    lo, la, lb = 0, len(a), len(b)
    while lo < min(la, lb) and a[lo] == b[lo]:
        lo += 1
    while lo < min(la, lb) and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    long, short = (a[lo:la], b[lo:lb]) if la >= lb else (b[lo:lb], a[lo:la])
    rise, fall = bytearray(b"\x01") * len(short), bytearray(len(short))
    for begin in range(0, len(long), block):
        rows = long[begin : begin + block]
        places: dict[str, int] = {}
        for i, w in enumerate(rows):
            places[w] = places.get(w, 0) | 1 << i
        full, top = (1 << len(rows)) - 1, len(rows) - 1
        up, down = full, 0
        for j, w in enumerate(short):
            x = places.get(w, 0) | down | fall[j]
            same = (((x & up) + up) ^ up | x) & full
            right, left = down | full ^ (up | same), up & same
            shifted = right << 1 & full | rise[j]
            up, down = left << 1 & full | fall[j] | full ^ (shifted | same), shifted & same
            rise[j], fall[j] = right >> top, left >> top
    return len(long) + rise.count(1) - fall.count(1)


def _distance(a: np.ndarray | None, b: np.ndarray | None) -> int | None:
    return None if a is None or b is None else edits(a.tolist(), b.tolist())


def word_distance(a: str, b: str) -> Column:
    """Edit distance in words of two arrays of words, however long they are."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return distance(F.col(a), F.col(b))


def statistics_of(raw: bytes) -> tuple[float, float, float, float, float]:
    """Entropy, mean, mean deviation from 127.5, serial correlation and Monte-Carlo error of pi of some bytes.

    No byte: all 0. Where all bytes are equal the correlation is -100000.
    Fewer than six bytes draw no point: error 0.
    """
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.float64)
    n = len(x)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    share = np.bincount(x.astype(np.int64), minlength=256) / n
    share = share[share > 0]
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    below = n * float((x * x).sum()) - float(x.sum()) ** 2
    serial = (n * float((x * np.roll(x, -1)).sum()) - float(x.sum()) ** 2) / below if below else -100000.0
    error = 0.0
    if n >= 6:
        points = x[: n // 6 * 6].reshape(-1, 2, 3) @ np.array([65536.0, 256.0, 1.0])
        inside = ((points / (2**24 - 1)) ** 2).sum(axis=1) <= 1.0
        error = abs(4 * float(inside.mean()) - np.pi) / np.pi
    return entropy, float(x.mean()), float(np.abs(x - 127.5).mean()), serial, error


def byte_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, entropy, byte_mean, byte_deviation, serial_correlation, pi_error) of the UTF-8 bytes; null text is empty."""
    names = ["entropy", "byte_mean", "byte_deviation", "serial_correlation", "pi_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [statistics_of((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)]
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.float64()) for c in (zip(*made, strict=True) if made else [[]] * 5))], [id_col, *names])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} long, " + ", ".join(f"{n} double" for n in names))
