"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed n-grams of its lower-cased text.
Per feature, r is the log of the smoothed ratio of the shares of toxic and
clean documents that hold it, counted over all labelled training rows in one
Spark aggregation. A logistic regression is fitted on a bounded sample: the
features that tell the classes apart best have a weight of their own each,
scaled by r; all others that were ever seen share one weight, that of the mean
of their r over the document. While fitting, a document's own counts are left
out of the r of these others, which are mostly rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import held_out, settle
from gristmill.llm.wordhash import mix, slices

_U = np.uint64
#: n-gram lengths in code points, and the bits of a hashed feature.
GRAMS = (4, 5, 6)
BITS = 20
#: Characters of text whose n-grams are held at once.
SLICE = 400_000
#: Ids of labelled rows up to this many are broadcast (12 bytes each), else joined by shuffle.
LABELS_BROADCAST = 200_000


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of all distinct features of the texts, sorted by text."""
    texts = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    keys = []
    for n in GRAMS:
        if len(points) < n:
            continue
        span = len(points) - n + 1
        h = np.full(span, n, dtype=np.uint64)
        for j in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + points[j : j + span]
        inside = owner[:span] == owner[n - 1 :]
        keys.append((owner[:span][inside] << _U(BITS)) | (mix(h[inside]) >> _U(64 - BITS)))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    key = key[np.diff(key, prepend=_U(2**64 - 1)) != 0] if len(key) else key
    return (key >> _U(BITS)).astype(np.int64), (key & _U((1 << BITS) - 1)).astype(np.int64)


class ToxicModel:
    """Weight of every hashed feature, log-count ratio of those that share a weight, and the intercept."""

    def __init__(self, weight: np.ndarray, intercept: float, ratio: np.ndarray | None = None, shared: float = 0.0):
        self.weight, self.intercept, self.ratio, self.shared = weight, intercept, ratio, shared

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, f = features(texts)
        z = np.bincount(row, self.weight[f], len(texts)) + self.intercept
        if self.ratio is not None:
            r = self.ratio[f]
            z += self.shared * np.bincount(row, r, len(texts)) / np.maximum(1, np.bincount(row, r != 0, len(texts)))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of the rows that may be learned from; a document labelled twice counts for each label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out("id"))
    known = F.broadcast(known) if known.count() <= LABELS_BROADCAST else known
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature, summed within the task."""
    held = np.zeros((2, 1 << BITS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for b in batches:
        texts, y = b.column(0).to_pylist(), b.column(1).to_numpy()
        for lo, hi in slices(texts, SLICE):
            row, f = features(texts[lo:hi])
            for c in (0, 1):
                held[c] += np.bincount(f[y[lo:hi][row] == c], minlength=1 << BITS)
        rows += np.bincount(y, minlength=2)
    some = np.flatnonzero(held.any(axis=0))
    yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(held[0][some], rows[0])), pa.array(np.append(held[1][some], rows[1]))], ["feature", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", kept_features: int = 4000, sample_rows: int = 8000, smoothing: float = 1.0, l2: float = 2.0) -> ToxicModel:
    """Counts over all labelled rows; the regression on ``sample_rows`` of them, by least id hash (up to twice as many where rows repeat an id).

    ``kept_features`` have weights of their own, all others one in common. The
    2**BITS counts fit the driver whatever the input's size. No labelled rows: a
    model that scores 0. One class only: its share decides. Nulls among ids, texts
    and labels, repeated rows, ties, other columns and texts of any length do no
    harm; a null text counts as empty.
    """
    rows = _labelled(docs, labels, id_col, text_col, label_col)
    counts = settle(rows.select("text", "y").mapInArrow(_count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    total = counts.filter("feature = -1").first()
    if total is None or not total["clean"] + total["toxic"]:
        return ToxicModel(np.zeros(1 << BITS), -500.0)
    n0, n1 = float(total["clean"]), float(total["toxic"])
    c, t = F.col("clean") + F.lit(smoothing), F.col("toxic") + F.lit(smoothing)
    p, q = t / (n1 + 2 * smoothing), c / (n0 + 2 * smoothing)
    ranked = counts.filter("feature >= 0").withColumns({"r": F.ln(p / q), "sure": F.abs(F.ln(p / q)) / F.sqrt((1 - p) / t + (1 - q) / c)})
    best = ranked.orderBy(F.col("sure").desc(), "feature").limit(kept_features).toPandas()  # kept_features rows at most
    f, ratio = best["feature"].to_numpy(dtype=np.int64), best["r"].to_numpy(dtype=float)
    slot = np.full(1 << BITS, -1, dtype=np.int64)
    slot[f] = np.arange(len(f))
    every = counts.filter("feature >= 0").toArrow()  # 2**BITS rows at most
    seen = np.zeros((2, 1 << BITS), dtype=np.int32)
    for k, name in enumerate(("clean", "toxic")):
        seen[k, every.column("feature").to_numpy()] = every.column(name).to_numpy()
    del every

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = b.column(0).to_pylist(), b.column(1)
            for lo, hi in slices(texts, SLICE):
                row, x = features(texts[lo:hi])
                other = slot[x] < 0
                r = _rest(seen[:, x[other]], n0, n1, y.to_numpy()[lo:hi][row[other]])
                rest = np.bincount(row[other], r, hi - lo) / np.maximum(1, np.bincount(row[other], r != 0, hi - lo))
                row, x = row[~other], slot[x[~other]]
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch([y[lo:hi], pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))), pa.array(rest)], ["y", "x", "rest"])

    # The cut is found on ids alone, so that no text is sorted or gathered in one task.
    hashes = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(sample_rows)
    cut = hashes.agg(F.max("h")).first()[0]
    near = rows.filter(F.xxhash64("id") <= cut)
    got = near.select("text", "y").mapInArrow(picked, "y int, x array<int>, rest double").limit(2 * sample_rows).toArrow()
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("x").combine_chunks()
    x = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    w, b = _fit(row, x, ratio, got.column("rest").to_numpy(), y, l2)
    weight = np.zeros(1 << BITS)
    weight[f] = w[:-1] * ratio
    rest = _rest(seen, n0, n1)
    rest[f] = 0
    return ToxicModel(weight, b, rest.astype(np.float32), float(w[-1]))


def _rest(seen: np.ndarray, n0: float, n1: float, own: np.ndarray | None = None) -> np.ndarray:
    """Log-count ratios, smoothed by the classes' shares, without the ``own`` label's document; 0 where nothing is left."""
    clean, toxic = (seen[0], seen[1]) if own is None else (seen[0] - (own == 0), seen[1] - (own == 1))
    e = 2 / (n0 + n1)
    return np.where(clean + toxic > 0, np.log((toxic / max(n1, 1) + e) / (clean / max(n0, 1) + e)), 0.0)


def _fit(row: np.ndarray, x: np.ndarray, ratio: np.ndarray, rest: np.ndarray, y: np.ndarray, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent with a step from the data's own curvature.

    The last weight is that of ``rest``, one value a row.
    """
    n = max(1, len(y))
    row, x = np.append(row, np.arange(len(y), dtype=np.int32)), np.append(x, np.full(len(y), len(ratio), dtype=np.int32))
    value = np.append(ratio[x[: len(x) - len(y)]], rest).astype(np.float32)
    ratio = np.append(ratio, 0.0)
    mass = np.bincount(row, np.abs(value), n)
    reach = np.bincount(x, np.abs(value) * mass[row], len(ratio))
    rate = 1 / (0.25 * reach + l2)
    base = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w, b = np.zeros(len(ratio)), float(np.log(base / (1 - base)))
    at_w, at_b, momentum = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * at_w[x], n) + at_b, -500, 500)))
        miss = p - y
        new_w = at_w - rate * (np.bincount(x, value * miss[row], len(ratio)) + l2 * at_w)
        new_b = at_b - 2 * miss.sum() / n
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at_w, at_b = new_w + (momentum - 1) / grown * (new_w - w), new_b + (momentum - 1) / grown * (new_b - b)
        w, b, momentum = new_w, new_b, grown
    return w, float(b)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and score (0 to 1, a null text counts as empty).

    Repeated rows, ties and other columns do not matter; a column named score is
    replaced; texts of any length count whole; an empty table gives an empty result.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(texts, SLICE):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts[lo:hi]))], names=[*part.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")
