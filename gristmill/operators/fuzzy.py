"""Fuzzy storage: minhash shingles of three-word windows, and matching against a stored set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Keyed hashes of a fingerprint.
SHINGLES = 32


def shingles(docs: DataFrame, id_col: str, text_col: str = "text", hashes: int = SHINGLES, width: int = 3) -> DataFrame:
    """(id_col, pos, value): for each keyed hash the least value over all windows of words.

    Windows are exploded and folded with partial aggregation; a text with fewer
    words than a window has no rows.
    """
    windows = docs.select(id_col, F.explode(T.word_windows(F.col(text_col), width)).alias("w")).select(id_col, F.md5(F.col("w").cast("binary")).alias("h"))
    # One digest gives four independent 30-bit values; a keyed affine map of two of them gives the hashes.
    a, b = (F.conv(F.substring("h", p, 7), 16, 10).cast("long") for p in (1, 9))
    windows = windows.select(id_col, a.alias("a"), b.alias("b"))
    least = [F.min(F.pmod(F.col("a") + F.col("b") * (k + 1), F.lit(2147483647))).alias(f"v{k}") for k in range(hashes)]
    folded = windows.groupBy(id_col).agg(*least)
    return folded.select(id_col, F.posexplode(F.array(*[f"v{k}" for k in range(hashes)])).alias("pos", "value"))


def match(checked: DataFrame, stored: DataFrame, id_col: str, stored_col: str, least: float = 0.5, hashes: int = SHINGLES) -> DataFrame:
    """(id_col, stored_col, share): the stored fingerprint that agrees best, above ``least`` of the positions."""
    met = checked.join(stored.select(stored_col, "pos", "value"), ["pos", "value"]).groupBy(id_col, stored_col).agg((F.count("*") / hashes).alias("share")).filter(F.col("share") > least)
    return met.groupBy(id_col).agg(F.max(F.struct("share", (-F.col(stored_col)).alias("neg"))).alias("best")).select(id_col, (-F.col("best.neg")).alias(stored_col), F.col("best.share").alias("share"))


def score(share: str, hits: str, limit: float = 10.0, bias: float = 0.5) -> Column:
    """Weight of a match from its share of positions and the stored hit count."""
    return F.tanh(F.lit(2.718281828459045) * F.col(hits) / limit) * ((F.col(share) - bias) / (1 - bias))
