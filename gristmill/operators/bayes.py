"""Bayesian token statistics: learning counts, classifying by Fisher's combination, evaluating."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import maps

#: A token's probability strength below this is skipped, and the prior's weight.
MIN_STRENGTH = 0.05


#: Labels are broadcast up to this many, else joined by shuffle.
LABELS_BROADCAST = 2_000_000
#: Tokens of a batch of output, roughly, and pairs whose token a worker remembers.
ROWS, REMEMBERED = 100_000, 200_000
_WORD = re.compile("[a-z0-9]+")


def _token(pair: tuple[str, str]) -> int:
    return int.from_bytes(hashlib.md5(f"{pair[0]}\x1f{pair[1]}\x1f1".encode()).digest()[:8], "big") >> 4


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, columns in ``keep``, token): the distinct adjacent word pairs of every text, as 60-bit integers.

    The same tokens as ``hash60`` of ``word_pairs``; a pair that comes again is hashed once a worker.
    """
    columns = [id_col, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        for b in batches:
            counts, made = np.zeros(b.num_rows, np.int64), []

            def batch(b=b, counts=counts, made=made) -> pa.RecordBatch:
                at = pa.array(np.repeat(np.arange(b.num_rows), counts))
                return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(columns))), pa.array(made, pa.int64())], [*columns, "token"])

            for i, text in enumerate(b.column(len(columns))):
                words = _WORD.findall(text.as_py() or "")
                pairs = set(zip(words, words[1:]))
                for pair in pairs:
                    token = known.get(pair)
                    if token is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        token = known[pair] = _token(pair)
                    made.append(token)
                counts[i] = len(pairs)
                if len(made) > ROWS:
                    yield batch()
                    counts[:] = 0
                    made.clear()
            if made:
                yield batch()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.lower(text_col).alias("__text")).mapInArrow(run, f"{kinds}, token long")


def _labelled_tokens(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, label, token) of the texts that ``known`` labels: no other text is cut into tokens."""
    return tokens(docs.select(id_col, text_col).join(maps.small(known, LABELS_BROADCAST), id_col), id_col, text_col, ["label"])


def _learned(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    spam, ham = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return rows.groupBy("token").agg(spam.alias("spam_n"), ham.alias("ham_n")), known.agg(spam.alias("spam_learns"), ham.alias("ham_learns"))


def learn(token_rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """Token counts (token, spam_n, ham_n) and the learned documents per class (one row)."""
    known = labels.select(id_col, F.col(label_col).alias("label"))
    return _learned(token_rows.join(known, id_col), known)


def learn_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "label", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``learn`` from the texts themselves."""
    known = labels.select(id_col, F.col(label_col).alias("label"))
    return _learned(_labelled_tokens(docs, known, id_col, text_col), known)


def merge(old: DataFrame, new: DataFrame, sign: int = 1) -> DataFrame:
    """Counts after learning (sign 1) or unlearning (-1) more; no count falls below 0."""
    both = old.unionByName(new.select("token", (F.col("spam_n") * sign).alias("spam_n"), (F.col("ham_n") * sign).alias("ham_n")))
    return both.groupBy("token").agg(F.greatest(F.sum("spam_n"), F.lit(0)).alias("spam_n"), F.greatest(F.sum("ham_n"), F.lit(0)).alias("ham_n"))


def token_probability(spam_learns: Column, ham_learns: Column) -> tuple[Column, Column]:
    """Smoothed probability of spam and of ham from spam_n and ham_n."""
    s, h = F.col("spam_n") / F.greatest(spam_learns, F.lit(1)), F.col("ham_n") / F.greatest(ham_learns, F.lit(1))
    p, n = s / (s + h), (F.col("spam_n") + F.col("ham_n")).cast("double")
    w = n / (1 + n)
    return (w * 0.5 + n * p) / (w + n), (w * 0.5 + n * (1 - p)) / (w + n)


def evidence(token_rows: DataFrame, counts: DataFrame, learns: DataFrame, id_col: str = "doc_id", strength: float = MIN_STRENGTH) -> DataFrame:
    """(id_col, n_tokens, ln_bp, ln_bh): telling tokens of every row that has any, and the sums of their logs.

    Logs are taken once a token and summed in units of 1e-9 as integers, so that
    the order of addition, and with it the partitioning, does not change the result.
    """
    bp, bh = token_probability(F.col("spam_learns"), F.col("ham_learns"))
    telling = counts.crossJoin(F.broadcast(learns)).withColumns({"bp": bp, "bh": bh}).filter(F.abs(F.col("bp") - 0.5) >= strength)  # learns is one row by construction
    weights = telling.select("token", *[F.round(F.ln(c) * 1e9).cast("long").alias(f"ln_{c}") for c in ("bp", "bh")])
    return token_rows.join(weights, "token").groupBy(id_col).agg(F.count("*").alias("n_tokens"), *[(F.sum(c) / 1e9).alias(c) for c in ("ln_bp", "ln_bh")])


def classify(token_rows: DataFrame, counts: DataFrame, learns: DataFrame, id_col: str = "doc_id", strength: float = MIN_STRENGTH) -> DataFrame:
    """(id_col, n_tokens, prob): probability of spam for every row with a telling token."""
    sums = evidence(token_rows, counts, learns, id_col, strength)
    fisher_h, fisher_s = 1 - T.inverse_chi_square(F.col("ln_bp"), F.col("n_tokens")), 1 - T.inverse_chi_square(F.col("ln_bh"), F.col("n_tokens"))
    small = (F.col("ln_bp") > -300) & (F.col("ln_bh") > -300)
    gap = F.least(F.greatest(F.col("ln_bh") - F.col("ln_bp"), F.lit(-500.0)), F.lit(500.0))
    return sums.select(id_col, "n_tokens", F.when(small, (fisher_s + 1 - fisher_h) / 2).otherwise(1 / (1 + F.exp(gap))).alias("prob"))


def evaluate(predicted: Column, actual: Column) -> list[Column]:
    """Aggregates: true and false positives and negatives, accuracy, precision, recall, F1."""
    tp, fp = F.count_if(predicted & actual), F.count_if(predicted & ~actual)
    fn, tn = F.count_if(~predicted & actual), F.count_if(~predicted & ~actual)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def _learned_classes(rows: DataFrame, known: DataFrame, classes: list[int]) -> tuple[DataFrame, DataFrame]:
    each = [F.count_if(F.col("label") == c) for c in classes]
    return rows.groupBy("token").agg(*[n.alias(f"n_{k}") for k, n in enumerate(each)]), known.agg(*[n.alias(f"l_{k}") for k, n in enumerate(each)])


def learn_classes(token_rows: DataFrame, labels: DataFrame, classes: list[int], id_col: str = "doc_id", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """Counts (token, n_0, n_1 ...) and learned documents (one row: l_0, l_1 ...) of several classes."""
    known = labels.select(id_col, F.col(label_col).alias("label")).filter(F.col("label").isin(*classes))
    return _learned_classes(token_rows.join(known, id_col), known, classes)


def learn_class_texts(docs: DataFrame, labels: DataFrame, classes: list[int], id_col: str = "doc_id", label_col: str = "label", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``learn_classes`` from the texts themselves."""
    known = labels.select(id_col, F.col(label_col).alias("label")).filter(F.col("label").isin(*classes))
    return _learned_classes(_labelled_tokens(docs, known, id_col, text_col), known, classes)


def classify_classes(token_rows: DataFrame, counts: DataFrame, learns: DataFrame, classes: list[int], id_col: str = "doc_id", strength: float = MIN_STRENGTH) -> DataFrame:
    """(id_col, n_tokens, class, prob): the likeliest class by softmax over log sums (ties: the first).

    A class takes part in a token only where its probability differs from 1 / N
    by ``strength``; n_tokens counts tokens that tell of any class. One row a
    token goes into the shuffle, whatever the number of classes; logs are taken
    once a token of ``counts``.
    """
    size, ks = len(classes), range(len(classes))
    n = sum((F.col(f"n_{k}") for k in ks), F.lit(0)).cast("double")
    w = n / (1 + n)
    made = counts.crossJoin(F.broadcast(learns))  # learns is one row by construction
    made = made.withColumns({f"p_{k}": F.least((w / size + n * F.col(f"n_{k}") / F.greatest(F.col(f"l_{k}"), F.lit(1))) / (w + n), F.lit(1.0)) for k in ks})
    made = made.select("token", *[F.when(F.abs(F.col(f"p_{k}") - 1 / size) >= strength, F.round(F.ln(f"p_{k}") * 1e9).cast("long")).alias(f"e_{k}") for k in ks])
    met = token_rows.join(made.filter(F.coalesce(*[F.col(f"e_{k}") for k in ks]).isNotNull()), "token")
    sums = met.groupBy(id_col).agg(F.count("*").alias("n_tokens"), *[(F.coalesce(F.sum(f"e_{k}"), F.lit(0)) / 1e9).alias(f"s_{k}") for k in ks])
    scores = F.array(*[F.col(f"s_{k}") for k in ks])
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    names = F.array(*[F.lit(c) for c in classes])
    return sums.select(id_col, "n_tokens", F.element_at(names, F.array_position(scores, top).cast("int")).alias("class"), (1 / total).alias("prob"))


def expiry(counts: DataFrame, classes: list[str], epsilon: float = 0.01, significant: float = 0.75) -> DataFrame:
    """``counts`` with kind: what a token is worth keeping for.

    ``common``: no class dominates; else from the mean count on ``significant``
    (one class has more than that share) or ``insignificant``; else ``infrequent``.
    """
    total, most = sum((F.col(c) for c in classes), F.lit(0)), F.greatest(*[F.col(c) for c in classes])
    mean = counts.agg(F.avg(total).alias("__mean"))
    kind = (
        F.when((total == 0) | (most / total <= 1 - epsilon), "common")
        .when(total < F.col("__mean"), "infrequent")
        .when(most / total > significant, "significant")
        .otherwise("insignificant")
    )
    return counts.crossJoin(F.broadcast(mean)).withColumn("kind", kind).drop("__mean")  # mean is one row


def autolearn(score: Column, spam_from: float, ham_to: float, spam_learns: Column, ham_learns: Column, balance: float = 0.9) -> Column:
    """What a message teaches: spam or ham beyond its threshold, unless that class is ahead by ``balance``."""
    return (
        F.when((score >= spam_from) & (spam_learns * balance <= ham_learns), "spam")
        .when((score <= ham_to) & (ham_learns * balance <= spam_learns), "ham")
        .when((score >= spam_from) | (score <= ham_to), "unbalanced")
    )


def balanced(labels: DataFrame, id_col: str, label_col: str, salt: str = "train") -> DataFrame:
    """A training set with about as many rows of each label, chosen by hash: reruns agree.

    The rarest label keeps all its rows and the others their share; no label's
    rows are gathered. Rows with a null label are left out.
    """
    known = labels.filter(F.col(label_col).isNotNull())
    sizes = known.groupBy(F.col(label_col).alias("__label")).agg(F.count("*").alias("__n"))
    least = sizes.agg(F.min("__n").alias("__least"))
    share = sizes.crossJoin(F.broadcast(least)).select("__label", F.floor(F.col("__least") * 1_000_000 / F.col("__n")).alias("__cut"))
    draw = T.hash60(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string"))) % 1_000_000
    return known.join(F.broadcast(share), F.col(label_col) == F.col("__label")).filter(draw < F.col("__cut")).drop("__label", "__cut")  # one row a label
