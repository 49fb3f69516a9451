"""Statistics over scored messages: symbol hits, correlations, actions, classifier thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.scoring import each


def symbol_stats(scored: DataFrame, reject: float, junk: float) -> DataFrame:
    """Per symbol: hits, hits in spam, junk and ham, mean score, and verdicts that hang on it."""
    rows = each(scored.select("score", "findings")).select("score", "f.symbol", F.col("f.score").alias("weight"))
    spam, junked = F.col("score") >= reject, (F.col("score") >= junk) & (F.col("score") < reject)
    without = F.col("score") - F.col("weight")
    changes = ((F.col("weight") > 0) & spam & (without < reject)) | ((F.col("weight") < 0) & ~spam & (without >= reject))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("hits"),
        F.count_if(spam).alias("spam_hits"),
        F.count_if(junked).alias("junk_hits"),
        F.count_if(~spam & ~junked).alias("ham_hits"),
        F.round(F.sum("weight") / F.count("*"), 6).alias("avg_weight"),
        F.count_if(changes).alias("spam_change"),
    )


def correlations(scored: DataFrame) -> DataFrame:
    """(a, b, both, given): how often b is found where a is. Pairs are made within a row's few findings."""
    names = F.transform("findings", lambda f: f["symbol"])
    pairs = scored.select(names.alias("s")).select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("both"))
    alone = counts.filter("a = b").select("a", F.col("both").alias("hits"))
    return counts.filter("a != b").join(F.broadcast(alone), "a").select("a", "b", "both", F.round(F.col("both") / F.col("hits"), 6).alias("given"))  # one row a symbol


def action_shares(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("action").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("action", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row
