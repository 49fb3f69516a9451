"""The stored set of fuzzy digests as a table that batches of commands change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A digest holds at most this many flags, those of the greatest values.
FLAGS = 8


def apply(commands: DataFrame, tie: str, flags: int = FLAGS) -> DataFrame:
    """(digest, flag, value, touched): the stored set after all commands (digest, flag, command, value, t).

    ``add`` adds its value, ``refresh`` renews the time of what is stored, ``delete``
    removes a digest's flag and all that was added before. Commands of one time come
    in the order of ``tie``. Only each slot's last delete is joined back, so commands
    are folded by partial aggregation; a hot digest's side is split by AQE.
    """
    rows = commands.filter("digest is not null and flag is not null")
    deleted = rows.filter("command = 'delete'").groupBy("digest", "flag").agg(F.max(F.struct("t", tie)).alias("deleted"))
    alive = rows.filter("command <> 'delete'").join(deleted, ["digest", "flag"], "left").filter(F.col("deleted").isNull() | (F.struct("t", tie) > F.col("deleted")))
    added = F.col("command") == "add"
    stored = alive.groupBy("digest", "flag").agg(F.sum(F.when(added, F.col("value"))).alias("value"), F.max("t").alias("touched")).filter("value is not null")
    best = Window.partitionBy("digest").orderBy(F.desc("value"), "flag")
    return stored.withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= flags).drop("slot")


def expire(stored: DataFrame, now: int, ttl: int) -> DataFrame:
    """What was touched within ``ttl`` before ``now``."""
    return stored.filter(F.col("touched") >= now - ttl)


def counts(stored: DataFrame) -> DataFrame:
    """Digests, summed value and newest time of each flag."""
    return stored.groupBy("flag").agg(F.count("*").alias("digests"), F.sum("value").alias("total"), F.max("touched").alias("newest"))
