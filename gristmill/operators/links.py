"""A few links of many, spread over domains, the telling ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that mark a link; all boolean, a missing column is false.
FLAGS = ("numeric", "image", "displayed", "obscured", "has_user", "has_port", "subject", "phished")


def priority(flag: dict[str, Column], mail: Column) -> Column:
    """3 for an obscured address, 2 for one with a user or port, from the subject or phished, 1 else; 0 for an image or a text that only shows an address."""
    return (
        F.when(flag["image"], 0).when(flag["displayed"], 0).when(mail, 1).when(flag["obscured"], 3)
        .when(flag["has_user"] | flag["has_port"] | flag["subject"] | flag["phished"], 2).otherwise(1)
    )


def diversified(links: DataFrame, limit: int, per_domain: int = 9999, images: bool = False, numeric: bool = True, id_col: str = "id") -> DataFrame:
    """(id_col, pos, url, domain, place): at most ``limit`` links of each id, or what the last round began, spread over its domains.

    ``links`` has id_col, pos (the order in the id), url, domain (its registered
    domain; without one a link is left out) and any of ``FLAGS``. Of a domain the
    first ``per_domain`` links come into question. The domains are in order of
    their best priority, then of fewer links, then of where their best link is.
    Each round takes from every domain its link of highest priority, of equal
    ones the last. With no more domains than ``limit``, rounds are finished once
    begun; with more, the same is done for the endings of domains (without
    their first label), up to exactly ``limit``. A url that was taken before counts
    towards the limit and is not given twice.

    Links are counted and cut by domain before they meet by id, so that an id
    with very many links is split; no id's links are cut otherwise.
    """
    flag = {f: F.coalesce(F.col(f), F.lit(False)) if f in links.columns else F.lit(False) for f in FLAGS}
    rows = links.select(F.col(id_col).alias("id"), "pos", "url", F.lower("domain").alias("domain"), priority(flag, F.lower("url").startswith("mailto:")).alias("priority"), flag["image"].alias("image"), flag["numeric"].alias("numeric"))
    rows = rows.filter("domain <> ''" + ("" if images else " and not image") + ("" if numeric else " and not numeric")).drop("image", "numeric")
    first = Window.partitionBy("id", "domain").orderBy("pos")
    rows = rows.withColumn("nth", F.row_number().over(first))
    domains = rows.groupBy("id", "domain").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("domains"))
    rows = rows.join(domains, "id")

    few = _in_rounds(rows.filter((F.col("domains") <= limit) & (F.col("nth") <= per_domain)).withColumn("key", F.col("domain")), limit)
    begun = Window.partitionBy("id").orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("before", F.coalesce(F.count("*").over(begun), F.lit(0))).filter(F.col("before") < limit).drop("before")
    many = _in_rounds(rows.filter(F.col("domains") > limit).withColumn("key", F.substring("domain", F.instr("domain", ".") + 1, 10_000)), limit)
    turn = Window.partitionBy("id").orderBy("round", *_order())
    many = many.withColumn("n", F.row_number().over(turn)).filter(F.col("n") <= limit).drop("n")

    again = Window.partitionBy("id", "url").orderBy("round", *_order())
    once = few.unionByName(many).withColumn("n", F.row_number().over(again)).filter("n = 1")
    return once.select(F.col("id").alias(id_col), "pos", "url", "domain", F.row_number().over(turn).alias("place"))


def _order() -> tuple:
    """The order of the keys within a round."""
    return F.desc("top"), "size", "top_pos"


def _in_rounds(rows: DataFrame, limit: int) -> DataFrame:
    """The round in which each link's turn comes within its key, and the figures that order the keys."""
    turn = Window.partitionBy("id", "key").orderBy(F.desc("priority"), F.desc("pos"))
    keys = rows.groupBy("id", "key").agg(F.count("*").alias("size"), F.max(F.struct("priority", "pos")).alias("best"))
    taken = rows.withColumn("round", F.row_number().over(turn)).filter(F.col("round") <= limit)
    return taken.join(keys, ["id", "key"]).select("id", "pos", "url", "domain", "round", "size", F.col("best.priority").alias("top"), F.col("best.pos").alias("top_pos"))
