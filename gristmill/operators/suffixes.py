"""Public suffixes and registered domains, by the rules of a suffix list.

A host's prevailing rule is an exception (``!www.ck``) if one fits, else the
fitting rule with most labels, else ``*``. An exception's suffix is the rule
without its first label; the registered domain is the suffix and one label more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.maps import small


def host_labels(host: Column) -> Column:
    """Labels of a host, lower case, without a dot at the end; null for hosts with an empty label and for addresses."""
    plain = F.lower(F.regexp_replace(F.trim(host), r"\.$", ""))
    labels = F.split(plain, r"\.", -1)
    numeric = plain.rlike(r"^[0-9]+(\.[0-9]+){3}$") | plain.contains(":")
    return F.when((plain != "") & ~F.array_contains(labels, "") & ~numeric, labels)


def last_labels(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def rule_table(rules: DataFrame, column: str = "rule") -> DataFrame:
    """(key): distinct rules, lower case, without comments and blank lines."""
    return rules.select(F.lower(F.trim(F.regexp_replace(column, r"\s.*$", ""))).alias("key")).filter("key <> '' and not key like '//%'").distinct()


def registered(rows: DataFrame, host_col: str, rules: DataFrame) -> DataFrame:
    """``rows`` with suffix and domain: the public suffix of each host and its registered domain.

    Every distinct host is taken apart into its endings, at most three keys a
    label, which meet the rules in one equi-join (by broadcast if counting shows
    that the list is small). domain is null for a host that is a suffix itself;
    both are null for null hosts, addresses and hosts with empty labels.
    Columns already called suffix or domain are replaced; every row stays.
    """
    rows = rows.drop("suffix", "domain")
    hosts = rows.select(F.col(host_col).alias("host")).filter(F.col(host_col).isNotNull()).distinct().withColumn("labels", host_labels(F.col("host"))).filter("labels is not null")
    ends = hosts.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    own = last_labels(F.col("labels"), F.col("n"))
    star = F.when(F.col("n") > 1, F.concat(F.lit("*."), last_labels(F.col("labels"), F.col("n") - 1))).otherwise(F.lit("*"))
    keys = ends.select("host", "n", F.explode(F.array(F.struct(own.alias("key"), F.lit(False).alias("exception")), F.struct(star.alias("key"), F.lit(False).alias("exception")), F.struct(F.concat(F.lit("!"), own).alias("key"), F.lit(True).alias("exception")))).alias("k"))
    fit = keys.select("host", "n", "k.key", "k.exception").join(small(rule_table(rules)), "key").groupBy("host").agg(F.max(F.struct("exception", "n")).alias("best"))
    found = hosts.join(fit, "host", "left").withColumn("size", F.coalesce(F.when(F.col("best.exception"), F.col("best.n") - 1).otherwise(F.col("best.n")), F.lit(1)))
    found = found.select(F.col("host").alias(host_col), last_labels(F.col("labels"), F.col("size")).alias("suffix"), F.when(F.size("labels") > F.col("size"), last_labels(F.col("labels"), F.col("size") + 1)).alias("domain"))
    return rows.join(found, host_col, "left").select(*rows.columns, "suffix", "domain")
