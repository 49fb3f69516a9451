"""URL filters: explicit host and path rules, then a path-template tree per host.

The tree is grown level by level over all distinct paths, as deep as labels call
for. Rules supply the labels. A node whose labelled pages are all alike needs no
branches: whatever follows becomes wildcards. At a node with mixed labels, a
segment that varies with almost every page becomes one wildcard; other branches
are merged with those siblings that are statistically similar: labelled or not
alike, leaves or inner branches alike, and next to each other in blocked share
without a significant difference. A template's purity is its blocked share of
labelled pages, smoothed towards that of its parent, the host and all pages in
turn; templates whose purity exceeds ``REJECT`` are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import lookup, settle

#: A node with so many children, and more than the root of its pages, is variable.
MANY_CHILDREN = 8
#: Standard errors by which the blocked shares of two siblings must differ to stay apart.
APART = 1.5
#: Labelled pages that the parent's purity counts as, and the purity above which a template goes.
PRIOR, REJECT = 4.0, 0.75
RULE_SCHEMA = "rule string, verdict string"


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules of a host and of all domains above it, the longest first."""
    split = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("domain")).withColumn("start", F.expr("substring(rule, length(domain) + 1)"))
    by_domain = split.groupBy("domain").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "start", "verdict")).alias("list"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return (
        hosts.select("host", F.explode(above).alias("domain"))
        .join(by_domain, "domain")
        .groupBy("host")
        .agg(F.sort_array(F.flatten(F.collect_list("list")), asc=False).alias("fits"))
    )


def _names(child: DataFrame, node: list[str]) -> DataFrame:
    """(node, seg, name) of the branches of nodes that are not variable; branches with one name are merged."""
    kids = settle(child.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("c_n").alias("pages")).filter((F.col("kids") < MANY_CHILDREN) | (F.col("kids") * F.col("kids") <= F.col("pages"))))
    alike = [*node, "labelled", "leaf"]
    branches = lookup(child, kids, node, "inner").withColumns({"labelled": F.col("c_known") > 0, "leaf": F.col("c_ends") * 2 >= F.col("c_n")})
    share = F.coalesce(F.col("c_bad") / F.nullif(F.col("c_known"), F.lit(0)), F.lit(0.0))
    order = Window.partitionBy(*alike).orderBy("share", "seg")
    known, before = F.nullif(F.col("c_known"), F.lit(0)), F.nullif(F.col("known_before"), F.lit(0))  # unlabelled siblings have no error
    pooled = (F.col("c_bad") + F.col("bad_before")) / (known + before)
    error = pooled * (1 - pooled) * (1 / known + 1 / before)
    gap = F.col("share") - F.col("share_before")
    apart = F.when(F.col("labelled") & (gap * gap > APART * APART * error), 1).otherwise(0)
    branches = branches.withColumn("share", share).withColumns({f"{x}_before": F.lag(c).over(order) for x, c in (("share", "share"), ("bad", "c_bad"), ("known", "c_known"))})
    grouped = branches.withColumn("apart", apart).withColumn("class", F.sum("apart").over(order))
    members = Window.partitionBy(*alike, "class")
    own = F.regexp_replace("seg", r"^\*", "%2A")
    return grouped.select(*node, "seg", F.when(F.count("*").over(members) == 1, own).otherwise(F.concat(F.lit("*"), F.min("seg").over(members))).alias("name"))


def _templates(tree: DataFrame) -> DataFrame:
    """``tree`` with template and prior, the purity of the node that the template hangs on."""
    node = ["host", "template"]
    whole = tree.agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).first()
    prior = ((whole["bad"] or 0) + 1) / ((whole["known"] or 0) + 2)
    live, done, level = tree.withColumns({"template": F.lit(""), "prior": F.lit(prior)}), [], 0
    while level == 0 or not live.isEmpty():
        bad, known = F.sum("bad"), F.sum("known")
        nodes = settle(live.groupBy(*node).agg(((bad > 0) & (bad < known)).alias("mixed"), ((bad + PRIOR * F.max("prior")) / (known + PRIOR)).alias("purity")))
        seen = lookup(live.drop("prior"), nodes, node).withColumnRenamed("purity", "prior").withColumn("seg", F.get("segments", F.lit(level)))
        rest = F.when(F.col("mixed"), 0).otherwise(F.greatest(F.size("segments") - level, F.lit(0)))
        ended = seen.filter("not mixed or seg is null").withColumn("template", F.concat("template", F.repeat(F.lit("/*"), rest)))
        done.append(ended.select(*tree.columns, "template", "prior"))
        going = seen.filter("mixed and seg is not null").drop("mixed")
        child = settle(going.groupBy(*node, "seg").agg(F.sum("n").alias("c_n"), F.sum("bad").alias("c_bad"), F.sum("known").alias("c_known"), F.sum(F.when(F.size("segments") == level + 1, F.col("n")).otherwise(0)).alias("c_ends")))
        grown = lookup(going, settle(_names(child, node)), [*node, "seg"])
        live = settle(grown.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))).select(*tree.columns, "template", "prior"))
        level += 1
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict, template, purity.

    A url that is null or has no ``://`` has an empty host and path and fits no
    rule. verdict is the rule's, else ``block`` where the template's purity
    exceeds ``REJECT`` and ``allow`` otherwise; of rules equally long the last by
    name wins. Paths of any length and depth are read whole. Columns with the
    added names are replaced, repeated rows stay repeated, and an empty table
    gives an empty result. ``rules`` has rule (``domain/path``) and verdict.
    """
    added = ("host", "path", "rule", "verdict", "template", "purity")
    pages = pages.drop(*added).withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    paths = settle(pages.groupBy("host", "path").agg(F.count("*").alias("n")))
    fitting = settle(_rules_of_hosts(paths.select("host").distinct(), rules))
    first = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/", -1))
    tree = lookup(paths, fitting, ["host"]).withColumn("fit", first).select("host", "path", "n", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("label"), segments.alias("segments"))
    tree = settle(tree.withColumns({"bad": F.when(F.col("label") == "block", F.col("n")).otherwise(0), "known": F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)}))
    tree = settle(_templates(tree).drop("segments"))
    by_template = settle(tree.groupBy("host", "template").agg(((F.sum("bad") + PRIOR * F.max("prior")) / (F.sum("known") + PRIOR)).alias("purity")))
    judged = lookup(tree, by_template, ["host", "template"]).select("host", "path", "rule", "template", "purity", F.coalesce("label", F.when(F.col("purity") > REJECT, "block").otherwise("allow")).alias("verdict"))
    return pages.join(judged, ["host", "path"]).select(*[c for c in pages.columns if c not in added], *added)
