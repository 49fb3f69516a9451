"""Findings, their folding into scores, caps, actions, verdicts and composites.

A message's findings are one array column, so all of this is per row: nothing
is shuffled and the cost is one pass over the messages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import expr


@dataclass(frozen=True)
class SymbolRule:
    """A rule that emits a symbol with a weight, as often as it hits, up to ``shots``."""

    symbol: str
    hits: Callable[[], Column]
    weight: float
    group: str
    shots: int = 1


@dataclass(frozen=True)
class Composite:
    """A symbol emitted where an expression over symbols is true.

    policy says what its parts lose: ``remove`` score and symbol, ``remove_weight``
    the score, ``leave`` nothing.
    """

    symbol: str
    expression: str
    weight: float
    policy: str = "remove"
    group: str = "composite"


@dataclass(frozen=True)
class Limits:
    """Caps of groups (positive sum), thresholds of actions and the grow factor."""

    groups: dict[str, float] = field(default_factory=dict)
    actions: dict[str, float] = field(default_factory=lambda: {"greylist": 1.0, "add header": 2.0, "reject": 3.5})
    grow_factor: float = 1.0


FINDING = "array<struct<symbol:string,grp:string,hits:int,score:double>>"


def findings(docs: DataFrame, rules: list[SymbolRule]) -> DataFrame:
    """``docs`` with findings: one entry for each rule that hits, in order of the rules."""
    made = [F.struct(F.lit(r.symbol).alias("symbol"), F.lit(r.group).alias("grp"), F.least(r.hits().cast("int"), F.lit(r.shots)).alias("hits"), F.lit(float(r.weight)).alias("weight")) for r in rules]
    kept = F.filter(F.array(*made), lambda f: f["hits"] > 0)
    return docs.withColumn("findings", F.transform(kept, lambda f: F.struct(f["symbol"].alias("symbol"), f["grp"].alias("grp"), f["hits"].alias("hits"), (f["hits"] * f["weight"]).alias("score"))))


def each(df: DataFrame) -> DataFrame:
    """One row for each finding, as struct ``f`` in place of findings.

    The outer form with a filter behind it: an inner explode makes Spark test
    the array's size below it, which evaluates all rules a second time.
    """
    rest = [c for c in df.columns if c != "findings"]
    return df.select(*rest, F.explode_outer("findings").alias("f")).filter("f is not null")


def with_composites(df: DataFrame, composites: list[Composite]) -> DataFrame:
    """Findings after composites: added where true; their parts are removed or lose their score.

    Parts are removed only if no true composite that leaves them vetoes it.
    """
    names = F.transform("findings", lambda f: f["symbol"])
    true, parts_of = {}, {}
    for c in composites:
        tree = expr.parse(c.expression)
        parts_of[c.symbol] = sorted(set(tree.atoms()))
        true[c.symbol] = expr.compile_expression(tree, lambda a: F.array_contains(names, a).cast("int")) != 0

    def listed(policies: tuple[str, ...]) -> Column:
        out = F.array().cast("array<string>")
        for c in composites:
            if c.policy in policies:
                out = F.concat(out, F.when(true[c.symbol], F.array(*[F.lit(p) for p in parts_of[c.symbol]])).otherwise(F.array().cast("array<string>")))
        return out

    df = df.withColumns({"__gone": listed(("remove",)), "__light": listed(("remove", "remove_weight")), "__kept": listed(("leave",))})
    rest = F.filter("findings", lambda f: ~F.array_contains("__gone", f["symbol"]) | F.array_contains("__kept", f["symbol"]))
    light = F.transform(rest, lambda f: f.withField("score", F.when(F.array_contains("__light", f["symbol"]) & ~F.array_contains("__kept", f["symbol"]), 0.0).otherwise(f["score"])))
    added = [F.when(true[c.symbol], F.struct(F.lit(c.symbol).alias("symbol"), F.lit(c.group).alias("grp"), F.lit(1).alias("hits"), F.lit(float(c.weight)).alias("score"))) for c in composites]
    return df.withColumn("findings", F.concat(light, F.filter(F.array(*added), lambda f: f.isNotNull()))).drop("__gone", "__light", "__kept")


def capped(limits: Limits) -> Column:
    """Sum of the findings' scores, each group clipped to its cap in order of insertion."""
    start = F.struct(F.lit(0.0).alias("total"), F.map_from_arrays(F.array(*[F.lit(g) for g in limits.groups]), F.array(*[F.lit(0.0) for _ in limits.groups])).alias("used")) if limits.groups else None
    if start is None:
        return F.aggregate("findings", F.lit(0.0), lambda a, f: a + f["score"])
    caps = F.create_map(*[F.lit(x) for g, c in limits.groups.items() for x in (g, float(c))])

    def step(acc: Column, f: Column) -> Column:
        cap, used = caps[f["grp"]], acc["used"][f["grp"]]
        room = F.when(f["score"] >= 0, F.least(f["score"], cap - used)).otherwise(F.greatest(f["score"], -cap - used))
        got = F.when(cap.isNull(), f["score"]).otherwise(room)
        used_now = F.transform_values(acc["used"], lambda k, v: F.when(k == f["grp"], v + got).otherwise(v))
        return F.struct((acc["total"] + got).alias("total"), used_now.alias("used"))

    return F.aggregate("findings", start, step)["total"]


def action(score: Column, limits: Limits) -> Column:
    """The action with the highest threshold that the score reaches, else ``no action``."""
    out = F.lit("no action")
    for name, least in sorted(limits.actions.items(), key=lambda x: x[1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def scored(df: DataFrame, limits: Limits) -> DataFrame:
    """``df`` with score (capped, after growth), n_positive, n_negative, action and verdict."""
    df = df.withColumn("score", capped(limits))
    if limits.grow_factor > 1:
        most = max(limits.actions.values())
        factor = F.aggregate(F.filter("findings", lambda f: f["score"] > 0), F.lit(1.0), lambda a, f: a * (1 + (limits.grow_factor - 1) * f["score"] / most))
        positive = F.aggregate(F.filter("findings", lambda f: f["score"] > 0), F.lit(0.0), lambda a, f: a + f["score"])
        df = df.withColumn("score", F.col("score") + positive * (factor * F.lit(limits.grow_factor) - 1) * F.when(factor > 1, 1.0).otherwise(0.0))
    df = df.withColumns({"n_positive": F.size(F.filter("findings", lambda f: f["score"] > 0)), "n_negative": F.size(F.filter("findings", lambda f: f["score"] < 0)), "action": action(F.col("score"), limits)})
    verdict = (
        F.when((F.col("action") == "reject") & (F.col("n_positive") > 1), "spam")
        .when((F.col("action") == "no action") & ((F.col("score") < 0) | (F.col("n_negative") > 3)), "ham")
        .when(F.col("action").isin("add header", "rewrite subject"), "junk")
        .otherwise("uncertain")
    )
    return df.withColumn("verdict", verdict)
