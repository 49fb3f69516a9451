"""Rules that look values up: map rules, listings with exclusions, aliases, settings, map statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.maps import parse_value, small


@dataclass(frozen=True)
class Setting:
    """What messages for which ``when`` holds get: other scores of symbols, symbols switched off."""

    name: str
    priority: int
    when: Column
    scores: dict[str, float] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()


def map_rule(df: DataFrame, id_col: str, keys: Column, entries: DataFrame, symbol: str, weight: float = 1.0) -> DataFrame:
    """(id_col, symbol, score, key): one row for each distinct key of each row that is in the map.

    ``keys`` is an array; ``entries`` has key and value, whose grammar may name
    another symbol and multiply the weight. Null keys meet nothing.
    """
    value = parse_value(F.coalesce("value", F.lit("1")))
    rows = df.select(id_col, F.explode(F.array_distinct(F.transform(keys, lambda k: F.lower(k)))).alias("key"))
    met = rows.join(small(entries.select(F.lower("key").alias("key"), "value")), "key")
    return met.select(id_col, F.coalesce(value["symbol"], F.lit(symbol)).alias("symbol"), (value["score"] * weight).alias("score"), "key")


def listed(df: DataFrame, id_col: str, keys: Column, listing: DataFrame, codes: dict[int, str], excluded: DataFrame | None = None) -> DataFrame:
    """(id_col, symbol, n): the symbols of the return bits that the row's keys have in a listing.

    ``listing`` has key and bits; keys in ``excluded`` (key) never hit. Every key
    is looked up once in all: distinct keys are joined, and their rows afterwards.
    """
    rows = df.select(id_col, F.explode(F.array_distinct(keys)).alias("key"))
    if excluded is not None:
        rows = rows.join(small(excluded.select("key").distinct()), "key", "left_anti")
    symbols = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(bit) != 0, F.lit(s)) for bit, s in codes.items()]), lambda s: s.isNotNull())
    met = rows.join(small(listing), "key").select(id_col, F.explode(symbols).alias("symbol"))
    return met.groupBy(id_col, "symbol").agg(F.count("*").alias("n"))


def resolve_aliases(df: DataFrame, col: str, aliases: DataFrame, depth: int = 8) -> DataFrame:
    """``df`` with ``resolved``: the end of each value's alias chain, after at most ``depth`` steps.

    ``aliases`` has name and target, one target a name. Chains are doubled, so
    that log2(depth) joins of the alias table with itself do for all rows; a
    cycle ends where the steps end.
    """
    hops = aliases.select("name", "target")
    steps = 1
    while steps < depth:
        further = hops.select(F.col("name").alias("target"), F.col("target").alias("__next"))
        hops = hops.join(further, "target", "left").select("name", F.coalesce("__next", "target").alias("target"))
        steps *= 2
    return df.join(hops.withColumnRenamed("name", col).withColumnRenamed("target", "__end"), col, "left").withColumn("resolved", F.coalesce("__end", col)).drop("__end")


def apply_settings(df: DataFrame, settings: list[Setting]) -> DataFrame:
    """``df`` with setting (the name of the matching one of highest priority, or null) and findings changed by it."""
    chosen = F.lit(None).cast("string")
    for s in sorted(settings, key=lambda s: s.priority):
        chosen = F.when(s.when, s.name).otherwise(chosen)
    df = df.withColumn("setting", chosen)
    for s in settings:
        mine = F.col("setting") == s.name

        def changed(f: Column, s: Setting = s) -> Column:
            score = f["score"]
            for symbol, value in s.scores.items():
                score = F.when(f["symbol"] == symbol, F.lit(float(value)) * f["hits"]).otherwise(score)
            return f.withField("score", score)

        kept = F.filter("findings", lambda f: ~f["symbol"].isin(*s.disabled)) if s.disabled else F.col("findings")
        df = df.withColumn("findings", F.when(mine, F.transform(kept, lambda f: changed(f))).otherwise(F.col("findings")))
    return df


def map_statistics(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, hits): how often every entry of a map is hit by rows of ``keys`` (key), unmatched entries with 0."""
    counts = keys.groupBy("key").agg(F.count("*").alias("hits"))
    return entries.select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("hits", F.lit(0)).alias("hits"))
