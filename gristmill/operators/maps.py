"""Lookup maps of exact, regexp, glob and network-prefix kinds, as joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import ip_number

#: A map up to this many rows is broadcast; larger ones are joined by shuffle where the kind allows.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if counting proves that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_exact(df: DataFrame, key: Column, entries: DataFrame) -> DataFrame:
    """Inner join on the lower-cased key; ``entries`` has key and value."""
    return df.withColumn("__key", F.lower(key)).join(small(entries.select(F.lower("key").alias("__key"), "value")), "__key").drop("__key")


def glob_pattern(glob: str) -> str:
    """The anchored regular expression of a glob: ``*`` any text, ``?`` one character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def match_patterns(key: Column, patterns: list[tuple[str, str]], every: bool = False) -> Column:
    """Value of the first matching pattern, or the array of all matching ones' values.

    The list is a driver-side constant, as a rule set is, and compiles into the plan.
    """
    if every:
        return F.filter(F.array(*[F.when(key.rlike(p), F.lit(v)) for p, v in patterns]), lambda v: v.isNotNull())
    return F.coalesce(*[F.when(key.rlike(p), F.lit(v)) for p, v in patterns])


def prefixes(entries: DataFrame) -> DataFrame:
    """(net, bits, value) of IPv4 networks ``a.b.c.d/bits`` in column key."""
    bits = F.coalesce(F.try_element_at(F.split("key", "/"), F.lit(2)).try_cast("int"), F.lit(32))
    address = ip_number(F.element_at(F.split("key", "/"), 1))
    rows = entries.select(address.alias("address"), bits.alias("bits"), "value").filter("address is not null and bits between 0 and 32")
    return rows.select((F.col("address") - F.pmod("address", F.pow(F.lit(2), 32 - F.col("bits")).cast("long"))).alias("net"), "bits", "value")


def join_longest_prefix(df: DataFrame, ip: str, entries: DataFrame) -> DataFrame:
    """Every row with the value of the longest network that holds its address, or null.

    An address has one network of each length that occurs in the map, at most 33,
    so these are equi-joins on the network's number, longest first, and no range
    join. Networks that occur twice give the greater value.
    """
    nets = prefixes(entries).groupBy("bits", "net").agg(F.max("value").alias("value"))
    lengths = [r["bits"] for r in nets.select("bits").distinct().orderBy(F.col("bits").desc()).limit(33).collect()]
    columns = df.columns
    number = ip_number(F.col(ip))
    for b in lengths:
        one = nets.filter(F.col("bits") == b).select(F.col("net").alias("__net"), F.col("value").alias(f"__{b}"))
        df = df.withColumn("__net", number - F.pmod(number, F.lit(1 << (32 - b)))).join(small(one), "__net", "left").drop("__net")
    return df.select(*columns, (F.coalesce(*[F.col(f"__{b}") for b in lengths], F.lit(None).cast("string"))).alias("value"))


def parse_value(value: Column) -> dict[str, Column]:
    """Grammar of map values: ``score``, ``SYM``, ``SYM:score`` or ``SYM:score:opt1,opt2``."""
    parts = F.split(value, ":")
    number = F.element_at(parts, 1).try_cast("double")
    return {
        "symbol": F.when(number.isNull(), F.element_at(parts, 1)),
        "score": F.coalesce(F.when(number.isNotNull(), number).otherwise(F.try_element_at(parts, F.lit(2)).try_cast("double")), F.lit(1.0)),
        "options": F.coalesce(F.split(F.try_element_at(parts, F.lit(3)), ","), F.array().cast("array<string>")),
    }


def first_per_key(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key; Spark limits each key's rows before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
