"""Longest-prefix lookup of IPv4 and IPv6 addresses.

All addresses are 128-bit numbers; IPv4 ones stand where IPv6 maps them
(``::ffff:0:0/96``). Networks are nested or apart, never across each other, so
one sweep with a stack turns them into disjoint intervals, each with the value
of its innermost network, and an address is found by binary search.
"""

from __future__ import annotations

import ipaddress
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Networks that are sent to all tasks, some 200 bytes each; beyond, the lookup is joins by shuffle.
INTERVALS_BROADCAST = 200_000
_V4 = 0xFFFF << 32


def number(address: str | None) -> int | None:
    """The 128-bit number of an address; None if it is not one."""
    try:
        a = ipaddress.ip_address((address or "").strip().strip("[]"))
    except ValueError:
        return None
    return int(a) | _V4 if a.version == 4 else int(a)


def network(text: str | None) -> tuple[int, int] | None:
    """First number and prefix length (0 to 128) of ``address`` or ``address/bits``; host bits are cut off."""
    address, slash, bits = (text or "").strip().partition("/")
    n = number(address)
    if n is None or (slash and not (bits.isascii() and bits.isdigit())):
        return None
    own = 32 if ":" not in address else 128
    length = int(bits) if slash else own
    if length > own:
        return None
    length += 128 - own
    return n >> (128 - length) << (128 - length), length


def intervals(entries: list[tuple[int, int, str]]) -> tuple[list[int], list[str | None]]:
    """Where the value changes, and the value from there on, of (first, length, value); by a sweep over the sorted networks."""
    starts, values = [0], [None]
    open_: list[tuple[int, str]] = []

    def from_here(at: int, value: str | None) -> None:
        if starts[-1] == at:
            values[-1] = value
        elif values[-1] != value:
            starts.append(at)
            values.append(value)

    for first, length, value in sorted(entries, key=lambda e: (e[0], e[1])):
        while open_ and open_[-1][0] <= first:
            end = open_.pop()[0]
            from_here(end, open_[-1][1] if open_ else None)
        open_.append((first + (1 << (128 - length)), value))
        from_here(first, value)
    while open_:
        end = open_.pop()[0]
        from_here(end, open_[-1][1] if open_ else None)
    return starts, values


def _read(entries: DataFrame) -> DataFrame:
    """(prefix, length, value) of the rows whose key can be read; prefix as 32 hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nets = [network(k) for k in b.column(0).to_pylist()]
            keep = [i for i, n in enumerate(nets) if n]
            yield pa.RecordBatch.from_arrays([pa.array([f"{nets[i][0]:032x}" for i in keep], pa.string()), pa.array([nets[i][1] for i in keep], pa.int32()), b.column(1).take(pa.array(keep, pa.int64()))], ["prefix", "length", "value"])

    return entries.select("key", F.col("value").cast("string").alias("value")).mapInArrow(run, "prefix string, length int, value string")


def parsed(entries: DataFrame) -> DataFrame:
    """The valid networks in column key, one row each; of repeated ones the greater value."""
    return _read(entries).groupBy("prefix", "length").agg(F.max("value").alias("value"))


def lookup(rows: DataFrame, address_col: str, entries: DataFrame, value_col: str = "value", most: int = INTERVALS_BROADCAST) -> DataFrame:
    """``rows`` with the value of the innermost network around each address; null where there is none.

    ``entries`` has key (``address`` or ``address/bits``) and value. Addresses and
    networks that cannot be read, null ones included, match nothing. Up to
    ``most`` networks every task gets the intervals; beyond, every distinct
    address meets the networks of each length that occurs by an equi-join.
    A column that is already called ``value_col`` is replaced; every row stays.
    """
    rows = rows.drop(value_col)
    nets = parsed(entries)
    if nets.limit(most + 1).count() <= most:
        shared = rows.sparkSession.sparkContext.broadcast(intervals([(int(r["prefix"], 16), r["length"], r["value"]) for r in nets.collect()]))
        at, names = rows.columns.index(address_col), [*rows.columns, value_col]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, values = shared.value
            for b in batches:
                distinct = b.column(at).dictionary_encode()
                found = [None if (n := number(a)) is None else values[bisect_right(starts, n) - 1] for a in distinct.dictionary.to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()).take(distinct.indices)], names)

        return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(value_col, StringType()))
    lengths = F.broadcast(nets.select("length").distinct())  # 129 rows at most
    address = F.col(address_col)
    asked = _read(rows.select(address.alias("key"), address.alias("value")).filter(address.isNotNull() & ~address.contains("/")).distinct())
    bits = F.concat(*[F.lpad(F.conv(F.substring("prefix", 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)])
    nets = nets.withColumn("bits", F.substring(bits, F.lit(1), F.col("length"))).select("bits", "length", F.col("value").alias("__value"))
    met = asked.select("value", bits.alias("all_bits")).crossJoin(lengths).withColumn("bits", F.substring("all_bits", F.lit(1), F.col("length"))).join(nets, ["bits", "length"])
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("length")))).filter("n = 1")
    return rows.join(best.select(F.col("value").alias(address_col), F.col("__value").alias(value_col)), address_col, "left").select(*rows.columns, value_col)
