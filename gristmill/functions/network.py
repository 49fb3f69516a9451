"""Methods on IPv4 addresses as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import ip_number

#: Networks of private, loopback and link-local addresses as first and last number.
LOCAL = [(167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3232235520, 3232301055)]


def is_valid(ip: Column) -> Column:
    return ip_number(ip).isNotNull()


def is_local(ip: Column) -> Column:
    n = ip_number(ip)
    out = F.lit(False)
    for lo, hi in LOCAL:
        out |= n.between(lo, hi)
    return F.coalesce(out, F.lit(False))


def octets(ip: Column) -> Column:
    return F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))


def inversed(ip: Column) -> Column:
    """Octets in reverse, as reverse names have them."""
    return F.array_join(F.reverse(F.split(ip, r"\.")), ".")


def mask(ip: Column, bits: int) -> Column:
    """Number of the network of ``bits`` bits that holds the address."""
    n = ip_number(ip)
    return n - F.pmod(n, F.lit(1 << (32 - bits)))


def to_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.floor(number / (1 << s)).cast("long").bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def version(ip: Column) -> Column:
    return F.when(is_valid(ip), 4).when(F.contains(ip, F.lit(":")), 6)
