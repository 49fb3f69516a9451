"""Column functions over a message's recipients, an array of addresses in the order of the headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recipients below which nothing is said, and characters that similar addresses begin with.
LEAST, SAME_START = 7, 3


def in_order(recipients: Column) -> Column:
    """At least seven recipients, each greater than the one before it, whatever the case."""
    folded = F.transform(recipients, F.lower)
    steps = F.zip_with(F.slice(folded, 1, F.size(folded) - 1), F.slice(folded, 2, F.size(folded) - 1), lambda a, b: (b > a) | (a == ""))
    return F.coalesce(F.when(F.size(recipients) >= LEAST, F.forall(steps, lambda x: x)), F.lit(False))


def likeness(recipients: Column) -> Column:
    """Half the number of neighbours, by domain, that are equally long and begin alike; 0 below seven recipients.

    Addresses of up to three characters do not count. Neighbours are in order of
    the domain's length, the domain, and their order in the headers.
    """
    long = F.filter(recipients, lambda a: F.length(a) > SAME_START)
    placed = F.transform(long, lambda a, i: F.struct(F.length(F.substring_index(a, "@", -1)).alias("n"), F.substring_index(a, "@", -1).alias("domain"), i.alias("i"), F.lower(a).alias("a")))
    names = F.transform(F.sort_array(placed), lambda x: x["a"])
    alike = F.zip_with(F.slice(names, 1, F.size(names) - 1), F.slice(names, 2, F.size(names) - 1), lambda a, b: (F.length(a) == F.length(b)) & (F.substring(a, 1, SAME_START) == F.substring(b, 1, SAME_START)))
    return F.coalesce(F.when((F.size(recipients) >= LEAST) & (F.size(names) > 1), F.size(F.filter(alike, lambda x: x)) / 2), F.lit(0.0))


def alike(recipients: Column, threshold: float) -> Column:
    """Whether at least seven recipients are like their neighbours to this degree."""
    return F.coalesce(F.size(recipients) >= LEAST, F.lit(False)) & (likeness(recipients) >= threshold)
