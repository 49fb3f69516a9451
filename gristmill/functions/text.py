"""Column functions over text: counters, words, digests, statistics. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of ASCII letters and digits, so that every SQL dialect agrees on them.
WORD = "[A-Za-z0-9]+"


def hits(text: Column | str, pattern: str) -> Column:
    """How often a regular expression matches; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def counters(text: Column | str) -> dict[str, Column]:
    """Lines, empty lines, spaces, double spaces, capitals, digits and non-ASCII characters."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    return {
        "n_chars": F.length(text),
        "n_bytes": F.octet_length(text),
        "n_lines": left("\n") + 1,
        "n_empty_lines": hits(text, "\n\n"),
        "n_spaces": left(" "),
        "n_double_spaces": hits(text, "  "),
        "n_capitals": left("[A-Z]"),
        "n_digits": left("[0-9]"),
        "n_non_ascii": left(r"[^\x00-\x7F]"),
        "n_words": hits(text, WORD),
    }


def words(text: Column | str) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def hash60(value: Column) -> Column:
    """A non-negative 60-bit integer from MD5: the same in every SQL dialect, and never overflowing."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def word_pairs(text: Column | str, window: int = 2) -> Column:
    """Sparse bigrams of adjacent words up to ``window`` apart, as texts ``w0 \\x1f wi \\x1f i``."""
    w = words(text)
    rows = []
    for d in range(1, window):
        pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - d, F.lit(0))).alias("a"), F.slice(w, d + 1, F.greatest(F.size(w) - d, F.lit(0))).alias("b"))
        rows.append(_pair_texts(pairs, d))
    return rows[0] if len(rows) == 1 else F.concat(*rows)


def _pair_texts(pairs: Column, distance: int) -> Column:
    return F.transform(pairs, lambda p: F.concat_ws("\x1f", p["a"], p["b"], F.lit(str(distance))))


def word_windows(text: Column | str, width: int = 3) -> Column:
    """Distinct windows of ``width`` words joined by spaces; none if the text has fewer."""
    w = words(text)
    n = F.greatest(F.size(w) - (width - 1), F.lit(0))
    # Zipped slices, so that the words are found once and not once for each window.
    shifted = F.arrays_zip(*[F.slice(w, i + 1, n).alias(f"w{i}") for i in range(width)])
    return F.array_distinct(F.transform(shifted, lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(width)])))


def parse_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def registered_domain(host: Column, suffixes: Column | None = None) -> Column:
    """The last two labels of a host; one more where the last two are a known public suffix."""
    two = F.substring_index(host, ".", -2)
    return two if suffixes is None else F.when(F.array_contains(suffixes, two), F.substring_index(host, ".", -3)).otherwise(two)


def ip_number(ip: Column | str) -> Column:
    """IPv4 address as an integer; null if it is none."""
    p = F.split(ip, r"\.")
    octets = [F.try_element_at(p, F.lit(i)).try_cast("long") for i in range(1, 5)]
    good = (F.size(p) == 4) & octets[0].between(0, 255) & octets[1].between(0, 255) & octets[2].between(0, 255) & octets[3].between(0, 255)
    return F.when(good, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def inverse_chi_square(log_sum: Column, terms: Column) -> Column:
    """min(1, sum over i < terms of e^v (-v)^i / i!) for v <= 0, the Fisher combination's tail."""
    start = F.struct(F.exp(log_sum).alias("sum"), F.exp(log_sum).alias("term"))
    steps = F.sequence(F.lit(1), F.greatest(terms.cast("int") - 1, F.lit(1)))
    total = F.aggregate(steps, start, lambda a, i: F.when(i < terms, F.struct((a["sum"] + a["term"] * -log_sum / i).alias("sum"), (a["term"] * -log_sum / i).alias("term"))).otherwise(a))
    return F.when(terms <= 0, 1.0).otherwise(F.least(F.lit(1.0), total["sum"]))
