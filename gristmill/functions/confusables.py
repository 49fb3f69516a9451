"""Look-alike text: skeletons that are equal for words that look alike, normal forms, and names in Punycode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from gristmill.operators.maps import small

#: Characters and what they look like, by script.
LOOKS_LIKE = {
    "аеорсухіѕјһԁԛԝьгп": "aeopcyxisjhdqwbrn",
    "АВЕКМНОРСТУХІЅЈ": "abekmhopctyxisj",
    "αινορυχκτω": "aivopuxktw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "abezhikmnoptyx",
    "ıɑɡɩʋƅᴏ": "iagivbo",
    "օսոցհյ": "ouugh" + "j",
    "０１２３４５６７８９": "0123456789",
}
#: Letters, digits and pairs that look alike in plain text.
PLAIN = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("0", "o"), ("1", "l"), ("|", "l"), ("5", "s")]
_TABLE = {ord(a): b for shown, like in LOOKS_LIKE.items() for a, b in zip(shown, like, strict=True)}
#: Marks, joiners and other characters without a look of their own.
_INVISIBLE = ("Mn", "Me", "Cf")


def skeleton_of(text: str | None) -> str | None:
    """The skeleton of one text: compatibility forms taken apart, what cannot be seen left out, look-alikes replaced."""
    if text is None:
        return None
    apart = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in _INVISIBLE)
    plain = apart.translate(_TABLE).lower()
    for shown, like in PLAIN:
        plain = plain.replace(shown, like)
    return plain


def transliterated(text: str | None) -> str | None:
    """Plain ASCII: accents dropped, look-alikes by their Latin letters, anything else left out."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text).translate(_TABLE) if ord(c) < 128)


def decoded_host(host: str | None) -> str | None:
    """A host with its ``xn--`` labels decoded; a label that cannot be decoded stays."""
    if host is None or "xn--" not in host.lower():
        return host

    def label(x: str) -> str:
        try:
            return x[4:].encode("ascii").decode("punycode") if x.lower().startswith("xn--") else x
        except (UnicodeError, ValueError):
            return x

    return ".".join(map(label, host.split(".")))


@F.pandas_udf(t.StringType())
def skeleton(text: pd.Series) -> pd.Series:
    return text.map(skeleton_of, na_action="ignore")


@F.pandas_udf(t.StringType())
def transliterate(text: pd.Series) -> pd.Series:
    return text.map(transliterated, na_action="ignore")


@F.pandas_udf(t.StringType())
def host_skeleton(host: pd.Series) -> pd.Series:
    return host.map(lambda h: skeleton_of(decoded_host(h)), na_action="ignore")


def normal_form(text: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD of a text; plain ASCII is its own."""

    @F.pandas_udf(t.StringType())
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return normalize(text)


def scripts(text: str | None) -> set[str]:
    """The scripts of a text's letters, by the first word of their names."""
    return {unicodedata.name(c, "?").split()[0] for c in text or "" if c.isalpha()}


@F.pandas_udf(t.BooleanType())
def mixes_scripts(text: pd.Series) -> pd.Series:
    """Letters of more than one script in one text."""
    return text.map(lambda v: len(scripts(v)) > 1, na_action="ignore").fillna(False).astype(bool)


def lookalikes(rows: DataFrame, host_col: str, known: DataFrame, known_col: str = "host") -> DataFrame:
    """``rows`` whose host looks like a known one and is not it, with that one in column ``looks_like``.

    Hosts are compared without case, with Punycode decoded. Every distinct host is
    turned into a skeleton once, and skeletons meet by an equi-join (by broadcast if
    counting shows that few are known). Null hosts look like nothing; a host
    that is itself known is no look-alike; one that looks like several gives a row each.
    """
    trusted = known.select(F.lower(known_col).alias("looks_like")).filter("looks_like <> ''").distinct()
    trusted = trusted.withColumn("skeleton", host_skeleton("looks_like"))
    hosts = rows.select(F.lower(host_col).alias("__host")).filter("__host <> ''").distinct()
    hosts = hosts.join(small(trusted.select(F.col("looks_like").alias("__host"))), "__host", "left_anti").withColumn("skeleton", host_skeleton("__host"))
    met = hosts.join(small(trusted), "skeleton").drop("skeleton")
    return rows.drop("looks_like").withColumn("__host", F.lower(host_col)).join(met, "__host").drop("__host")
