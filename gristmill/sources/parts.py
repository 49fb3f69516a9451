"""What attachments are and hold: types by leading bytes, image sizes, archive members, encoded text."""

from __future__ import annotations

import io
import quopri
import tarfile
import zipfile
from collections.abc import Iterator
from email.errors import HeaderParseError
from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Leading bytes (hex) of file types.
MAGIC = {"89504E470D0A1A0A": "png", "FFD8FF": "jpg", "474946383761": "gif", "474946383961": "gif", "424D": "bmp", "25504446": "pdf", "504B0304": "zip", "1F8B": "gz", "526172211A07": "rar", "377ABCAF271C": "7z", "28B52FFD": "zst", "D0CF11E0A1B11AE1": "ole", "7B5C727466": "rtf", "4D5A": "exe", "7F454C46": "elf"}


def file_type(content: Column) -> Column:
    """The type that the leading bytes tell, ``html`` or ``text`` for what reads as such, else null."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.substring(content, 1, 512)
    out = F.when(F.lower(F.try_validate_utf8(start)).rlike(r"^\s*<(!doctype html|html|head|body)\b"), "html").when(F.is_valid_utf8(start) & ~F.hex(start).rlike("^(..)*?00"), "text")
    for magic, kind in sorted(MAGIC.items(), key=lambda m: len(m[0])):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def image_size(content: Column) -> Column:
    """Struct of width and height of a PNG, GIF or BMP image; null for others."""

    def number(start: int, size: int, little: bool) -> Column:
        digits = F.hex(F.substring(content, start + 1, size))
        ordered = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in (reversed(range(size)) if little else range(size))])
        return F.conv(ordered, 16, 10).cast("long")

    def both(at: tuple[int, int], size: int, little: bool) -> Column:
        return F.struct(number(at[0], size, little).alias("width"), number(at[1], size, little).alias("height"))

    kind = file_type(content)
    return F.when(kind == "png", both((16, 20), 4, False)).when(kind == "gif", both((6, 8), 2, True)).when(kind == "bmp", both((18, 22), 4, True))


def _members(content: bytes) -> tuple[list[dict], bool]:
    stream = io.BytesIO(content)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as z:
            found = [{"name": i.filename, "size": i.file_size} for i in z.infolist() if not i.is_dir()]
            return found, any(i.flag_bits & 1 for i in z.infolist())
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        return [{"name": m.name, "size": m.size} for m in t if m.isfile()], False


def archive_members(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id_col, encrypted, broken, members) of zip and tar archives, plain or compressed; nothing is unpacked.

    A null content has no members; one that is no archive or is damaged is broken.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, content in zip(b["id"], b["content"], strict=True):
                found, encrypted, broken = [], False, False
                if content is not None:
                    try:
                        found, encrypted = _members(bytes(content))
                    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, ValueError):
                        broken = True
                rows.append((i, encrypted, broken, found))
            yield pd.DataFrame(rows, columns=[id_col, "encrypted", "broken", "members"])

    rows = df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    return rows.mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, encrypted boolean, broken boolean, members array<struct<name:string,size:long>>")


@F.pandas_udf(StringType())
def decode_words(values: pd.Series) -> pd.Series:
    """Header text with its encoded words decoded; what cannot be decoded stays as it is."""

    def one(v: str | None) -> str | None:
        if not v or "=?" not in v:
            return v
        try:
            return str(make_header(decode_header(v)))
        except (HeaderParseError, LookupError, ValueError):
            return v

    return values.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def decode_quoted(values: pd.Series) -> pd.Series:
    """Quoted-printable text decoded as UTF-8; bytes that are none become U+FFFD."""
    return values.map(lambda v: quopri.decodestring(v.encode()).decode("utf-8", "replace"), na_action="ignore")
