"""Queries over the quality, scripts, bytes and distances of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import quality
from gristmill.plans.registry import documents, query, read


@query(r"""WITH c AS (SELECT doc_id, length(text) AS total, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^ \t\r\n]', '', 'g')) AS spaces,
    length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS printable, len(regexp_extract_all(text, '\p{L}{2,}')) AS words,
    length(array_to_string(regexp_extract_all(text, '\p{L}{2,}'), '')) AS word_chars FROM documents),
  r AS (SELECT *, total - spaces AS black, word_chars / CASE WHEN words = 0 THEN NULL ELSE words END AS mean, spaces / CASE WHEN total = 0 THEN NULL ELSE total END AS share FROM c)
  SELECT doc_id, letters, words, word_chars, round(CASE WHEN total IS NULL THEN NULL WHEN total < 10 THEN 1.0 ELSE least(printable / total / 0.95, 1) * 0.25
    + CASE WHEN black > 0 THEN least(letters / black / 0.6, 1) * 0.2 + least(word_chars / black / 0.7, 1) * 0.25 ELSE 0 END
    + 0.15 * CASE WHEN mean >= 3 AND mean <= 10 THEN 1.0 WHEN mean >= 2 AND mean < 3 THEN 0.7 WHEN mean > 10 AND mean <= 15 THEN 0.5 ELSE 0.2 END
    + 0.15 * CASE WHEN share >= 0.08 AND share <= 0.25 THEN 1.0 WHEN share > 0.25 AND share <= 0.4 THEN 0.6 WHEN share > 0 AND share < 0.08 THEN 0.5 ELSE 0.2 END END, 6) AS confidence FROM r""")
def text_confidence(spark, sf_dir):
    rows = quality.with_quality(documents(spark, sf_dir).select("doc_id", "text"), "text")
    return rows.select("doc_id", "letters", "words", "word_chars", F.round(quality.confidence(), 6).alias("confidence"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\p{Greek}]', '', 'g')) AS greek,
  length(regexp_replace(text, '[^\p{Han}]', '', 'g')) AS han, length(regexp_replace(text, '[^\p{Arabic}]', '', 'g')) AS arabic,
  len(regexp_extract_all(text, '\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}')) AS mixed, len(regexp_extract_all(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]')) AS invisible FROM documents""")
def script_counts(spark, sf_dir):
    made = quality.scripts("text") | {"mixed": quality.mixed_scripts("text"), "invisible": quality.invisible("text")}
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in made.items()])


@query()
def turn_distances(spark, sf_dir):
    """Word edits from each turn to the one before it. Turns meet by number, so no conversation is gathered."""
    said = read(spark, sf_dir, "conversations").dropna(subset=["text"]).groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text"))["text"].alias("b"))
    rows = said.join(said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("b").alias("a")), ["conv_id", "turn"])
    rows = rows.withColumns({"a": quality.split_words("a"), "b": quality.split_words("b")})
    total = (F.size("a") + F.size("b")).cast("long")
    rows = rows.select("conv_id", "turn", quality.word_distance("a", "b").cast("long").alias("distance"), total.alias("words"))
    return rows.withColumn("share", F.round(F.try_divide("distance", "words"), 6))


@query()
def byte_statistics(spark, sf_dir):
    return quality.byte_statistics(documents(spark, sf_dir), "doc_id", "text")


@query(r"""SELECT doc_id, md5(to_base64(encode(text))) AS base64_md5, md5(lower(to_hex(encode(text)))) AS hex_md5, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS newlines_md5,
  md5(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ')) AS oneline_md5, sha256(text) AS sha256 FROM documents""")
def text_encodings(spark, sf_dir):
    raw = F.col("text").cast("binary")
    made = {"base64": F.regexp_replace(F.base64(raw), "[\r\n]", ""), "hex": F.lower(F.hex(raw)), "newlines": quality.normal_newlines("text"), "oneline": quality.one_line("text")}
    return documents(spark, sf_dir).select("doc_id", *[F.md5(c.cast("binary")).alias(f"{n}_md5") for n, c in made.items()], F.sha2(raw, 256).alias("sha256"))
