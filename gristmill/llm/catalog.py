"""Queries of the corpus operators, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import alignment, bytepair, decontaminate, divergence, langid, mixing, orderhash, repeats, secrets, tokenfile, toxicity, urlfilter
from gristmill.llm.common import held_out, settle, shared_dir, table
from gristmill.llm.jaccard import jaccard_classes
from gristmill.llm.oracle import ORACLE  # noqa: F401  read by the entry point


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_classes(table(spark, sf_dir, "documents"), width=5, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    every = docs.select("doc_id").join(found, "doc_id", "left")
    return every.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of a history: the documents of even ids, then all; the second skips what the ledger has of the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    secrets.scan_new(docs.filter("doc_id % 2 = 0"), None, secrets.RULES + secrets.MORE_RULES).write.parquet(ledger)
    skipped = settle(secrets.read_ledger(spark, ledger).groupBy("blob").agg(F.count("*").alias("n_skipped")))
    found = secrets.scan(docs, ledger).join(skipped, "blob", "left").withColumn("n_skipped", F.coalesce("n_skipped", F.lit(0)))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["rank"] < len(secrets.RULES))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "n_skipped")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.edited_neighbours(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("words"))
    return mixing.mix(docs, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri, manifest = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(uri, manifest)


#: The query's own rules, as text: host, path and verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, spark.createDataFrame(URL_RULES, urlfilter.RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bytepair.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    back = bytepair.decode(coded, path, pattern)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents, _ = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return documents


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), least_docs=3, ranks=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_token_ids": op9_token_ids,
    "op10_url_filter": op10_url_filter,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_source_divergence": op13_source_divergence,
}
