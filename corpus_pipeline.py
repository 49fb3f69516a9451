"""Corpus preparation: a fixed chain of five stages over ``documents``.

Each stage takes all that its predecessor kept. All but the last return the
columns of documents; the last writes the token files and returns their index.
All take texts of any length whole, and give an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, jaccard, langid, mixing, tokenfile
from gristmill.llm.common import shared_dir, table

#: Ids that a filter drops are broadcast up to this many (16 bytes each), else joined by shuffle.
DROPPED_BROADCAST = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of the given doc_ids."""
    few = ids.count() <= DROPPED_BROADCAST
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised; null texts and those without any letter go.

    Repeated rows and null ids stay; columns named like the prediction's do no harm.
    """
    known = langid.predict(docs, langid.train(docs))
    return known.filter(F.col("lang_pred") != langid.UNDETERMINED).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat an id the least row stays. Null ids and null or wordless
    texts link with nothing and stay.
    """
    classes = jaccard.settle(jaccard.jaccard_classes(docs))
    kept = _without(docs, classes.filter("id != component_id").select(F.col("id").alias("doc_id")).distinct())
    repeated = jaccard.settle(classes.groupBy("id").count().filter("count > 1 and id is not null").select(F.col("id").alias("doc_id")))
    if repeated.isEmpty():
        return kept
    return _without(kept, repeated).unionByName(
        kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    )


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null ids and null texts hold none."""
    found = jaccard.settle(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))
    return _without(docs, found.select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target proportions: each document as often as the mix takes it.

    Null sources are one source; texts without words have no size and are never taken.
    """
    return mixing.mixture(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and their index read back from the files; null ids come first."""
    import public_tokenizers  # here, so that the other queries do not need the package

    uri, manifest = tokenfile.write(docs, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(uri, manifest)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: The language model, the link components and the tokenizer have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
