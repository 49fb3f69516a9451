"""Helpers that the corpus operators share: shared folder, tables, fixed fold rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sampled, labelled row is held out when crc32(doc_id as text) mod 4 equals this.
HELD_OUT_REMAINDER = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only on a local master, where all are one process, a temporary folder may take its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int = 200_000) -> DataFrame:
    """``rows`` joined with one row a key of ``small``, by broadcast if that has at most ``most`` rows.

    Beyond that it is a join by shuffle, whose skewed partitions Spark splits where
    no aggregation follows. ``small`` should be settled: it is counted first.
    """
    return rows.join(F.broadcast(small) if small.count() <= most else small, keys, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str) -> Column:
    """True for rows that no model may learn from; a null id is held out."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(fold == HELD_OUT_REMAINDER, F.lit(True))


#: Java regular expression of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
