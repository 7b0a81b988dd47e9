"""The bounded labelled sample that the classifiers fit on, and the fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. Null ids are in no fold."""
    return F.crc32(id_.cast("string").cast("binary")) % 5


def held_out(id_: Column) -> Column:
    return F.coalesce(fold(id_) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside fold 0.

    Which rows: those whose ids hash lowest, so the sample doesn't depend on order or
    partitions. Rows without a label are left out; a repeated label counts once, the
    largest. The sampled ids are at most ``rows``, so broadcasting them is bounded.
    """
    known = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label).cast("int").alias("y")).where("l_id is not null and y is not null")
    known = known.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "y")
