"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, cap: int) -> DataFrame:
    """(id, label, text) of at most cap labelled rows for which learn holds.

    Rows come in the order of a hash of their id, so the sample does not
    depend on partitions.  cap bounds what is broadcast to the documents:
    ids and labels only.  Null ids, null labels and labels other than 0 and 1
    take no part; of several texts of one id the least is taken.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(learn)
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(cap)
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
