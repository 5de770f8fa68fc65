"""Bounded samples of labelled rows, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents for which ``use`` holds, the first by md5 of the id.

    Only the chosen ids (at most ``bound``, 16 bytes each) are broadcast; texts are not shuffled.
    """
    labelled = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    chosen = labelled.where(use).dropDuplicates(["doc_id"]).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
