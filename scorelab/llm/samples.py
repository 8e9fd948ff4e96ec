"""Bounded samples of labelled documents and folds by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, size: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``text``, ``y``) of at most ``size`` labelled documents outside the held-out fold, chosen by a
    hash of the id. An id with several labels has the largest. The chosen ids (at most
    ``size`` rows of two numbers) are broadcast to one scan of the documents."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(fold(id_col, folds) != held_out)
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(size))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(chosen), "_id").select("text", "y")
