"""Labelled rows for the classifiers: folds and bounded, deterministic training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id, as text, divisible by the number of folds. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled training documents, the first by a hash of the id.

    The ids are at most ``limit`` rows, so they are broadcast: the texts are filtered where they are read. Labels that
    disagree about one document count as 1; null labels do not count.
    """
    ids = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    few = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
