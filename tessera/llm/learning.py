"""Held-out rows and bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def bounded(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows of (doc_id, ...), the lowest by a hash of the id; equal for any partitioning."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def sampled_texts(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of a bounded sample of ids; the sample is broadcast, so the corpus is read once and not shuffled."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")
