"""Deduplication by key: which row stays, and what each dropped row was dropped for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import product_text_key
from .ranks import bag_join, numbered


def first_by(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. A partial aggregate, not a sort of the key's rows."""
    names = rows.columns
    place = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min_by(F.struct(*names), place).alias("_row")).select("_row.*")


def manifest(rows: DataFrame, key: str, item: str, order: list[Column | str]) -> DataFrame:
    """Dropped rows of each key with the row that was kept for them."""
    place = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)), F.col(item).alias("item"))
    kept = rows.groupBy(key).agg(F.min_by(item, place).alias("kept"))
    return rows.join(kept, key).where(F.col(item) != F.col("kept")).select(F.col(item), "kept", key)


def split_priority(split: Column) -> Column:
    """Test before validation before train: what is held out is kept."""
    return F.when(split == "test", 0).when(split == "validation", 1).otherwise(2)


def import_outcome(rows: DataFrame, saved: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """rows: product_id, ordinal, text, error -> adds dedup_key and outcome (accepted, rejected, duplicate).

    The first of a key within the batch is accepted, unless the saved reviews (product_id, dedup_key) have it.
    """
    keyed = rows.withColumn("dedup_key", F.when(F.col("error").isNull(), product_text_key(F.col("text"), exact)))
    first = keyed.where("dedup_key is not null").groupBy("product_id", "dedup_key").agg(F.min("ordinal").alias("first"))
    out = keyed.join(first, ["product_id", "dedup_key"], "left")
    known = F.lit(False)
    if saved is not None:
        out = out.join(saved.select("product_id", "dedup_key").distinct().withColumn("known", F.lit(True)), ["product_id", "dedup_key"], "left")
        known = F.coalesce("known", F.lit(False))
    outcome = F.when(F.col("error").isNotNull(), "rejected").when(known | (F.col("ordinal") > F.col("first")), "duplicate").otherwise("accepted")
    return out.withColumn("outcome", outcome).drop("first", "known")


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "rejected", "duplicate")))


def ordered_unique(ids: Column) -> Column:
    return F.array_distinct(ids)


def nth_of_text(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """k-th row of each text, which is told apart by its SHA-256; a text that many rows share is no group in one task."""
    return numbered(rows.withColumn("_text", F.sha2(text, 256)), order, ["_text"]).drop("_text")


def reused(requests: DataFrame, previews: DataFrame, text: str = "text", asked: Sequence[str] = ("at",), made: Sequence[str] = ("created_at",)) -> DataFrame:
    """Each request with the preview that it reuses, if any: the k-th of a text takes the k-th preview of that text.

    previews: only those that may be reused (unexpired, of the same product and version). Their columns besides the text follow.
    """
    key = lambda rows: rows.withColumn("_text", F.sha2(text, 256))
    return bag_join(key(requests), key(previews).drop(text), ["_text"], asked, made).drop("_text")
