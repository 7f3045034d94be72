"""Deterministic sampling and splitting: order by a hash, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a product a laptop, and what makes it an accessory.
LAPTOP = r"(?i)\b(laptops?|notebook computers?|chromebooks?|macbooks?)\b"
ACCESSORY = r"(?i)\b(accessor(?:y|ies)|cases?|sleeves?|bags?|backpacks?|chargers?|adapters?|batteries|stands?|skins?|covers?|screen protectors?|replacement parts?|docking stations?|cooling pads?)\b"
ACCESSORY_TITLE = r"(?i)\b(case|sleeve|bag|backpack|charger|adapter|battery|stand|skin|cover|screen protector|replacement|dock|cooling pad)\b"


def is_laptop(title: Column, categories: Column) -> Column:
    wanted = F.exists(categories, lambda c: c.rlike(LAPTOP))
    accessory = F.coalesce(F.try_element_at(categories, F.lit(-1)).rlike(ACCESSORY), F.lit(False)) | title.rlike(ACCESSORY_TITLE)
    return F.coalesce((F.size(categories) > 0) & (F.trim(title) != "") & wanted & ~accessory, F.lit(False))


def brand(own: Column, details: Column) -> Column:
    """The brand, else the one in the details, which may be JSON text; null where there is none."""
    parsed = F.try_parse_json(details)
    named = F.coalesce(*(F.try_variant_get(parsed, f"$.{k}", "string") for k in ("Brand", "brand")))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled(own), filled(named))


def rank_key(key: Column, seed: int | str = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_pool(rows: DataFrame, key: str, most: int = 250, seed: int | str = 42) -> DataFrame:
    """The `most` keys of lowest hash (ties by key): a bounded top-k, whatever the number of keys."""
    return rows.select(key).distinct().withColumn("hash", rank_key(F.col(key), seed)).orderBy("hash", key).limit(most)


def first_per_key(rows: DataFrame, key: str, order: list[str], cap: int = 100) -> DataFrame:
    """The first `cap` rows of each key in source order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= cap)


def select_products(counts: DataFrame, key: str, most: int, least: int = 3, seed: int | str = 42) -> DataFrame:
    """Keys with enough reviews first, each part in hash order."""
    rows = counts.withColumn("hash", rank_key(F.col(key), seed)).withColumn("short", (F.col("reviews") < least).cast("int"))
    return rows.orderBy("short", "hash", key).limit(most)


def review_id(own: Column, product: Column, time: Column, text: Column) -> Column:
    """The source's id, else the hash of product, time and text joined by zero bytes."""
    return F.coalesce(F.when(F.trim(own) != "", own), F.sha2(F.concat(product, F.lit("\0"), time.cast("string"), F.lit("\0"), text), 256))


def rejection(row_ok: Column, in_pool: Column, text: Column, time: Column, rating: Column, duplicate: Column, over_cap: Column) -> Column:
    """The first test that a review fails, else null."""
    return (
        F.when(~row_ok, "malformed")
        .when(~in_pool, "outside_pool")
        .when(text.isNull() | (F.trim(text) == ""), "missing_text")
        .when(time.isNull(), "missing_timestamp")
        .when(~F.coalesce(rating.between(1, 5), F.lit(False)), "invalid_rating")
        .when(duplicate, "duplicate")
        .when(over_cap, "over_cap")
    )


def helpful_votes(x: Column) -> Column:
    """Invalid counts are 0."""
    n = x.try_cast("long")
    return F.when(n >= 0, n).otherwise(0)


def validation_bucket(key: Column, buckets: int = 10) -> Column:
    """Bucket of a key from the first 32 bits of its hash; bucket 0 is for validation."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def with_validation(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Moves a tenth of train to validation if there is no validation row; without any in that tenth, the first row by key."""
    state = rows.agg(
        F.coalesce(F.bool_or(F.col(split) == "validation"), F.lit(False)).alias("_has"),
        F.coalesce(F.bool_or((F.col(split) == "train") & (validation_bucket(F.col(key)) == 0)), F.lit(False)).alias("_some"),
        F.min(F.when(F.col(split) == "train", F.col(key))).alias("_first"),
    )
    rows = rows.crossJoin(F.broadcast(state))  # one row
    moved = (F.col(split) == "train") & ~F.col("_has") & F.when(F.col("_some"), validation_bucket(F.col(key)) == 0).otherwise(F.col(key) == F.col("_first"))
    return rows.withColumn(split, F.when(moved, "validation").otherwise(F.col(split))).drop("_has", "_some", "_first")


def stratified(rows: DataFrame, label: str, item: str, labels: list[str], per_split: int, seed: str = "annotation-v1") -> DataFrame:
    """Per label in hash order, dealt round robin over the labels to development and held out in turn."""
    # Only the first `2 * per_split / labels` of a label can be taken; filtered by rank, so that Spark keeps no more.
    order = Window.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256), item)
    index = F.element_at(F.create_map(*(F.lit(x) for i, v in enumerate(labels) for x in (v, i))), F.col(label))
    most = -(-2 * per_split // len(labels))
    rows = rows.where(F.col(label).isin(*labels)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    rows = rows.withColumn("position", ((F.col("_rank") - 1) * len(labels) + index).cast("int")).where(F.col("position") < 2 * per_split)
    return rows.withColumn("split", F.when(F.col("_rank") % 2 == 1, "development").otherwise("heldout")).drop("_rank")


def duplicate_groups(rows: DataFrame, key: str, item: str, label: str) -> DataFrame:
    """Per text key: size, least item, number of labels and whether they conflict."""
    return rows.groupBy(key).agg(F.count("*").alias("size"), F.min(item).alias("representative"), F.count_distinct(label).alias("labels")).withColumn("conflicting", F.col("labels") > 1)


def overlap_audit(new: DataFrame, existing: DataFrame, key: str, split: str) -> DataFrame:
    """How many new rows have a text that a split already has."""
    known = existing.select(key, split).distinct()
    return new.select(key).join(known, key).groupBy(split).agg(F.count("*").alias("overlapping"))
