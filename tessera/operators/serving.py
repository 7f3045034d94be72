"""Reads that serve a page or a request: pages, shown aspects, preview summaries, merged replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_text_key
from .ranks import numbered
from .votes import SUPPORT

MOST_PAGE_SIZE, MOST_TOP_K = 100, 50


def page(rows: DataFrame, order: list[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    """One page of rows in a total order: a top-k of `number * size` rows, not a sort of all."""
    if number < 1 or not 1 <= size <= MOST_PAGE_SIZE:
        raise ValueError(f"page starts at 1 and page_size is 1..{MOST_PAGE_SIZE}")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, key: list[str], order: list[Column | str], size: int = 20) -> DataFrame:
    """Rows with the page that they are on within their key."""
    return numbered(rows, order, key, "_place").withColumn("page", F.floor((F.col("_place") - 1) / size).cast("int") + 1).drop("_place")


def checked_top_k(top_k: int) -> int:
    if isinstance(top_k, bool) or not 1 <= top_k <= MOST_TOP_K:
        raise ValueError(f"top_k must be 1..{MOST_TOP_K}")
    return top_k


def shown_aspects(aspects: DataFrame, needle: str = "") -> DataFrame:
    """Aspects of a product whose label holds the needle, in the order shown: most reviews first, then by label."""
    order = Window.partitionBy("product_id").orderBy(F.desc("review_count"), F.lower("label"), "label")
    return aspects.where(F.contains(F.lower("label"), F.lower(F.lit(needle)))).withColumn("shown", F.row_number().over(order))


def shown_reviews(votes: DataFrame, order: list[Column | str], vote: str | None = None, most: int = 5) -> DataFrame:
    """The first reviews of each product and aspect with the wanted vote."""
    rows = votes if vote is None else votes.where(F.col("vote") == vote)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("product_id", "aspect_id").orderBy(*order))).where(F.col("place") <= most)


def highlights(aspects: DataFrame) -> DataFrame:
    """Per product the numbers of aspects, of supported strengths and of supported complaints."""
    supported = F.col("review_count") >= SUPPORT
    return aspects.groupBy("product_id").agg(
        F.count("*").alias("aspects"),
        F.count_if(supported & F.col("classification").isin("good", "excellent")).alias("strengths"),
        F.count_if(supported & F.col("classification").isin("weak", "poor")).alias("complaints"),
    )


def preview_summary(requested: DataFrame, previews: DataFrame, now: Column, version: str) -> tuple[DataFrame, DataFrame]:
    """(outcome, unique): per request its error or number of duplicate reviews, and the previews that count.

    requested: request_id, product_id, ordinal, preview_id; previews: preview_id, product_id, review_text,
    expires_at, pipeline_version, status. A preview asked for twice counts once; of equal texts the first asked
    for. Errors: `missing` for any that is not the product's; else that of the first in order that is `expired`,
    of another `version`, or `incomplete`. Requests with an error have no unique previews.
    """
    asked = requested.groupBy("request_id", "product_id", "preview_id").agg(F.min("ordinal").alias("ordinal"))
    rows = asked.join(previews, ["product_id", "preview_id"], "left")
    error = F.when(F.col("expires_at") <= now, "expired").when(F.col("pipeline_version") != version, "version").when(F.col("status") != "completed", "incomplete")
    rows = rows.withColumn("error", F.when(F.col("status").isNull(), "missing").otherwise(error)).withColumn("key", product_text_key(F.col("review_text"), exact=False))
    outcome = rows.groupBy("request_id", "product_id").agg(
        F.when(F.bool_or(F.col("error") == "missing"), "missing").otherwise(F.min(F.when(F.col("error").isNotNull(), F.struct("ordinal", "error")))["error"]).alias("error"),
        (F.count("*") - F.count_distinct("key")).alias("duplicate_reviews"),
    )
    outcome = outcome.withColumn("duplicate_reviews", F.when(F.col("error").isNull(), F.col("duplicate_reviews")))
    first = rows.groupBy("request_id", "product_id", "key").agg(F.min_by("preview_id", "ordinal").alias("preview_id"), F.min("ordinal").alias("ordinal"))
    unique = first.join(outcome.where("error is null").select("request_id"), "request_id", "left_semi").select("request_id", "product_id", "ordinal", "preview_id")
    return outcome, unique


def with_metadata(reviews: DataFrame, products: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reviews with their product's columns, one row with the numbers of hits and misses)."""
    both = reviews.join(products.withColumn("_known", F.lit(True)), key, "left")
    counts = both.agg(F.count_if(F.col("_known").isNotNull()).alias("hits"), F.count_if(F.col("_known").isNull()).alias("misses"))
    return both.where("_known is not null").drop("_known"), counts


def merged(tags: DataFrame, replacements: DataFrame, columns: list[str], reviews: DataFrame | None = None) -> DataFrame:
    """Tags whose uncertain spans take their replacement; a review without any tag takes all of its own.

    tags: review_id, start_char, end_char, uncertain, columns; replacements: the same without `uncertain`.
    """
    key = ["review_id", "start_char", "end_char"]
    new = replacements.select(*key, F.struct(*columns).alias("r"))
    rows = tags.select(*key, "uncertain", F.struct(*columns).alias("t")).join(new, key, "left")
    kept = rows.select(*key, F.when(F.col("uncertain") & F.col("r").isNotNull(), F.col("r")).otherwise(F.col("t")).alias("t"))
    bare = new.join(tags.select("review_id").distinct(), "review_id", "left_anti").select(*key, F.col("r").alias("t"))
    return kept.unionByName(bare).select(*key, "t.*")


def misplaced_suggestions(corrections: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Corrections that name a suggestion of another run, snapshot or span, or one that is not there."""
    named = ("run_id", "snapshot_id", "start_char", "end_char")
    s = suggestions.select(F.col("id").alias("suggestion_id"), F.struct(*named).alias("own"))
    rows = corrections.where("suggestion_id is not null").join(s, "suggestion_id", "left")
    return rows.where(~F.col("own").eqNullSafe(F.struct(*named))).select(*[c for c in corrections.columns])


def plain_tags(mentions: DataFrame) -> DataFrame:
    """The few fields of a mention that a plain tag has; without a tag its text is empty."""
    return mentions.withColumn("tag", F.coalesce("tag", F.lit(""))).select("review_id", "normalized_aspect", "sentiment", "tag", "confidence", "raw_aspect", "start_char", "end_char")


def proposal_summary(tasks: DataFrame) -> DataFrame:
    """One row. tasks: mentions array<struct<canonical_id, ...>>, flags array<string>; counts of flags are sorted by name."""
    known = F.size(F.filter("mentions", lambda m: m["canonical_id"].isNotNull()))
    one = tasks.agg(
        F.coalesce(F.sum(F.size("mentions")), F.lit(0)).alias("proposed_mentions"),
        F.coalesce(F.sum(known), F.lit(0)).alias("proposed_known_mentions"),
        F.coalesce(F.sum(F.size("mentions") - known), F.lit(0)).alias("proposed_unknown_mentions"),
        F.count_if(F.size("mentions") == 0).alias("reviews_without_explicit_mentions"),
        F.count_if(F.size("flags") > 0).alias("reviews_with_flags"),
    )
    flags = tasks.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    listed = flags.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flag", "n"))), lambda f: F.concat_ws(":", f["flag"], f["n"].cast("string"))), ",").alias("flag_counts"))  # a few kinds
    return one.crossJoin(F.broadcast(listed))  # one row each
