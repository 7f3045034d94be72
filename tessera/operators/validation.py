"""Checks as rows: each function returns the violations, none where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology
from ..functions.text import slice_text

NEAR = 1e-5
MOST_CHARACTERS = 10000


def import_rows(rows: DataFrame) -> DataFrame:
    """rows: ordinal, record (map<string, string> or null) -> ordinal, text, error.

    The text is the first of review_text, text, reviewText that is present, even if it is null.
    """
    key = F.array_compact(F.array(*(F.when(F.map_contains_key("record", k), F.lit(k)) for k in ("review_text", "text", "reviewText"))))
    text = F.try_element_at("record", F.get(key, F.lit(0)))
    return rows.select("ordinal", *_text_checked(text))


def import_texts(rows: DataFrame) -> DataFrame:
    """rows: ordinal, value -> ordinal, text, error."""
    return rows.select("ordinal", *_text_checked(F.col("value")))


def _text_checked(text: Column) -> list[Column]:
    blank = text.isNull() | (F.regexp_replace(text, r"(?U)\s+", "") == "")
    error = F.when(blank, "Review text must be a non-empty string").when(F.length(text) > MOST_CHARACTERS, f"Review text exceeds {MOST_CHARACTERS} characters")
    return [F.when(error.isNull(), text).alias("text"), error.alias("error")]


def _failed(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    return rows.select(*key, F.explode(names).alias("check"))


def mentions(rows: DataFrame, key: list[str], text: str = "review_text") -> DataFrame:
    """Spans, contexts and confidences of mentions against each other and the text."""
    prob = F.try_element_at("probabilities", F.col("sentiment"))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, v: a + v)
    known = F.col("normalized_aspect_id").isNotNull()
    return _failed(
        rows,
        key,
        {
            "offsets": (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.length(text)),
            "context": (F.col("context_start_char") <= F.col("start_char")) & (F.col("end_char") <= F.col("context_end_char")),
            "span_text": slice_text(F.col(text), F.col("start_char"), F.col("end_char")) == F.col("raw_aspect"),
            "confidence": F.abs(F.col("confidence") - F.least("aspect_confidence", "sentiment_confidence")) <= NEAR,
            "unknown": (known == F.col("normalized_aspect").isNotNull()) & (known == F.col("tag").isNotNull()),
            "sentiment_confidence": F.abs(F.col("sentiment_confidence") - prob) <= NEAR,
            "probabilities": F.abs(total - 1) <= NEAR,
        },
    )


def jobs(rows: DataFrame, key: list[str]) -> DataFrame:
    c = F.col
    return _failed(
        rows,
        key,
        {
            "total": c("total") == c("accepted") + c("rejected") + c("duplicate"),
            "progress": c("completed") + c("failed") <= c("accepted"),
            "completed": (c("status") != "completed") | ((c("failed") == 0) & (c("rejected") == 0)),
            "times": c("updated_at") >= c("created_at"),
        },
    )


def insights(aspects: DataFrame, key: list[str] = ("product_id", "aspect_id")) -> DataFrame:
    votes = sum((F.col(s) for s in ontology.SENTIMENTS), F.lit(0))
    ratios = [F.abs(F.col(f"{s}_ratio") - F.col(s) / F.col("review_count")) <= NEAR for s in ontology.SENTIMENTS]
    return _failed(aspects, list(key), {"votes": votes == F.col("review_count"), "mentions": F.col("review_count") <= F.col("mention_count"), "ratios": reduce(lambda a, b: a & b, ratios)})


def unlisted(aspects: DataFrame, listed: DataFrame) -> DataFrame:
    """Aspects that no bucket lists, or listed ones that aren't there. listed: product_id, aspect_ids."""
    flat = listed.select("product_id", F.explode("aspect_ids").alias("aspect_id"))
    lost = aspects.select("product_id", "aspect_id").exceptAll(flat).withColumn("check", F.lit("not_listed"))
    return lost.unionByName(flat.exceptAll(aspects.select("product_id", "aspect_id")).withColumn("check", F.lit("listed_twice_or_unknown")))


def annotations(rows: DataFrame, key: str, text: str = "review_text") -> DataFrame:
    """Annotated mentions: exact spans, no overlaps within a review, canonical ids of the ontology or null."""
    before = F.max("end_char").over(Window.partitionBy(key).orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before)
    ids = F.col("canonical_id").isNull() | F.col("canonical_id").isin(*ontology.IDS)
    return _failed(
        rows,
        [key, "start_char", "end_char"],
        {
            "span_text": slice_text(F.col(text), F.col("start_char"), F.col("end_char")) == F.col("raw_aspect"),
            "overlap": F.col("_before").isNull() | (F.col("start_char") >= F.col("_before")),
            "canonical_id": ids,
            "sentiment": F.col("sentiment").isin(*ontology.SENTIMENTS),
        },
    )


def coverage(tasks: DataFrame, reviewed: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Tasks that are missing, repeated, unknown or changed in a fixed column."""
    a = tasks.select(key, F.struct(*fixed).alias("was"))
    b = reviewed.groupBy(key).agg(F.count("*").alias("times"), F.first(F.struct(*fixed)).alias("now"))
    rows = a.join(b, key, "full")
    kind = F.when(F.col("was").isNull(), "unknown").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "repeated").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return rows.select(key, kind.alias("check")).where("check is not null")


def corrections(rows: DataFrame, key: list[str]) -> DataFrame:
    """Decision rules. rows: decision, suggestion_id, canonical_id, has_canonical, sentiment, supported."""
    follows = F.col("decision").isin("accepted", "rejected")
    bare = F.col("canonical_id").isNull() & F.col("sentiment").isNull()
    return _failed(
        rows,
        key,
        {
            "suggestion": ~follows | F.col("suggestion_id").isNotNull(),
            "edit_instead": ~follows | (bare & F.col("supported")),
            "edit_complete": follows | ~F.col("supported") | (F.col("sentiment").isNotNull() & F.col("has_canonical")),
            "unsupported": follows | F.col("supported") | bare,
        },
    )


def reviews(rows: DataFrame, key: list[str]) -> DataFrame:
    """A reviewed annotation without mentions must say that there are none."""
    return _failed(rows, key, {"confirmed": ~((F.col("status") == "reviewed") & (F.size("mentions") == 0)) | F.col("confirmed_no_aspects")})


def idempotency_key(key: Column) -> Column:
    return F.coalesce(F.length(key).between(1, 64) & F.lower(key).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def inline_reviews(texts: Column) -> Column:
    return F.coalesce(F.size(texts).between(1, 100) & F.forall(texts, lambda t: F.length(t).between(1, MOST_CHARACTERS)), F.lit(False))


def contains_folded(x: Column, wanted: Column) -> Column:
    return F.contains(F.lower(x), F.lower(wanted))
