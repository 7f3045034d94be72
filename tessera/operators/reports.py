"""Reports read from published aspects: robustness, comparison, quality queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ontology
from ..functions.text import collapsed
from .votes import SUPPORT, classify

# What each reason of the quality queue says.
REASONS = ("unknown_aspect", "low_confidence", "no_aspects", "contradictory_sentiment")


def tag_family(classification: Column) -> Column:
    return F.when(classification.isin("excellent", "good"), "positive").when(classification.isin("poor", "weak"), "negative").otherwise(classification)


def removal_scenarios(aspects: DataFrame) -> DataFrame:
    """Each label with votes, less one vote: the class then. Three rows an aspect at most, whatever the reviews."""
    counts = {s: F.col(s) for s in ontology.SENTIMENTS}
    options = F.array(*(F.struct(F.lit(s).alias("removed_vote"), counts[s].alias("votes"), classify(*(c - int(k == s) for k, c in counts.items())).alias("outcome")) for s in ontology.SENTIMENTS))
    rows = aspects.withColumn("o", F.explode(options)).where("o.votes > 0")
    same = tag_family(F.col("o.outcome")) == tag_family(F.col("classification"))
    return rows.select("product_id", "aspect_id", "classification", "o.removed_vote", "o.votes", "o.outcome", (F.col("o.outcome") == F.col("classification")).alias("class_unchanged"), same.alias("tag_unchanged"))


def leave_one_out(aspects: DataFrame) -> DataFrame:
    """How often leaving out one vote leaves the class, and the tag's direction, as they are."""
    total = sum((F.col(s) for s in ontology.SENTIMENTS), F.lit(0))
    kept = {"class": F.lit(0), "tag": F.lit(0)}
    counts = {s: F.col(s) for s in ontology.SENTIMENTS}
    for s in ontology.SENTIMENTS:
        outcome = classify(*(c - int(k == s) for k, c in counts.items()))
        kept["class"] += F.when((counts[s] > 0) & (outcome == F.col("classification")), counts[s]).otherwise(0)
        kept["tag"] += F.when((counts[s] > 0) & (tag_family(outcome) == tag_family(F.col("classification"))), counts[s]).otherwise(0)
    return aspects.select(
        "product_id",
        "aspect_id",
        "classification",
        total.alias("votes"),
        (total >= SUPPORT).alias("supported"),
        F.round(F.try_divide(kept["class"].cast("double"), total.cast("double")), 9).alias("classification_stability"),
        F.round(F.try_divide(kept["tag"].cast("double"), total.cast("double")), 9).alias("tag_stability"),
        ((total >= SUPPORT) & (kept["tag"] < total)).alias("fragile_tag"),
        ((F.col("positive") > 0) & (F.col("negative") > 0)).alias("opposing_review_votes"),
        "contradictory_review_count",
        (F.col("neutral") - F.col("contradictory_review_count")).alias("ordinary_neutral_review_count"),
    )


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Aspects of two sides joined on keys (aspect_id among them); each has review_count, positive_ratio,
    negative_ratio, pipeline_version. A difference needs support on both sides and one pipeline version."""
    own = ("review_count", "positive_ratio", "negative_ratio", "classification", "pipeline_version")
    side = lambda df, name: df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in own))
    rows = side(left, "left").join(side(right, "right"), keys, "full")
    supported = {s: F.coalesce(F.col(f"{s}_review_count") >= SUPPORT, F.lit(False)) for s in ("left", "right")}
    # A product has one version, so a missing aspect does not hide a mismatch: versions come with the pair.
    mismatch = F.coalesce(F.col("left_pipeline_version") != F.col("right_pipeline_version"), F.lit(False))
    balance = {s: F.col(f"{s}_positive_ratio") - F.col(f"{s}_negative_ratio") for s in ("left", "right")}
    usable = supported["left"] & supported["right"] & ~mismatch
    rows = rows.withColumn("difference", F.when(usable, F.round(balance["left"] - balance["right"], 9) + F.lit(0.0)))
    signal = F.when(F.col("difference").isNull(), "insufficient_evidence").when(F.col("difference") > 0, "left").when(F.col("difference") < 0, "right").otherwise("tie")
    return rows.withColumns({"signal": signal, "left_gap": ~supported["left"], "right_gap": ~supported["right"], "version_mismatch": mismatch})


def verdict(rows: DataFrame, keys: list[str], blocked: Column | None = None) -> DataFrame:
    """Leads of either side; no winner where blocked (stale, mismatched versions) or level."""
    out = rows.groupBy(*keys).agg(F.count_if(F.col("signal") == "left").alias("left_leads"), F.count_if(F.col("signal") == "right").alias("right_leads"), F.bool_or(F.coalesce(blocked if blocked is not None else F.col("version_mismatch"), F.lit(False))).alias("blocked"))
    winner = F.when(~F.col("blocked") & (F.col("left_leads") > F.col("right_leads")), "left").when(~F.col("blocked") & (F.col("left_leads") < F.col("right_leads")), "right")
    return out.withColumn("winner", winner)


def canonical_key(tag: Column) -> Column:
    by_id, by_label = F.trim(tag["normalized_aspect_id"]), collapsed(tag["normalized_aspect"])
    return F.lower(F.coalesce(F.when(by_id != "", by_id), F.when(by_label != "", by_label)))


def quality_queue(analyses: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Analyses that need a person: review_id, review_text, tags array<struct<normalized_aspect,
    normalized_aspect_id, sentiment, confidence, ...>> -> reasons, minimum_confidence, n_reasons."""
    if not 0 <= threshold <= 1:
        raise ValueError("confidence_threshold must be finite and between 0 and 1")
    tags = F.coalesce("tags", F.array().cast(analyses.schema["tags"].dataType))
    unknown = F.exists(tags, lambda t: t["normalized_aspect"].isNull() & t["normalized_aspect_id"].isNull())
    values = F.filter(F.transform(tags, lambda t: t["confidence"]), lambda c: c.isNotNull() & ~F.isnan(c) & c.between(0, 1))
    signed = lambda s: F.array_distinct(F.filter(F.transform(F.filter(tags, lambda t: t["sentiment"] == s), canonical_key), lambda k: k.isNotNull()))
    contradiction = F.arrays_overlap(signed("positive"), signed("negative"))
    least = F.array_min(values)
    checks = (unknown, F.coalesce(least < threshold, F.lit(False)), F.size(tags) == 0, F.coalesce(contradiction, F.lit(False)))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in zip(REASONS, checks, strict=True))))
    return analyses.withColumns({"reasons": reasons, "minimum_confidence": least}).where(F.size("reasons") > 0).withColumn("n_reasons", F.size("reasons"))


def in_queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.desc("n_reasons"), F.coalesce(F.col("review_id").cast("string"), F.lit("")), "review_text")


def reason_counts(queue: DataFrame) -> DataFrame:
    """A row per reason, zeros included."""
    return queue.agg(*(F.count_if(F.array_contains("reasons", r)).alias(r) for r in REASONS)).select(F.explode(F.create_map(*(x for r in REASONS for x in (F.lit(r), F.col(r))))).alias("reason", "reviews"))


# The fields of a tag that are exported, in order.
TAG_FIELDS = (
    "raw_aspect", "normalized_aspect", "normalized_aspect_id", "normalization_method", "normalization_similarity", "sentiment", "confidence", "aspect_confidence",
    "sentiment_confidence", "probabilities", "tag", "start_char", "end_char", "context_start_char", "context_end_char",
)


def exported_tags(analyses: DataFrame, tags: str = "tags") -> Column:
    """Tags with only the exported fields, those that the input has."""
    have = set(analyses.schema[tags].dataType.elementType.names)
    return F.transform(tags, lambda t: F.struct(*(t[f].alias(f) for f in TAG_FIELDS if f in have)))


def uncertain(tag: Column, threshold: float = 0.6) -> Column:
    c = tag["confidence"]
    return tag["normalized_aspect_id"].isNull() | c.isNull() | F.isnan(c) | ~F.abs(c).between(0, float.fromhex("0x1.fffffffffffffp+1023")) | (c < threshold)
