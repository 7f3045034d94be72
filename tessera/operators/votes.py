"""From mentions to votes to product aggregates.

Mentions have product_id, review_id, aspect_id, sentiment and confidence; further columns as each
function says. Every step groups by a key that starts with product_id, so one exchange on
product_id serves votes, aspects and ranks: see `by_product`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology

CLASSES = {"excellent": "strengths", "good": "strengths", "poor": "weaknesses", "weak": "weaknesses", "mixed": "mixed", "neutral": "neutral", "insufficient_evidence": "insufficient_evidence"}
SUPPORT = 3


def by_product(mentions: DataFrame) -> DataFrame:
    """One exchange that the later groupings by (product_id, ...) reuse. For catalogues without a dominant
    product; with one, leave it out and let each grouping combine before it shuffles."""
    return mentions.repartition("product_id")


def checked(mentions: DataFrame) -> DataFrame:
    """Fails on an unknown sentiment or a confidence that is not a finite number in [0, 1]."""
    c = F.col("confidence")
    good = F.coalesce(F.col("sentiment").isin(*ontology.SENTIMENTS) & ~F.isnan(c) & c.between(0, 1), F.lit(False))
    return mentions.withColumn("confidence", F.when(good, c).otherwise(F.raise_error(F.lit("invalid saved mention"))))


def unique_reviews(reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """Drops repeated identical reviews; conflicting rows of one id are an error."""
    body = F.to_json(F.struct(*(c for c in reviews.columns)))
    seen = reviews.withColumn("_body", body).groupBy(key).agg(F.min("_body").alias("_low"), F.max("_body").alias("_high"), F.first(F.struct(*reviews.columns)).alias("_row"))
    ok = F.when(F.col("_low") == F.col("_high"), F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("conflicting saved analyses for review "), F.col(key).cast("string"))))
    return seen.select(ok.alias("_row")).select("_row.*")


def votes(mentions: DataFrame) -> DataFrame:
    """One vote per product, review and aspect; its confidence is the least of all their mentions."""
    has = lambda s: F.bool_or(F.col("sentiment") == s)
    grouped = (
        mentions.where("aspect_id is not null")
        .groupBy("product_id", "review_id", "aspect_id")
        .agg(has("positive").alias("pos"), has("negative").alias("neg"), F.min("confidence").alias("confidence"), F.count("*").alias("mention_count"))
    )
    vote = F.when(F.col("pos") & F.col("neg"), "neutral").when(F.col("pos"), "positive").when(F.col("neg"), "negative").otherwise("neutral")
    return grouped.select("product_id", "review_id", "aspect_id", vote.alias("vote"), (F.col("pos") & F.col("neg")).alias("contradictory"), "confidence", "mention_count")


def evidence(mentions: DataFrame) -> DataFrame:
    """Per vote the mentions that support it, in order of place. Mentions also have start_char, end_char,
    raw_aspect, tag and ordinal; those of one review and aspect are few."""
    item = F.struct("start_char", "end_char", "raw_aspect", "sentiment", "tag", "confidence", "ordinal")
    v = votes(mentions)
    kept = (F.col("sentiment") == F.col("vote")) | (F.col("contradictory") & F.col("sentiment").isin("positive", "negative"))
    keys = ["product_id", "review_id", "aspect_id"]
    rows = mentions.join(v.select(*keys, "vote", "contradictory"), keys).where(kept)
    kind = F.when(F.first("contradictory"), "mixed_within_review").otherwise("mention")
    return rows.groupBy(*keys).agg(F.first("vote").alias("vote"), kind.alias("evidence_type"), F.array_sort(F.collect_list(item)).alias("mentions"))


def classify(positive: Column, neutral: Column, negative: Column) -> Column:
    """Class of an aspect's votes; thresholds on double ratios, in this order."""
    n = positive + neutral + negative
    p, q = F.try_divide(positive.cast("double"), n.cast("double")), F.try_divide(negative.cast("double"), n.cast("double"))
    return (
        F.when(n < SUPPORT, "insufficient_evidence")
        .when(neutral == n, "neutral")
        .when(p >= F.lit(0.80), "excellent")
        .when(p >= F.lit(0.60), "good")
        .when(q >= F.lit(0.70), "poor")
        .when(q >= F.lit(0.50), "weak")
        .otherwise("mixed")
    )


def bucket_of(classification: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair)), classification)


def aggregate_tag(aspect_id: Column, classification: Column) -> Column:
    label = F.coalesce(ontology.label_of(aspect_id), aspect_id)
    return (
        F.when(classification.isin("excellent", "good"), ontology.tag_of(aspect_id, F.lit("positive")))
        .when(classification.isin("poor", "weak"), ontology.tag_of(aspect_id, F.lit("negative")))
        .when(classification == "neutral", ontology.tag_of(aspect_id, F.lit("neutral")))
        .when(classification == "mixed", F.concat(F.lit("Mixed "), label, F.lit(" Feedback")))
    )


def aspect_table(v: DataFrame) -> DataFrame:
    """Per product and aspect: counts, ratios, average confidence, score, class and tag. Scores are
    rounded to 9 digits, so that ranks do not hang on the order of a sum."""
    count = lambda s: F.count_if(F.col("vote") == s).alias(s)
    rows = v.groupBy("product_id", "aspect_id").agg(
        F.sum("mention_count").alias("mention_count"),
        F.count("*").alias("review_count"),
        F.count_if("contradictory").alias("contradictory_review_count"),
        *(count(s) for s in ontology.SENTIMENTS),
        F.avg("confidence").alias("average_confidence"),
    )
    return scored(rows)


def scored(rows: DataFrame) -> DataFrame:
    """Adds ratios, score, class and tag to counts and average confidence of products' aspects."""
    n = F.col("review_count")
    for s in ontology.SENTIMENTS:
        rows = rows.withColumn(f"{s}_ratio", F.col(s) / n)
    score = F.log1p(n.cast("double")) * F.col("average_confidence") * F.abs(F.col("positive_ratio") - F.col("negative_ratio"))
    rows = rows.withColumn("classification", classify(F.col("positive"), F.col("neutral"), F.col("negative"))).withColumn("score", F.round(score, 9))
    rows = rows.withColumn("average_confidence", F.round("average_confidence", 9))
    return rows.withColumn("aggregate_tag", aggregate_tag(F.col("aspect_id"), F.col("classification")))


def ranked(aspects: DataFrame) -> DataFrame:
    """Adds rank from 1 among supported aspects; null for the others."""
    supported = (F.col("classification") != "insufficient_evidence").cast("int")
    order = Window.partitionBy("product_id").orderBy(F.desc(supported), F.desc("score"), F.desc("review_count"), "aspect_id")
    return aspects.withColumn("rank", F.when(supported == 1, F.row_number().over(order)))


def product_ranking(mentions: DataFrame) -> DataFrame:
    return ranked(aspect_table(votes(mentions)))


def distribution(v: DataFrame) -> DataFrame:
    """Votes per label for each product, zeros included."""
    return v.groupBy("product_id").agg(*(F.count_if(F.col("vote") == s).alias(s) for s in ontology.SENTIMENTS))


def review_counts(reviews: DataFrame) -> DataFrame:
    """Distinct reviews of a product, those without aspects included."""
    return reviews.groupBy("product_id").agg(F.count_distinct("review_id").alias("review_count"))


def buckets(table: DataFrame) -> DataFrame:
    """Per product and bucket the aspects in order: by rank, or by id where evidence is insufficient."""
    item = F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), "aspect_id")
    rows = table.groupBy("product_id", bucket_of(F.col("classification")).alias("bucket")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("product_id", "bucket", F.transform("items", lambda x: x["aspect_id"]).alias("aspect_ids"))


def top_tags(table: DataFrame, top_k: int = 10) -> DataFrame:
    if top_k < 0:
        raise ValueError("top_k must be non-negative")
    return table.where(F.col("rank") <= top_k).select("product_id", "rank", "aspect_id", "classification", "aggregate_tag", "score")


def representatives(v: DataFrame, reviews: DataFrame, limit: int = 3) -> DataFrame:
    """The most confident votes of each product, aspect and label; reviews have review_id and helpful_votes."""
    if limit < 0:
        raise ValueError("representative_limit must be non-negative")
    rows = v.join(reviews.select("product_id", "review_id", "helpful_votes"), ["product_id", "review_id"])
    order = Window.partitionBy("product_id", "aspect_id", "vote").orderBy(F.desc("confidence"), F.desc("helpful_votes"), F.col("review_id"))
    place = F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(ontology.SENTIMENTS) for x in (s, i))), F.col("vote"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("label_order", place)


def snapshot(mentions: DataFrame, reviews: DataFrame, top_k: int = 10, limit: int = 3) -> DataFrame:
    """One nested row per product: what is published. Its arrays hold at most the ontology's aspects
    (times `limit` for representatives)."""
    v = votes(mentions)
    chosen = representatives(v, reviews, limit)
    chosen = chosen.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("aspect_id", "label_order", "place", "vote", "review_id", "confidence", "helpful_votes"))).alias("representative_reviews"))
    return nested(ranked(aspect_table(v)), review_counts(reviews), chosen, top_k)


def nested(table: DataFrame, counts: DataFrame, chosen: DataFrame, top_k: int = 10) -> DataFrame:
    """Published rows from ranked aspects, review counts and representative reviews of products."""
    table = table.withColumn("bucket", bucket_of(F.col("classification")))
    body = [c for c in table.columns if c not in ("product_id", "rank", "aspect_id")]
    item = F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("order"), "aspect_id", "rank", *body)
    # One grouping gives the aspects in order; counts, lists and top tags are read from that array.
    rows = table.groupBy("product_id").agg(F.array_sort(F.collect_list(item)).alias("aspects"), *(F.sum(s).alias(s) for s in ontology.SENTIMENTS))
    names = sorted(set(CLASSES.values()))
    listed = lambda b: F.transform(F.filter("aspects", lambda x: x["bucket"] == b), lambda x: x["aspect_id"])
    top = ("rank", "aspect_id", "classification", "aggregate_tag", "score")
    tops = F.transform(F.filter("aspects", lambda x: F.coalesce(x["rank"] <= top_k, F.lit(False))), lambda x: F.struct(*(x[c].alias(c) for c in top)))
    plain = F.transform("aspects", lambda x: F.struct(*(x[c].alias(c) for c in ("order", "aspect_id", "rank", *(c for c in body if c != "bucket")))))
    rows = rows.select("product_id", *ontology.SENTIMENTS, plain.alias("aspects"), *(listed(b).alias(f"{b}_aspects") for b in names), tops.alias("top_tags"))
    out = counts.join(rows, "product_id", "left").join(chosen, "product_id", "left")
    zeros = {s: F.coalesce(s, F.lit(0)) for s in ontology.SENTIMENTS}
    empty = {f"{b}_aspects": F.coalesce(f"{b}_aspects", F.array().cast("array<string>")) for b in names}
    return out.withColumns(zeros | empty)


def legacy_aggregate(mentions: DataFrame) -> DataFrame:
    """Counts of mentions, not votes. Mentions also have tag and ordinal (any total order)."""
    order = F.struct("ordinal", "review_id")
    rows = mentions.groupBy("product_id", "aspect_id", "sentiment").agg(F.count("*").alias("mentions"), F.min_by("tag", order).alias("tag"), F.min_by("review_id", order).alias("representative"))
    total = F.sum("mentions").over(Window.partitionBy("product_id", "aspect_id"))
    return rows.withColumn("ratio", F.round(F.col("mentions") / total, 4))


def legacy_ordered(rows: DataFrame, sentiment: str) -> DataFrame:
    """Strengths (positive) or weaknesses (negative) by (-mentions, aspect)."""
    order = Window.partitionBy("product_id").orderBy(F.desc("mentions"), "aspect_id")
    return rows.where(F.col("sentiment") == sentiment).withColumn("place", F.row_number().over(order))
