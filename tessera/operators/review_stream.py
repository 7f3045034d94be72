"""The sample of a review stream: candidate products, reviews checked in stream order, capped products, counters.

The rule is sequential: a review whose id was taken is a duplicate, one whose product is full is over the cap, and what is
over the cap does not count as taken, so its id may still be taken in another product. As sets: ids make offers, an id's first place in
each product in the order of the stream, and a product holds its `cap` earliest offers. Ids that are turned away offer their next place,
which may push out a later one there, and so on until nobody is turned away. Both sides prefer earlier places, so the outcome is the
one of the sequential rule. A round is one aggregate by id and a ranking that keeps `cap` rows a product on each side of
the shuffle; rounds are as many as the longest chain of ids that push each other out, and most ids stand in one product only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.session import cut

MOST_PRODUCTS, MOST_REVIEWS, MOST_POOL = 50, 100, 1000


def held_offers(offers: DataFrame, cap: int) -> DataFrame:
    """(review_id, product, place) that the stream takes, from (review_id, product, place) of first places by id and product."""
    if cap > MOST_REVIEWS:
        raise ValueError(f"at most {MOST_REVIEWS} reviews a product")
    offers, limits = cut(offers), None
    while True:
        alive = offers if limits is None else offers.join(limits, "product", "left").where("limit is null or place <= limit")
        best = cut(alive.groupBy("review_id").agg(F.min_by("product", "place").alias("product"), F.min("place").alias("place")))
        ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("product").orderBy("place"))).where(F.col("n") <= cap)
        held = cut(ranked)
        if held.count() == best.count():
            return held.drop("n")
        limits = held.where(F.col("n") == cap).select("product", F.col("place").alias("limit"))


def judged(reviews: DataFrame, pool: DataFrame, cap: int = MOST_REVIEWS) -> DataFrame:
    """reviews with `review_id`, `votes` and `reason`: why a review is not taken, null where it is.

    reviews: place (a unique number in stream order), row_ok, product, own_id, text, time, rating, helpful; pool: product.
    Rows that fail a check before the cap have no votes and no review_id. The pool is bounded by the caller.
    """
    pool = F.broadcast(pool.select("product").distinct().withColumn("in_pool", F.lit(True)))
    known = reviews.join(pool, "product", "left")
    no = F.lit(False)
    known = known.withColumn("reason", sampling.rejection(F.coalesce("row_ok", no), F.coalesce("in_pool", no), F.col("text"), F.col("time"), F.col("rating"), no, no)).drop("in_pool")
    names = [*reviews.columns, "review_id", "votes", "reason"]
    failed = known.where("reason is not null").withColumns({"review_id": F.lit(None).cast("string"), "votes": F.lit(None).cast("long")})
    own = F.trim("own_id")
    good = known.where("reason is null").drop("reason").withColumns({"review_id": sampling.review_id(own, F.col("product"), F.col("time"), F.col("text")), "votes": sampling.helpful_votes(F.col("helpful"))})
    held = held_offers(good.groupBy("review_id", "product").agg(F.min("place").alias("place")), cap)
    taken = held.select("review_id", F.col("place").alias("taken_at"))
    at, place = F.col("taken_at"), F.col("place")
    seen = good.join(taken, "review_id", "left").withColumn("reason", F.when(at.isNull() | (place < at), "over_cap").when(place > at, "duplicate")).drop("taken_at")
    return failed.select(names).unionByName(seen.select(names))


def candidates(metadata: DataFrame, most: int = 250, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the pool: product, name, category, brand, hash; metadata with `reason`, null for a product's first eligible row).

    metadata: place, row_ok, product, title, categories, brand, details.
    """
    if not 1 <= most <= MOST_POOL:
        raise ValueError(f"a pool has 1 to {MOST_POOL} products")
    rows = metadata.withColumn("product", F.trim("product"))
    fit = sampling.is_laptop(F.col("title"), F.col("categories"))
    rows = rows.withColumn("reason", F.when(~F.coalesce("row_ok", F.lit(False)), "malformed").when(F.coalesce("product", F.lit("")) == "", "missing_product").when(~fit, "non_laptop"))
    described = F.struct("place", F.trim("title").alias("name"), F.col("categories").alias("category"), sampling.brand(F.col("brand"), F.col("details")).alias("brand"))
    first = rows.where("reason is null").groupBy("product").agg(F.min_by(described, "place").alias("d"))
    pool = first.withColumn("hash", sampling.rank_key(F.col("product"), seed)).orderBy("hash", "product").limit(most)
    starts = first.select("product", F.col("d.place").alias("starts"))
    told = rows.join(starts, "product", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("place") != F.col("starts")), "duplicate_product").otherwise(F.col("reason")))
    return pool.select("product", "d.name", "d.category", "d.brand", "hash"), told.drop("starts")


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(counter, rows): all rows, and those of each reason."""
    named = F.concat(F.lit(f"{kind}_"), F.coalesce(F.col("reason"), F.lit("taken")))
    return rows.groupBy(named.alias("counter")).agg(F.count("*").alias("rows")).unionByName(rows.agg(F.count("*").alias("rows")).select(F.lit(f"{kind}_rows_scanned").alias("counter"), "rows"))


def sample(metadata: DataFrame, reviews: DataFrame, most_products: int = MOST_PRODUCTS, cap: int = MOST_REVIEWS, pool_size: int = 250, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the sampled reviews with their product's data and rank; counters).

    Products with three reviews or more come first, each part in the order of a seeded hash; the pool and the
    selection are bounded by their parameters, hence broadcast.
    """
    if not 1 <= most_products <= MOST_PRODUCTS or pool_size < most_products:
        raise ValueError(f"1 to {MOST_PRODUCTS} products, from a pool as large at least")
    pool, products = candidates(metadata, pool_size, seed)
    pool = cut(pool)
    verdicts = cut(judged(reviews, pool, cap))
    taken = verdicts.where("reason is null")
    chosen = sampling.select_products(taken.groupBy("product").agg(F.count("*").alias("reviews")), "product", most_products, 3, seed)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("short", "hash", "product"))  # over the selection alone
    chosen = cut(chosen.withColumn("rank", rank))
    about = F.broadcast(chosen.select("product", "rank").join(F.broadcast(pool.drop("hash")), "product"))
    rows = taken.join(about, "product").select("rank", "place", "review_id", "product", "name", "category", "brand", "text", "rating", F.col("votes").alias("helpful_votes"), "time")
    one = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("counter"), "rows")
    reached = verdicts.where("review_id is not null")
    odd = reached.where(F.coalesce(F.col("helpful").try_cast("long") < 0, F.col("helpful").isNotNull() & F.col("helpful").try_cast("long").isNull()))
    counters = _counted(products, "metadata").unionByName(_counted(verdicts, "reviews")).unionByName(one(odd, "reviews_invalid_helpful_votes"))
    for name, df in (("candidate_products", pool), ("selected_products", chosen), ("selected_products_with_three_reviews", chosen.where("reviews >= 3")), ("selected_reviews", rows)):
        counters = counters.unionByName(one(df, name))
    return rows, counters


