"""Catalogue reads and removals over products, reviews, runs and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product_counts(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products with their number of reviews, those without any included. Reviews combine before the join."""
    n = reviews.groupBy("product_id").agg(F.count("*").alias("review_count"))
    return products.join(n, "product_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def analyses(runs: DataFrame, reviews: DataFrame, members: DataFrame | None = None, version: str | None = None, before: str | None = None) -> DataFrame:
    """Runs with their reviews, of one version, within a membership or created no later than a time."""
    rows = runs if version is None else runs.where(F.col("pipeline_version") == version)
    rows = rows if before is None else rows.where(F.col("created_at") <= F.to_timestamp(F.lit(before)))
    rows = rows.join(reviews, "review_id")
    return rows if members is None else rows.join(members.select("review_id").distinct(), "review_id", "left_semi")


def missing_runs(reviews: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """Reviews without a run of the version."""
    return reviews.join(runs.where(F.col("pipeline_version") == version).select("review_id"), "review_id", "left_anti")


def corrections_export(corrections: DataFrame, runs: DataFrame, reviews: DataFrame) -> DataFrame:
    return corrections.join(runs, "run_id").join(reviews, "review_id")


def annotations_export(annotations: DataFrame, runs: DataFrame, reviews: DataFrame, members: DataFrame) -> DataFrame:
    return corrections_export(annotations, runs, reviews).join(members.select("review_id").distinct(), "review_id", "left_semi")


def saved_imports(jobs: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy("job_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "completed").alias("completed"))
    return jobs.join(n, "job_id", "left").na.fill(0, ["items", "completed"])


def remove_import(tables: dict[str, DataFrame], job_id) -> dict[str, DataFrame]:
    """New versions of the tables without one import: its items, and reviews that no other import has, with
    their runs and mentions. Fails while its product has active jobs."""
    jobs, items, reviews, runs, mentions = (tables[t] for t in ("jobs", "items", "reviews", "runs", "mentions"))
    product = jobs.where(F.col("job_id") == job_id).select("product_id")
    active = jobs.join(product, "product_id", "left_semi").where(F.col("status").isin("queued", "running")).agg(F.count("*").alias("active"))
    own = items.where(F.col("job_id") == job_id).select("review_id").distinct()
    shared = items.where(F.col("job_id") != job_id).select("review_id").distinct()
    gone = own.join(shared, "review_id", "left_anti").crossJoin(F.broadcast(active))  # one row
    gone = gone.select(F.when(F.col("active") == 0, F.col("review_id")).otherwise(F.raise_error(F.lit("the product has active work"))).alias("review_id"))
    lost_runs = runs.join(gone, "review_id", "left_semi").select("run_id")
    return {
        "jobs": jobs.where(F.col("job_id") != job_id),
        "items": items.where(F.col("job_id") != job_id),
        "reviews": reviews.join(gone, "review_id", "left_anti"),
        "runs": runs.join(gone, "review_id", "left_anti"),
        "mentions": mentions.join(lost_runs, "run_id", "left_anti"),
    }


def remove_product(tables: dict[str, DataFrame], product_id) -> dict[str, DataFrame]:
    """New versions of the tables without one product's rows."""
    reviews = tables["reviews"].where(F.col("product_id") == product_id).select("review_id")
    runs = tables["runs"].join(reviews, "review_id", "left_semi").select("run_id")
    out = {t: tables[t].where(F.col("product_id") != product_id) for t in ("products", "reviews", "jobs") if t in tables}
    return out | {"runs": tables["runs"].join(reviews, "review_id", "left_anti"), "mentions": tables["mentions"].join(runs, "run_id", "left_anti")}


def seed_products(products: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds that are not there yet are added; those that are stay as they are."""
    return products.unionByName(seeds.dropDuplicates(["product_id"]).join(products.select("product_id"), "product_id", "left_anti").select(*products.columns))


# Fixed value: the name space of URLs, of RFC 4122.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """The id of a name within a name space, by SHA-1, as RFC 4122 says."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("bigint")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def active_counts(jobs: DataFrame, previews: DataFrame, now) -> DataFrame:
    j = jobs.agg(F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"))
    p = previews.agg(F.count_if(F.col("status").isin("queued", "running") & (F.col("expires_at") > now)).alias("active_previews"))
    return j.crossJoin(F.broadcast(p))  # one row each


def idempotent(requests: DataFrame) -> DataFrame:
    """requests: scope, key, request_hash, at, id -> outcome: new, repeat (same hash as the first) or conflict."""
    first = requests.groupBy("scope", "key").agg(F.min_by(F.struct("request_hash", "id"), F.struct("at", "id")).alias("f"))
    rows = requests.join(first, ["scope", "key"])
    outcome = F.when(F.col("id") == F.col("f.id"), "new").when(F.col("request_hash") == F.col("f.request_hash"), "repeat").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("f")
