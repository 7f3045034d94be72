"""Incremental publication by deltas: a micro-batch of analyses is read, not what came before it.

An analysis of a review is written once, so votes are final and all that a snapshot says is mergeable: counts and sums of
confidence (as decimals, so that sums do not hang on their order) per product and aspect, numbers of reviews per product, and the
first few representatives per label. A batch is reduced to such partials, which are added to those of the products it touches. Partials are
kept by epoch and product bucket, and every `every` epochs they are merged into a base; a batch reads the base and at
most that many epochs of its own buckets. What it reads grows with the products, not with the reviews ever published.

An epoch writes folders of its own number and reads only lower ones, so a repeated epoch replaces what it wrote. A base is used
once its job has marked it complete. Reviews that arrive again are dropped by keyed state of the stream before their batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import ontology
from ..operators import votes
from ..session import cut

BUCKETS = 64
EVERY = 16
COUNTS = ("mention_count", "review_count", "contradictory_review_count", *ontology.SENTIMENTS)
EXACT = "decimal(38,15)"


def first_of_each_label(items: Column, limit: int) -> Column:
    """Of representatives that sort in their order, the first few of each label."""
    def of(label: int) -> Column:
        return F.slice(F.array_sort(F.filter(items, lambda x: x["label_order"] == label)), 1, limit)

    return F.flatten(F.array(*(of(i) for i in range(len(ontology.SENTIMENTS)))))


def partials(analyses: DataFrame, limit: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """Mergeable rows of new analyses (product_id, review_id, helpful_votes, tags): one for each aspect of a product,
    and one without an aspect for its number of reviews. A hot product is reduced in the tasks, representatives too."""
    mentions = analyses.select("product_id", "review_id", F.explode("tags").alias("t")).select("product_id", "review_id", "t.aspect_id", "t.sentiment", "t.confidence")
    v = votes.votes(votes.checked(mentions))
    counts = v.groupBy("product_id", "aspect_id").agg(
        F.sum("mention_count").alias("mention_count"),
        F.count("*").alias("review_count"),
        F.count_if("contradictory").alias("contradictory_review_count"),
        *(F.count_if(F.col("vote") == s).alias(s) for s in ontology.SENTIMENTS),
        F.sum(F.col("confidence").cast(EXACT)).cast(EXACT).alias("confidence"),
    )
    item = F.struct(F.col("label_order"), (-F.col("confidence")).alias("minus_confidence"), (-F.col("helpful_votes")).alias("minus_helpful"), F.col("review_id"))
    best = votes.representatives(v, analyses, limit).groupBy("product_id", "aspect_id").agg(F.array_sort(F.collect_list(item)).alias("representatives"))
    aspects = counts.join(best, ["product_id", "aspect_id"])
    none = [F.lit(0).cast("long").alias(c) for c in COUNTS if c != "review_count"]
    whole = analyses.groupBy("product_id").agg(F.count_distinct("review_id").alias("review_count")).select("product_id", F.lit(None).cast("string").alias("aspect_id"), "review_count", *none, F.lit(0).cast(EXACT).alias("confidence"))
    whole = whole.withColumn("representatives", F.lit(None).cast(aspects.schema["representatives"].dataType))
    return aspects.unionByName(whole).withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("int"))


def merged(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Partials of the same product and aspect as one; at most one for each epoch since the base meet."""
    parts = F.flatten(F.collect_list("representatives"))
    sums = [F.sum(c).alias(c) for c in COUNTS]
    return rows.groupBy("bucket", "product_id", "aspect_id").agg(*sums, F.sum("confidence").cast(EXACT).alias("confidence"), first_of_each_label(parts, limit).alias("representatives"))


def published(rows: DataFrame, top_k: int = 10) -> DataFrame:
    """Nested snapshots from merged partials."""
    aspects = rows.where("aspect_id is not null")
    average = (F.col("confidence") / F.col("review_count")).cast("double")
    table = votes.ranked(votes.scored(aspects.select("product_id", "aspect_id", *COUNTS, average.alias("average_confidence"))))
    label = F.element_at(F.array(*(F.lit(s) for s in ontology.SENTIMENTS)), F.col("r.label_order") + 1)
    each = aspects.select("product_id", "aspect_id", F.explode("representatives").alias("r"))
    place = F.row_number().over(Window.partitionBy("product_id", "aspect_id", "r.label_order").orderBy("r"))
    each = each.select("product_id", "aspect_id", F.col("r.label_order").alias("label_order"), place.alias("place"), label.alias("vote"), "r.review_id", (-F.col("r.minus_confidence")).alias("confidence"), (-F.col("r.minus_helpful")).alias("helpful_votes"))
    chosen = each.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("aspect_id", "label_order", "place", "vote", "review_id", "confidence", "helpful_votes"))).alias("representative_reviews"))
    return votes.nested(table, rows.where("aspect_id is null").select("product_id", "review_count"), chosen, top_k)


def _done(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete folders below one, such as base/upto=7."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath() for f in fs.listStatus(path) if "=" in f.getPath().getName()]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _sources(spark: SparkSession, path: str, epoch: int) -> tuple[int, list[str]]:
    """The newest complete base below an epoch (-1: none), and the folders that hold all partials below it."""
    base = max((n for n in _done(spark, f"{path}/base") if n < epoch), default=-1)
    folders = [f"{path}/base/upto={base}"] if base >= 0 else []
    return base, folders + [f"{path}/deltas/epoch={n}" for n in _done(spark, f"{path}/deltas") if base < n < epoch]


def _read(spark: SparkSession, schema, folders: list[str]) -> DataFrame:
    """Each folder has bucket folders of its own."""
    out = spark.createDataFrame([], schema)
    for f in folders:
        out = out.unionByName(spark.read.schema(schema).parquet(f))
    return out


def publish_batch(analyses: DataFrame, path: str, epoch: int, limit: int = 3, top_k: int = 10, buckets: int = BUCKETS, every: int = EVERY) -> None:
    """Adds a batch of analyses, each of a new review, and writes new snapshots of the products that it touches.

    `buckets` and `limit` stay the same for a path's whole life. An empty batch writes empty folders.
    """
    spark = analyses.sparkSession
    new = cut(partials(analyses, limit, buckets))
    base, folders = _sources(spark, path, epoch)
    if len(folders) > every:
        merged(_read(spark, new.schema, folders), limit).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/upto={epoch - 1}")
        _, folders = _sources(spark, path, epoch)
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/deltas/epoch={epoch}")
    touched = new.select("bucket", "product_id").distinct()
    listed = [r.bucket for r in touched.select("bucket").distinct().collect()]  # `buckets` numbers at most
    old = _read(spark, new.schema, folders).where(F.col("bucket").isin(listed)).join(touched, ["bucket", "product_id"], "left_semi")
    rows = published(merged(old.unionByName(new), limit), top_k)
    rows.withColumn("data_revision", F.col("review_count")).write.mode("overwrite").parquet(f"{path}/snapshots/epoch={epoch}")


def publish(analyses: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """A stream of analyses; a review that was there before is dropped."""
    new = analyses.dropDuplicates(["review_id"])
    writer = new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: publish_batch(batch, path, epoch, **options))
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(snapshots: DataFrame) -> DataFrame:
    """The latest published rows of each product. snapshots: product_id, epoch, ..."""
    last = snapshots.groupBy("product_id").agg(F.max("epoch").alias("epoch"))
    return snapshots.join(last, ["product_id", "epoch"])
