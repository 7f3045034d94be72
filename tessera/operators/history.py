"""Append-only histories: the latest record, what it implies, and drafts overlaid by corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest(rows: DataFrame, key: str, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest record of each key (by time, then id): a partial aggregate, so long histories don't meet."""
    names = [c for c in rows.columns]
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))).alias("_row")).select("_row.*")


def newest_first(rows: DataFrame, time: str = "created_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(tie))


def effective_status(runs: DataFrame, annotations: DataFrame, corrections: DataFrame) -> DataFrame:
    """Status of each run: its latest annotation's, unless the correction that it saw is not the latest one.

    annotations: run_id, id, created_at, status, correction_revision; corrections: run_id, id, created_at.
    """
    a = latest(annotations, "run_id").select("run_id", F.col("id").alias("annotation_id"), "status", "correction_revision")
    c = latest(corrections, "run_id").select("run_id", F.col("id").alias("correction_id"))
    rows = runs.select("run_id").join(a, "run_id", "left").join(c, "run_id", "left")
    changed = F.col("annotation_id").isNotNull() & ~F.col("correction_revision").eqNullSafe(F.col("correction_id"))
    status = F.when(changed | F.col("annotation_id").isNull(), "needs_review").otherwise(F.col("status"))
    return rows.select("run_id", status.alias("status"), changed.alias("corrections_changed"), F.col("annotation_id").alias("latest_id"))


def status_counts(rows: DataFrame, statuses: tuple[str, ...] = ("needs_review", "in_progress", "reviewed")) -> DataFrame:
    """A row per status, zeros included."""
    one = rows.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses))
    return one.select(F.explode(F.create_map(*(v for s in statuses for v in (F.lit(s), F.col(s))))).alias("status", "reviews"))


def draft(model: DataFrame, corrections: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Model mentions overlaid by corrections, oldest to newest: the last one of a span wins, and an
    unsupported span goes. corrections: key, columns, supported, created_at, id; rows without a
    resolution (supported null) change nothing."""
    order = F.struct(F.col("created_at").alias("t"), F.col("id").alias("i"))
    won = corrections.where("supported is not null").groupBy(*key).agg(F.max_by(F.struct("supported", *columns), order).alias("c"))
    rows = model.select(*key, F.struct(*columns).alias("m")).join(won, key, "full")
    pick = F.when(F.col("c").isNull(), F.col("m")).otherwise(F.struct(*(F.col(f"c.{c}").alias(c) for c in columns)))
    return rows.where(F.col("c").isNull() | F.col("c.supported")).select(*key, pick.alias("r")).select(*key, "r.*")


def stale_writes(batch: DataFrame, current: DataFrame, key: str = "run_id") -> DataFrame:
    """Writes whose expected previous record is not the latest one: conflicts. current: key, id."""
    last = current.select(key, F.col("id").alias("current_id"))
    return batch.join(last, key, "left").where(~F.col("expected_previous_id").eqNullSafe(F.col("current_id")))


def chained_writes(batch: DataFrame, current: DataFrame, key: str = "run_id") -> DataFrame:
    """The batch with `accepted`: each write of a key is compared with what the ones before it have left.

    batch: key, id, expected_previous_id, at (order within the key; unique there); current: key, id (null or no row: nothing
    stored). Ids are unique and never null. A write is the successor of the one that it expects if it is the first after that one to do
    so; accepted is what can be reached from the stored record. Successors are found by a partial aggregate and a join on ids, and
    reach by pointers that double their length each round, so a long chain or a hot key is no group in one task.
    """
    start = batch.select(key).distinct().join(current.select(key, F.col("id").alias("stored")), key, "left")
    writes = cut(batch.select(key, "id", F.col("expected_previous_id").alias("expected"), "at"))
    before = writes.select(key, F.col("id").alias("expected"), F.col("at").alias("since"))
    first = F.min(F.struct("at", "id"))
    after = writes.join(before, [key, "expected"]).where("at > since").groupBy(key, "expected").agg(first.alias("w")).select(key, F.col("w.id").alias("id"), F.col("expected").alias("to"), F.lit(False).alias("root"))
    roots = writes.join(start, key).where(F.col("expected").eqNullSafe(F.col("stored"))).groupBy(key).agg(first.alias("w")).select(key, F.col("w.id").alias("id"), F.lit(None).cast(writes.schema["id"].dataType).alias("to"), F.lit(True).alias("root"))
    # A write that is first for the stored record is a root, whatever else it could follow.
    links = cut(roots.unionByName(after.join(roots.select(key, "id"), [key, "id"], "left_anti")))
    while links.where("to is not null").limit(1).count():
        further = links.select(key, F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("at_root"))
        links = cut(links.join(further, [key, "to"], "left").select(key, "id", F.col("next").alias("to"), (F.col("root") | F.coalesce("at_root", F.lit(False))).alias("root")))
    return batch.join(links.where("root").select(key, "id", F.lit(True).alias("accepted")), [key, "id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def new_versions(saved: DataFrame, offered: DataFrame, key: tuple[str, ...] = ("review_id", "pipeline_version"), order: Column | None = None) -> DataFrame:
    """Offered rows whose (review, version) is not saved yet, one each; saved rows never change.

    Of several differing offers the first by `order` is taken, else the one whose JSON is least.
    """
    row = F.struct(*offered.columns)
    first = offered.groupBy(*key).agg(F.min_by(row, F.to_json(row) if order is None else order).alias("r")).select("r.*")
    return first.join(saved.select(*key), list(key), "left_anti")


def data_revisions(products: DataFrame, added: DataFrame) -> DataFrame:
    """Revision of each product after runs were added."""
    n = added.groupBy("product_id").agg(F.count("*").alias("added"))
    return products.join(n, "product_id", "left").withColumn("data_revision", F.col("data_revision") + F.coalesce("added", F.lit(0))).drop("added")


def staleness(snapshot_version: Column, version: Column, snapshot_revision: Column, revision: Column, pending: Column) -> Column:
    return F.coalesce((pending > 0) | (snapshot_version != version) | (snapshot_revision != revision), F.lit(True))


def job_status(failed: Column, rejected: Column, remaining: Column) -> Column:
    return F.when(remaining > 0, "running").when((failed > 0) | (rejected > 0), "completed_with_errors").otherwise("completed")


def next_items(items: DataFrame) -> DataFrame:
    """The next queued item of each job, item keys in string order."""
    return items.where("status = 'queued'").groupBy("job_id").agg(F.min(F.col("item_key").cast("string")).alias("item_key"))


def forward_filled(rows: DataFrame, columns: list[str], order: str, partition: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
