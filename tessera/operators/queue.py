"""Work queues as tables: claims with leases, attempts, previews before rows, resumable imports.

Each function is the batch twin of a transaction of a queue; `tessera.streaming.state` holds the running ones.
Claims read the head of the queue only (a top-k of as many rows as there are workers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS = 300
MOST_ATTEMPTS = 3


def eligible(jobs: DataFrame, now: Column, version: str) -> DataFrame:
    """Queued jobs of the version, and running ones whose lease has run out."""
    lapsed = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    return jobs.where((F.col("pipeline_version") == version) & ((F.col("status") == "queued") | F.coalesce(lapsed, F.lit(False))))


def claims(jobs: DataFrame, workers: DataFrame, now: Column, version: str, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """job_id, worker_id, attempt, lease_expires_at: the oldest eligible jobs, one for each worker that asks.

    Workers are served in the order of their ids and skip what others hold. They are counted first, so that only as many
    jobs as there are workers are ranked, whatever waits.
    """
    asks = workers.select("worker_id").distinct()
    head = eligible(jobs, now, version).orderBy("created_at", "job_id").limit(asks.count())
    head = head.withColumn("nth", F.row_number().over(Window.orderBy("created_at", "job_id")))
    asks = asks.withColumn("nth", F.row_number().over(Window.orderBy("worker_id")))
    lease = now + F.make_dt_interval(secs=F.lit(float(lease_seconds)))
    return head.join(asks, "nth").select("job_id", "worker_id", (F.col("attempt") + 1).alias("attempt"), lease.alias("lease_expires_at"))


def item_states(events: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """item_id, attempts, status of each item from its events (item_id, at, id, kind).

    kind: failed, completed, or retry (by hand), which starts the count anew. An item is completed once one
    attempt has been, failed after `most` failures since the last retry, else pending.
    """
    at = F.struct("at", "id")
    retries = events.where("kind = 'retry'").groupBy("item_id").agg(F.max(at).alias("since"))
    rows = events.join(retries, "item_id", "left").withColumn("counts", F.col("since").isNull() | (at > F.col("since")))
    out = rows.groupBy("item_id").agg(F.bool_or(F.col("kind") == "completed").alias("done"), F.count_if(F.col("counts") & (F.col("kind") == "failed")).alias("failures"))
    attempts = F.least("failures", F.lit(most)).cast("int")
    status = F.when(F.col("done"), "completed").when(F.col("failures") >= most, "failed").otherwise("pending")
    return out.select("item_id", attempts.alias("attempts"), status.alias("status"))


def job_states(items: DataFrame) -> DataFrame:
    """job_id, status and counters from its items' states (job_id, status); rejected rows count as errors."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    rows = items.groupBy("job_id").agg(n("completed").alias("completed"), n("failed").alias("failed"), n("rejected").alias("rejected"), n("pending", "running").alias("remaining"))
    status = F.when(F.col("remaining") > 0, "running").when(F.col("failed") + F.col("rejected") > 0, "completed_with_errors").otherwise("completed")
    return rows.withColumn("status", status)


def next_work(previews: DataFrame, items: DataFrame, now: Column, version: str) -> DataFrame:
    """worker_id, kind, work_id: what each worker does next. Previews (worker_id, preview_id, created_at,
    status, lease_expires_at, expires_at, pipeline_version) that have not expired go before the rows
    (worker_id, job_id, item_key, status) of the job that it holds; rows go by item key as text."""
    free = (F.col("status") == "queued") | F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") < now), F.lit(False))
    first = previews.where(free & (F.col("expires_at") > now) & (F.col("pipeline_version") == version))
    key = lambda rank, order, kind, work: F.struct(F.lit(rank).alias("rank"), order.alias("order"), F.lit(kind).alias("kind"), work.cast("string").alias("work_id"))
    one = first.select("worker_id", key(0, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "preview", F.col("preview_id")).alias("w"))
    two = items.where(F.col("status").isin("pending", "running")).select("worker_id", key(1, F.col("item_key").cast("string"), "item", F.col("item_key")).alias("w"))
    return one.unionByName(two).groupBy("worker_id").agg(F.min("w").alias("w")).select("worker_id", "w.kind", "w.work_id")


def import_states(log: DataFrame, sources: DataFrame) -> DataFrame:
    """source, cursor, next_batch and action of each resumable import, from the log of its batches.

    log: source, batch, state (pending, posted, terminal), end_cursor, source_sha256; sources: source, sha256
    as it is now. The cursor stands behind the last terminal batch; a later batch that is pending is posted
    again under its key, one that is posted is polled, without one the next is read. A source that has
    changed since is not resumed.
    """
    rank = F.when(F.col("state") == "terminal", 2).when(F.col("state") == "posted", 1).otherwise(0)
    batches = log.groupBy("source", "batch").agg(F.max(rank).alias("reached"), F.max("end_cursor").alias("end_cursor"), F.min("source_sha256").alias("sha_a"), F.max("source_sha256").alias("sha_z"))
    rows = batches.groupBy("source").agg(
        F.max(F.when(F.col("reached") == 2, F.struct("batch", "end_cursor"))).alias("last"),
        F.max(F.when(F.col("reached") < 2, F.struct("batch", "reached"))).alias("open"),
        F.min("sha_a").alias("sha_a"),
        F.max("sha_z").alias("sha_z"),
    )
    rows = sources.join(rows, "source", "left")
    changed = F.coalesce((F.col("sha_a") != F.col("sha256")) | (F.col("sha_z") != F.col("sha256")), F.lit(False))
    action = F.when(changed, "refuse").when(F.col("open.reached") == 0, "post").when(F.col("open.reached") == 1, "poll").otherwise("read")
    number = F.coalesce(F.col("open.batch"), F.col("last.batch") + 1, F.lit(0).cast("bigint"))
    return rows.select("source", F.coalesce("last.end_cursor", F.lit(0).cast("bigint")).alias("cursor"), number.alias("next_batch"), action.alias("action"))
