import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessera.operators import votes
from tessera.plans import fixtures
from tessera.streaming import publish, state

SMALL = "/root/testdata/sf0.001"


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_published_snapshots_equal_the_batch(spark, tmp_path):
    """Five epochs of a stream, merged into bases on the way; reviews that come again change nothing."""
    rows = fixtures.analyses(spark, SMALL).cache()
    for i in range(5):
        part = rows.where(F.col("review_id") % 5 == i)
        (part if i < 4 else part.unionByName(rows.where("review_id % 50 = 3"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    publish.publish(stream, out, str(tmp_path / "check"), buckets=4, every=2).awaitTermination(600)
    saved = publish.current(spark.read.parquet(out + "/snapshots")).drop("epoch", "data_revision")
    want = votes.snapshot(fixtures.mentions(spark, SMALL), fixtures.reviews(spark, SMALL))
    assert len(publish._done(spark, out + "/deltas")) == 5 and publish._done(spark, out + "/base")
    flat = lambda df: df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith("array")})
    assert same(flat(saved), flat(want))


def test_epochs_that_run_again_change_nothing(spark, tmp_path):
    rows, out = fixtures.analyses(spark, SMALL).cache(), str(tmp_path / "out")
    for epoch in (0, 0, 1, 2, 2):
        publish.publish_batch(rows.where(F.col("review_id") % 3 == epoch), out, epoch, buckets=2, every=1)
    publish.publish_batch(rows.limit(0), out, 3, buckets=2, every=1)
    got = publish.current(spark.read.parquet(out + "/snapshots")).select("product_id", "review_count", "positive")
    want = votes.snapshot(fixtures.mentions(spark, SMALL), fixtures.reviews(spark, SMALL)).select("product_id", "review_count", "positive")
    assert same(got, want)


def test_a_batch_reads_no_history_of_reviews(spark, tmp_path):
    """Epochs of as many new reviews of the same products: what one reads just before a base is written does not grow."""
    out, sizes = str(tmp_path / "out"), []
    tag = F.array(F.struct(F.lit("battery").alias("aspect_id"), F.lit("positive").alias("sentiment"), F.lit(0.75).alias("confidence")))
    for epoch in range(6):
        batch = spark.range(epoch * 300, epoch * 300 + 300).select((F.col("id") % 7).alias("product_id"), F.col("id").alias("review_id"), (F.col("id") % 5).alias("helpful_votes"), tag.alias("tags"))
        _, folders = publish._sources(spark, out, epoch)
        publish.publish_batch(batch, out, epoch, buckets=2, every=2)
        sizes.append(sum(f.stat().st_size for d in folders for f in Path(d).rglob("*.parquet")))
    assert 0 < sizes[1] < sizes[3] and sizes[5] <= 1.1 * sizes[3]
    last = publish.current(spark.read.parquet(out + "/snapshots"))
    assert {(r.review_count, r.positive) for r in last.collect()} == {(258, 258), (257, 257)}


def test_ttl_slides(spark, tmp_path):
    rows = spark.sql("select 'k' as key, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, m, 0) as ts, m as item from values (0), (20), (45), (80) as t(m)")
    batch = state.reused_within(rows, "key", "ts", "item", "interval 30 minutes").orderBy("item")
    assert [r.reused for r in batch.collect()] == [False, True, True, False]
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = state.requests_with_ttl(stream, "key", "ts", "item", 1800).writeStream.format("memory").queryName("ttl").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert [r.reused for r in spark.table("ttl").orderBy("item").collect()] == [False, True, True, False]


def test_windows_and_repeats(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    events = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    for name, frame in {
        "w": state.windowed_counts(events(), "ts", "value", "1 minute", "5 minutes", None, "event_type"),
        "s": state.sessions(events(), "ts", "1 minute", "10 minutes", "user_id"),
        "d": state.first_requests(events(), "user_id", "event_type", "ts", "1 hour"),
    }.items():
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert spark.table(name).count() > 0


def test_attempts_stream(spark, tmp_path):
    events = [("a", 0, "failed"), ("a", 1, "failed"), ("b", 0, "completed"), ("a", 2, "failed"), ("a", 3, "retry"), ("b", 1, "failed")]
    for i in (0, 3):
        spark.createDataFrame(events[i : i + 3], "item string, at int, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item string, at int, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.item_attempts(stream, "item", "kind", ["at"]).writeStream.format("memory").queryName("attempts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = [tuple(r) for r in spark.table("attempts").collect()]
    assert ("b", 0, "completed") in got or ("b", 1, "completed") in got
    assert {g for g in got if g[0] == "a"} <= {("a", 2, "pending"), ("a", 0, "pending"), ("a", 3, "failed")} and ("a", 0, "pending") in got


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["product_aspect_ranking", "removal_scenarios", "quality_queue", "dedup_manifest", "draft_overlay", "snapshot_digest", "analyze_reviews", "lease_claims", "preview_outcomes", "import_json", "checkpoint_files", "reused_previews", "orders_under_way", "newest_first", "latency_summary", "nearest_aspect"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "documents", "events", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = driver.queries()[name](spark, SMALL)
    result = con.execute(driver.oracle_sql()[name])
    place = [[c[0] for c in result.description].index(c) for c in got.columns]
    plain = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(tuple(r) for r in got.collect()) == plain([r[i] for i in place] for r in result.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    """A copy without both folders, with and without the pipeline's file, still imports and has its queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for name in ("corpus_pipeline.py", None):
        if name and (root / name).exists():
            shutil.copy(root / name, tmp_path)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'product_aspect_ranking' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q), q"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
