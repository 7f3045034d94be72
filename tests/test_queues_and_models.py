import hashlib
import io
import json
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import catalog, metrics, queue, serving
from tessera.sources import datasets


def test_leases(spark):
    jobs = spark.sql(
        "select * from values (1, 'queued', null, timestamp '2024-01-02', 0, 'v1'), (2, 'running', timestamp '2024-01-03', timestamp '2024-01-01', 1, 'v1'), (3, 'running', timestamp '2024-02-03', timestamp '2024-01-01', 1, 'v1'), "
        "(4, 'queued', null, timestamp '2023-01-01', 0, 'v0'), (5, 'completed', null, timestamp '2023-01-01', 0, 'v1') as t(job_id, status, lease_expires_at, created_at, attempt, pipeline_version)"
    )
    workers = spark.createDataFrame([("b",), ("a",), ("c",)], "worker_id string")
    got = queue.claims(jobs, workers, F.lit("2024-01-10").cast("timestamp"), "v1").orderBy("worker_id").collect()
    assert [(r.worker_id, r.job_id, r.attempt) for r in got] == [("a", 2, 2), ("b", 1, 1)]
    assert (got[0].lease_expires_at.minute, got[0].lease_expires_at.day) == (5, 10)


def test_attempts_and_retries(spark):
    events = [("a", 1, "failed"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 1, "failed"), ("b", 2, "completed"), ("c", 1, "failed"), ("c", 2, "failed"), ("c", 3, "failed"), ("c", 4, "retry"), ("c", 5, "failed"), ("d", 1, "retry")]
    rows = spark.createDataFrame([(i, t, n, k) for n, (i, t, k) in enumerate(events)], "item_id string, at int, id int, kind string")
    assert {r.item_id: (r.attempts, r.status) for r in queue.item_states(rows).collect()} == {"a": (3, "failed"), "b": (1, "completed"), "c": (1, "pending"), "d": (0, "pending")}


def test_previews_go_first(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    previews = spark.sql("select 'w' as worker_id, 'p' as preview_id, timestamp '2024-01-09' as created_at, 'queued' as status, cast(null as timestamp) as lease_expires_at, timestamp '2024-01-09' + make_dt_interval(d) as expires_at, 'v1' as pipeline_version from values (0), (5) as t(d)")
    items = spark.createDataFrame([("w", 1, "10", "pending"), ("w", 1, "2", "pending"), ("x", 2, "2", "pending"), ("x", 2, "10", "pending")], "worker_id string, job_id int, item_key string, status string")
    got = {r.worker_id: (r.kind, r.work_id) for r in queue.next_work(previews, items, now, "v1").collect()}
    assert got == {"w": ("preview", "p"), "x": ("item", "10")}
    assert queue.next_work(previews.where("expires_at < timestamp '2024-01-10'"), items, now, "v1").where("worker_id = 'w'").first().kind == "item"


def test_import_states(spark):
    log = [("s", 0, "pending", 10), ("s", 0, "posted", 10), ("s", 0, "terminal", 10), ("s", 1, "pending", 20), ("t", 0, "posted", 7), ("u", 0, "terminal", 9)]
    rows = spark.createDataFrame([(*r, "x") for r in log], "source string, batch long, state string, end_cursor long, source_sha256 string")
    now = spark.createDataFrame([("s", "x"), ("t", "x"), ("u", "y"), ("v", "z")], "source string, sha256 string")
    got = {r.source: (r.cursor, r.next_batch, r.action) for r in queue.import_states(rows, now).collect()}
    assert got == {"s": (10, 1, "post"), "t": (0, 0, "poll"), "u": (9, 1, "refuse"), "v": (0, 0, "read")}


def test_uuid5(spark):
    got = spark.createDataFrame([("a",), ("é/1",), ("",)], "n string").select("n", catalog.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in got)


def test_preview_errors_come_in_order(spark):
    previews = spark.createDataFrame([("a", 1, "X  y", 9, "v1", "completed"), ("b", 1, "x y", 9, "v1", "completed"), ("c", 1, "z", 2, "v1", "completed"), ("d", 1, "z", 9, "v0", "completed"), ("e", 2, "z", 9, "v1", "completed"), ("f", 1, "q", 9, "v1", "queued")], "preview_id string, product_id int, review_text string, expires_at int, pipeline_version string, status string")
    asked = {"dup": "abba", "late": "acd", "old": "dc", "foreign": "ae", "open": "fa"}
    rows = spark.createDataFrame([(r, 1, i, p) for r, ps in asked.items() for i, p in enumerate(ps)], "request_id string, product_id int, ordinal int, preview_id string")
    outcome, unique = serving.preview_summary(rows, previews, F.lit(5), "v1")
    assert {r.request_id: (r.error, r.duplicate_reviews) for r in outcome.collect()} == {"dup": (None, 1), "late": ("expired", None), "old": ("version", None), "foreign": ("missing", None), "open": ("incomplete", None)}
    assert [(r.request_id, r.preview_id) for r in unique.collect()] == [("dup", "a")]


def test_pages(spark):
    rows = spark.range(55)
    assert [r.id for r in serving.page(rows, ["id"], 3).collect()] == list(range(40, 55))
    for number, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError, match="page"):
            serving.page(rows, ["id"], number, size)
    with pytest.raises(ValueError, match="top_k"):
        serving.checked_top_k(51)


def test_softmax_and_pooling(spark):
    rows = spark.createDataFrame([([1000.0, 1001.0, 999.0], [[1.0, 0.0], [9.0, 9.0], [0.0, 1.0]], [1, 0, 1], [0, 0, 0])], "z array<double>, v array<array<double>>, m array<int>, n array<int>")
    r = rows.select(models.softmax(F.col("z")).alias("p"), models.argmax(F.col("z")).alias("a"), models.mean_pooled(F.col("v"), F.col("m")).alias("u"), models.mean_pooled(F.col("v"), F.col("n")).alias("none")).first()
    e = np.exp([-1, 0, -2])
    assert np.allclose(r.p, e / e.sum()) and r.a == 1 and np.allclose(r.u, [0.5**0.5] * 2) and r.none == [0.0, 0.0]


def test_generated_failures_cost_their_row_only(spark):
    def load():
        def generate(system, payload, schema):
            if payload["i"] == 1:
                raise TimeoutError("late")
            return {"i": payload["i"], "system": system}

        return generate

    rows = spark.createDataFrame([(i,) for i in range(3)], "i int").withColumn("g", models.generated(F.to_json(F.struct("i")), "s", {}, load))
    got = {r.i: (r.g.output, r.g.error) for r in rows.collect()}
    assert json.loads(got[0][0]) == {"i": 0, "system": "s"} and got[1] == (None, "TimeoutError: late") and got[2][1] is None


def test_baseline_learns(spark):
    rows = [(" ".join(["good fine"] * (1 + i % 3)) + f" w{i}", "a") if i % 3 else (f"bad poor w{i}", "b") for i in range(60)]
    frame = spark.createDataFrame(rows, "text string, label string")
    got = models.tfidf_baseline(frame, most=500, iterations=20).transform(frame)
    assert got.where("predicted = label").count() == 60


def test_gates_fail_on_missing_values(spark):
    none = spark.createDataFrame([(None,)], "f1 double")
    per = spark.createDataFrame([("x", 0.6, 0.7), ("y", 0.4, 0.9)], "label string, recall double, f1 double")
    assert {r.gate: r.passed for r in metrics.gates(none, per).collect()} == {"span_f1": False, "span_f1_above_rules": False, "macro_f1": True, "every_recall": False, "macro_f1_above_tfidf": True}


def sheet(rows):
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in row.items()) + "</row>" for r, row in rows.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_worksheets_and_xml(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet({2: {"A": "p", "D": "x"}, 3: {"D": "y"}, 5: {"A": "q", "E": "z"}}))
    got = datasets.worksheet(spark, str(tmp_path / "a.xlsx")).orderBy("source_row").collect()
    assert [(r.source_row, r.A, r.D, r.E) for r in got] == [(2, "p", "x", None), (3, "p", "y", None), (5, "q", None, "z")]
    (tmp_path / "a.xml").write_text('<sentences><sentence id="7"><text>Good screen, bad screen</text><aspectTerms><aspectTerm term="screen" polarity="positive" from="5" to="11"/><aspectTerm term="screen" polarity="negative" from="0" to="6"/></aspectTerms></sentence><sentence id="8"><text>None</text></sentence></sentences>')
    got = datasets.xml_sentences(spark, str(tmp_path / "a.xml"), "train").orderBy("review_id", "nth").collect()
    assert [(r.review_id, r.aspect, r.sentiment, r.span and tuple(r.span)) for r in got] == [("semeval:train:7", "screen", "positive", (5, 11)), ("semeval:train:7", "screen", "negative", (5, 11)), ("semeval:train:8", None, None, None)]
    assert datasets.find_file(spark, str(tmp_path), "a.xml").first().path.endswith("a.xml")


def test_split_files(spark, tmp_path):
    (tmp_path / "test.jsonl").write_text(json.dumps({"review_id": "r", "review_text": "t", "annotations": [{"start_char": 0, "end_char": 1, "aspect": "t"}]}) + "\n")
    r = datasets.split_file(spark, str(tmp_path), "test").first()
    assert (r.review_id, r.annotations[0].aspect, r.annotations[0].opinion) == ("r", "t", None)


def test_checkpoints(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([("config.json", bytearray(b"{}")), ("w", bytearray(models.POINTER + b"v1"))], "path string, content binary")
    manifest = spark.createDataFrame([("config.json", sha(b"{}")), ("w", "0"), ("x", "0")], "path string, sha256 string")
    assert {(r.path, r.check) for r in models.checkpoint_files(files, manifest, ["config.json", "y"]).collect()} == {("w", "pointer"), ("x", "missing"), ("y", "missing")}
